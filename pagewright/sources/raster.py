"""Images as relations of pixels.

``px(image_id, y, x, v)`` holds a row per pixel. A one-bit image has v = 0 for white and anything above for
black (the value may be a label); a greyscale image has 0 for black and 255 for white; RGB pixels are
structs (r, g, b). Sizes come from the pixels themselves, so ``px`` is dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = {"onebit": 0, "greyscale": 255, "grey16": 65535, "float": 255.0}
SPLIT_ROWS = 2_000


def text_raster(df: DataFrame, image_id: str, text: str, width: int = 64) -> DataFrame:
    """Greyscale px of texts: the k-th character is pixel (k div width, k mod width) of value code point mod 256."""
    chars = df.select(F.col(image_id).cast("long").alias("image_id"), F.posexplode(F.split(F.col(text), "")).alias("k", "ch")).where("ch <> ''")
    return chars.select("image_id", F.floor(F.col("k") / width).cast("int").alias("y"), (F.col("k") % width).cast("int").alias("x"), (F.ascii("ch") % 256).cast("int").alias("v"))


def ink(px: DataFrame, above: int = 32) -> DataFrame:
    """One-bit px: black where v is above."""
    return px.withColumn("v", (F.col("v") > above).cast("int"))


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, nrows, ncols) of every image."""
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("nrows"), (F.max("x") + 1).alias("ncols"))


def padded(px: DataFrame, value) -> DataFrame:
    """px with the cells that ragged last rows lack, filled with ``value``."""
    grid = sizes(px).select("image_id", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("y"), "ncols")
    grid = grid.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1)).alias("x"))
    return grid.join(px, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(value)))


def from_nested_list(df: DataFrame, image_id: str, rows: str) -> DataFrame:
    """px of images given as arrays of rows; ragged rows are an error."""
    lengths = F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r))))
    checked = df.withColumn(rows, F.when(lengths > 1, F.raise_error(F.lit("rows of different lengths"))).otherwise(F.col(rows)))
    by_row = checked.select(F.col(image_id).alias("image_id"), F.posexplode(rows).alias("y", "row"))
    return by_row.select("image_id", "y", F.posexplode("row").alias("x", "v"))


def to_nested_list(px: DataFrame) -> DataFrame:
    """(image_id, rows): the pixel values as an array of rows."""
    row = px.groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("row"))
    return row.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"]).alias("rows"))


def to_raw_string(px: DataFrame) -> DataFrame:
    """(image_id, nrows, ncols, data): bytes of a greyscale or one-bit image in raster order."""
    cells = px.groupBy("image_id").agg((F.max("y") + 1).alias("nrows"), (F.max("x") + 1).alias("ncols"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("c"))
    return cells.select("image_id", "nrows", "ncols", F.unhex(F.array_join(F.transform("c", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "")).alias("data"))


def to_rgb_string(px: DataFrame) -> DataFrame:
    """(image_id, data): three bytes a pixel in raster order, from RGB px."""
    part = F.concat(*[F.lpad(F.hex(F.col(f"v.{c}")), 2, "0") for c in "rgb"])
    cells = px.select("image_id", F.struct("y", "x", part.alias("h")).alias("c")).groupBy("image_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return cells.select("image_id", F.unhex(F.array_join(F.transform("c", lambda s: s["h"]), "")).alias("data"))


def from_raw_string(df: DataFrame) -> DataFrame:
    """px from (image_id, nrows, ncols, data)."""
    hexed = df.select("image_id", "ncols", F.posexplode(F.split(F.regexp_replace(F.hex("data"), "(..)(?!$)", "$1,"), ",")).alias("k", "b")).where("b <> ''")
    return hexed.select("image_id", F.floor(F.col("k") / F.col("ncols")).cast("int").alias("y"), (F.col("k") % F.col("ncols")).cast("int").alias("x"), F.conv("b", 16, 10).cast("int").alias("v"))


def grid_of(pdf: pd.DataFrame, fill=0) -> np.ndarray:
    """The raster of one image's px."""
    return raster_of(pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["v"].to_numpy(), fill)


def raster_of(y: np.ndarray, x: np.ndarray, v: np.ndarray, fill=0) -> np.ndarray:
    out = np.full((y.max() + 1, x.max() + 1), fill, dtype=v.dtype)
    out[y, x] = v
    return out


#: Pixels that are sent on at once.
BATCH_PIXELS = 1 << 18


def by_batch(px: DataFrame, run, kinds: dict[str, str]) -> DataFrame:
    """(image_id, y, x, <kinds>): for each image the arrays y, x and those of ``kinds`` that ``run(y, x, v)`` returns.

    An image is a row, and the rows of a batch share their way to Python and back: a call for each image costs many times
    the work on a small one.
    """
    types = {"int": np.int32, "long": np.int64, "double": np.float64}
    names = ["image_id", "y", "x", *kinds]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, values = b.column("p"), b.column("v")
            ends = places.offsets.to_numpy()
            if not np.array_equal(np.diff(ends), np.diff(values.offsets.to_numpy())):
                raise ValueError("pixels without a value")
            p, v = (c.flatten().to_numpy(zero_copy_only=False) for c in (places, values))
            out, held = [], 0
            for i, (image, at, end) in enumerate(zip(b.column("image_id").to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)):
                made = run(p[at:end] >> 32, p[at:end] & 0xFFFFFFFF, v[at:end])
                out.append((np.full(len(made[0]), image, dtype=np.int64), *made))
                held += len(made[0])
                if held >= BATCH_PIXELS or i == b.num_rows - 1:
                    kind = [np.int64, np.int32, np.int32, *[types[k] for k in kinds.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k, copy=False)) for c, k in zip(zip(*out, strict=True), kind, strict=True)], names)
                    out, held = [], 0

    own = px.groupBy("image_id").agg(F.collect_list(F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")).alias("p"), F.collect_list("v").alias("v"))
    return own.mapInArrow(go, "image_id long, y int, x int, " + ", ".join(f"{k} {kind}" for k, kind in kinds.items()))


def pixels_of(image_id: int, grid: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(grid.shape)
    return pd.DataFrame({"image_id": np.full(grid.size, image_id), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": grid.ravel()})


def by_image(px: DataFrame, kernel, kind: str = "int", fill=0) -> DataFrame:
    """Runs a numpy kernel (raster to raster) on each image; for algorithms that are sequential within an image."""

    def run(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        out = np.asarray(kernel(raster_of(y, x, v, fill)))
        y, x = np.indices(out.shape)
        return y.ravel(), x.ravel(), out.ravel()

    return by_batch(px, run, {"v": kind})


def at_pixels(px: DataFrame, kernel, kinds: dict[str, str]) -> DataFrame:
    """px's pixels with the values that ``kernel(raster, there)`` gives, a raster for each name of ``kinds``.

    ``there`` marks the pixels that px has; the others are 0 in the raster and stay out. All of an image is in one call, so
    neighbours need no join and an image's pixels are dealt once.
    """

    def run(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        there = np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        there[y, x] = True
        return y, x, *(np.asarray(made)[y, x] for made in kernel(raster_of(y, x, v), there))

    return by_batch(px, run, kinds)


def from_image(px: DataFrame, kernel, schema: str, fill=0) -> DataFrame:
    """Runs a numpy kernel on each image that returns rows for ``schema`` (tuples, after image_id)."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["image_id"].iloc[0])
        return pd.DataFrame([(i, *r) for r in kernel(grid_of(pdf, fill))], columns=["image_id", *names])

    return px.groupBy("image_id").applyInPandas(run, f"image_id long, {schema}")
