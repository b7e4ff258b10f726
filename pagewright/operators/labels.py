"""Multi-label components, regions, points and single pixels.

A multi-label component is a row a label: (image_id, comp, label, ulx, uly, lrx, lry). Its box is the union of its
labels' boxes; neighbours are a relation of label pairs. A region is a row: a box with named numbers as a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("ulx", "uly", "lrx", "lry")


def to_mlcc(ccs: DataFrame) -> DataFrame:
    """A multi-label component of one label for each component of ccs(image_id, label, box)."""
    return ccs.select("image_id", F.col("label").alias("comp"), "label", *BOX)


def mlcc_boxes(mlcc: DataFrame) -> DataFrame:
    """(image_id, comp, labels, box) of each multi-label component."""
    cut = {c: (F.min(c) if c.startswith("ul") else F.max(c)).alias(c) for c in BOX}
    return mlcc.groupBy("image_id", "comp").agg(F.array_sort(F.collect_set("label")).alias("labels"), *cut.values())


def has_label(mlcc: DataFrame, label: int | Column) -> DataFrame:
    """(image_id, comp, has)."""
    return mlcc.groupBy("image_id", "comp").agg(F.max(F.col("label") == label).alias("has"))


def relabel(mlcc: DataFrame, groups: DataFrame) -> DataFrame:
    """New components, one for each group of labels: groups(image_id, label, comp); labels in no group are left out."""
    return mlcc.drop("comp").join(groups.select("image_id", "label", "comp"), ["image_id", "label"])


def convert_to_cc(mlcc: DataFrame) -> DataFrame:
    """(image_id, label, box): one component a multi-label component, under its smallest label."""
    return mlcc_boxes(mlcc).select("image_id", F.array_min("labels").alias("label"), *BOX)


def convert_to_cc_list(mlcc: DataFrame) -> DataFrame:
    """(image_id, comp, label, box): one component a label."""
    return mlcc.select("image_id", "comp", "label", *BOX)


def add_neighbors(pairs: DataFrame) -> DataFrame:
    """(image_id, a, b) both ways, each once, without a label's own: neighbourhood is symmetric."""
    both = pairs.select("image_id", "a", "b").unionByName(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct()


def get_neighbors(mlcc: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(image_id, comp, label, neighbor): neighbours of a component's labels that belong to the same component."""
    own = mlcc.select("image_id", "comp", F.col("label").alias("neighbor"))
    return mlcc.select("image_id", "comp", "label").join(neighbors.select("image_id", F.col("a").alias("label"), F.col("b").alias("neighbor")), ["image_id", "label"]).join(own, ["image_id", "comp", "neighbor"])


# --- regions ---------------------------------------------------------------------------------------


def add_region(regions: DataFrame, more: DataFrame) -> DataFrame:
    return regions.unionByName(more)


def region_lookup(regions: DataFrame, boxes: DataFrame, size: int = 100) -> DataFrame:
    """(image_id, id, region, values): the smallest region that contains each box; ties go to the smaller region id.

    regions(image_id, id, box, values map<string, double>), boxes(image_id, id, box); they meet by grid cells.
    """
    from .segment import contains, rect_join

    area = (F.col("a_lrx") - F.col("a_ulx") + 1).cast("long") * (F.col("a_lry") - F.col("a_uly") + 1)
    found = rect_join(regions, boxes, contains(), size).groupBy("image_id", F.col("b_id").alias("id")).agg(F.min(F.struct(area.alias("area"), F.col("a_id").alias("region"))).alias("r"))
    values = regions.select("image_id", F.col("id").alias("region"), "values")
    return found.select("image_id", "id", F.col("r.region").alias("region")).join(values, ["image_id", "region"])


# --- points and pixels -----------------------------------------------------------------------------


def move(x: str | Column, y: str | Column, dx: int, dy: int) -> tuple[Column, Column]:
    """A point moved by (dx, dy)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(x) + dx, col(y) + dy


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def get_point(px: DataFrame, x: int, y: int) -> DataFrame:
    """(image_id, v) of each image's pixel at (x, y); images without it are left out."""
    return px.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", "v")


def set_point(px: DataFrame, x: int, y: int, v: int) -> DataFrame:
    return px.withColumn("v", F.when((F.col("x") == x) & (F.col("y") == y), F.lit(v)).otherwise(F.col("v")))


def get_item(px: DataFrame, index: int) -> DataFrame:
    """(image_id, v) of the pixel of a raster-order index."""
    from ..sources.raster import sizes

    s = px.join(sizes(px), "image_id")
    return s.where(F.col("y").cast("long") * F.col("ncols") + F.col("x") == index).select("image_id", "v")


def length(px: DataFrame) -> DataFrame:
    """(image_id, n): rows times columns."""
    from ..sources.raster import sizes

    return sizes(px).select("image_id", (F.col("nrows").cast("long") * F.col("ncols")).alias("n"))


def is_homogeneous(images: DataFrame, kind: str = "pixel_type") -> bool:
    """Whether all images of a relation have one pixel type (an empty relation does)."""
    return images.select(kind).distinct().limit(2).count() < 2


def white(kind: str) -> float:
    """The white value of a pixel type."""
    return {"onebit": 0, "greyscale": 255, "grey16": 65535, "float": 1.7976931348623157e308, "rgb": 0xFFFFFF}[kind]


def black_value(kind: str) -> float:
    """The black value of a pixel type."""
    return {"onebit": 1, "greyscale": 0, "grey16": 0, "float": 0.0, "rgb": 0}[kind]
