"""PNG and TIFF files to and from px, with the standard library and numpy only.

Files are read with Spark's ``binaryFile`` source, so paths may lie in any store that Spark knows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import grid_of

PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def png_info(data: bytes) -> dict:
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    out = {"x_resolution": 0.0, "y_resolution": 0.0}
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            w, h, depth, color = struct.unpack(">IIBB", body[:10])
            out |= {"ncols": w, "nrows": h, "depth": depth, "ncolors": CHANNELS[color], "color": color}
        elif kind == b"pHYs":
            x, y, unit = struct.unpack(">IIB", body)
            if unit == 1:
                out |= {"x_resolution": x * 0.0254, "y_resolution": y * 0.0254}
    return out


def decode_png(data: bytes) -> np.ndarray:
    """One-bit files become 1 for black; grey ones 8 or 16 bits; colour ones rows x columns x 3."""
    info = png_info(data)
    w, h, depth, color = info["ncols"], info["nrows"], info["depth"], info["color"]
    palette, raw = None, b""
    for kind, body in png_chunks(data):
        if kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            raw += body
    raw = np.frombuffer(zlib.decompress(raw), np.uint8)
    n = CHANNELS[color]
    step, stride = max(1, n * depth // 8), (w * n * depth + 7) // 8
    lines = raw.reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    before = np.zeros(stride, np.int64)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + before
        elif kind:
            for x in range(stride):
                a = line[x - step] & 255 if x >= step else 0
                b, c = before[x], before[x - step] if x >= step else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - c
                    p = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
                line[x] = (line[x] + p) & 255
        before = line & 255
        out[y] = before
    if depth == 16:
        px = out.reshape(h, w, n, 2).astype(np.int32)
        px = px[..., 0] << 8 | px[..., 1]
    elif depth == 8:
        px = out.reshape(h, w, n).astype(np.int32)
    else:
        px = (np.unpackbits(out, axis=1).reshape(h, -1, depth) * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :w, None].astype(np.int32)
    if color == 3:
        return palette[px[..., 0]].astype(np.int32)
    if color in (2, 6):
        return px[..., :3] >> (8 if depth == 16 else 0)
    grey = px[..., 0]
    return 1 - grey if depth == 1 else grey * (255 // ((1 << depth) - 1)) if depth < 8 else grey


def encode_png(a: np.ndarray, kind: str) -> bytes:
    """kind: onebit, greyscale, grey16 or rgb."""
    h, w = a.shape[:2]
    depth, color = {"onebit": (1, 0), "greyscale": (8, 0), "grey16": (16, 0), "rgb": (8, 2)}[kind]
    if kind == "onebit":
        body = np.packbits((a == 0).astype(np.uint8), axis=1)
    elif kind == "grey16":
        body = a.astype(">u2").view(np.uint8).reshape(h, -1)
    else:
        body = a.astype(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), body], axis=1).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff_tags(data: bytes) -> tuple[str, dict[int, list]]:
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack(e + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(e + "I", data[4:8])
    (n,) = struct.unpack(e + "H", data[at : at + 2])
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8)}.get(kind, ("B", 1))
        place = at + 10 + 12 * k
        if count * size > 4:
            (place,) = struct.unpack(e + "I", data[place : place + 4])
        flat = struct.unpack(e + code * count, data[place : place + size * count])
        tags[tag] = [flat[2 * i] / max(1, flat[2 * i + 1]) for i in range(count)] if kind == 5 else list(flat)
    return e, tags


def tiff_info(data: bytes) -> dict:
    _, t = tiff_tags(data)
    return {"ncols": t[256][0], "nrows": t[257][0], "depth": t.get(258, [1])[0], "ncolors": t.get(277, [1])[0], "x_resolution": float(t.get(282, [0])[0]), "y_resolution": float(t.get(283, [0])[0]), "color": t.get(262, [0])[0]}


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """Stripped files, uncompressed, PackBits or deflate."""
    e, t = tiff_tags(data)
    w, h, depth, n = t[256][0], t[257][0], t.get(258, [1])[0], t.get(277, [1])[0]
    how = t.get(259, [1])[0]
    open_ = {1: bytes, 32773: unpack_bits, 8: zlib.decompress, 32946: zlib.decompress}
    if how not in open_:
        raise ValueError(f"TIFF compression {how} isn't supported")
    raw = b"".join(open_[how](data[a : a + s]) for a, s in zip(t[273], t[279], strict=True))
    stride = (w * n * depth + 7) // 8
    lines = np.frombuffer(raw, np.uint8)[: h * stride].reshape(h, stride)
    if depth == 1:
        bits = np.unpackbits(lines, axis=1)[:, :w].astype(np.int32)
        return bits if t.get(262, [0])[0] == 0 else 1 - bits
    px = (lines.copy().view(e + "u2") if depth == 16 else lines).reshape(h, w, n).astype(np.int32)
    if n >= 3:
        return px[..., :3] >> (8 if depth == 16 else 0)
    return px[..., 0] if t.get(262, [1])[0] else (1 << depth) - 1 - px[..., 0]


def encode_tiff(a: np.ndarray, kind: str) -> bytes:
    h, w = a.shape[:2]
    depth, n, photo = {"onebit": (1, 1, 0), "greyscale": (8, 1, 1), "grey16": (16, 1, 1), "rgb": (8, 3, 2)}[kind]
    body = np.packbits((a > 0).astype(np.uint8), axis=1).tobytes() if kind == "onebit" else a.astype("<u2").tobytes() if kind == "grey16" else a.astype(np.uint8).tobytes()
    short = lambda tag, x: struct.pack("<HHIHH", tag, 3, 1, x, 0)
    long_ = lambda tag, x: struct.pack("<HHII", tag, 4, 1, x)
    entries = [long_(256, w), long_(257, h), short(258, depth), short(259, 1), short(262, photo), long_(273, 8), short(277, n), long_(278, h), long_(279, len(body))]
    if n == 3:
        entries[2] = struct.pack("<HHII", 258, 3, 3, 8 + len(body) + len(body) % 2)
    pad = b"\0" * (len(body) % 2)
    extra = struct.pack("<HHH", 8, 8, 8) + b"\0\0" if n == 3 else b""
    return b"II*\0" + struct.pack("<I", 8 + len(body) + len(pad) + len(extra)) + body + pad + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def info(data: bytes) -> dict:
    return png_info(data) if data[:8] == PNG else tiff_info(data)


def image_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, nrows, ncols, depth, ncolors, x_resolution, y_resolution) of the files at a path or pattern."""
    schema = "path string, nrows int, ncols int, depth int, ncolors int, x_resolution double, y_resolution double"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *[i[c] for c in ("nrows", "ncols", "depth", "ncolors", "x_resolution", "y_resolution")]) for p, i in ((p, info(bytes(d))) for p, d in zip(pdf["path"], pdf["content"], strict=True))], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def load_image(spark: SparkSession, path: str, rgb: bool = False) -> DataFrame:
    """px of the files at a path or pattern, with image_id a hash of the path. An unknown format is an error.

    Without ``rgb`` colour files turn grey; with it v is a struct and grey values fill all channels.
    """

    def run(batches):
        for pdf in batches:
            for i, d in zip(pdf["image_id"], pdf["content"], strict=True):
                data = bytes(d)
                a = decode_png(data) if data[:8] == PNG else decode_tiff(data)
                y, x = np.indices(a.shape[:2])
                out = {"image_id": np.full(y.size, i), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32")}
                if rgb:
                    c = a if a.ndim == 3 else np.repeat(a[..., None], 3, axis=2)
                    yield pd.DataFrame(out | {n: c[..., k].ravel().astype("int32") for k, n in enumerate("rgb")})
                else:
                    g = np.floor(a @ np.array([0.3, 0.59, 0.11]) + 0.5) if a.ndim == 3 else a
                    yield pd.DataFrame(out | {"v": g.ravel().astype("int32")})

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("image_id"), "content")
    px = files.mapInPandas(run, "image_id long, y int, x int, " + ("r int, g int, b int" if rgb else "v int"))
    return px.select("image_id", "y", "x", F.struct("r", "g", "b").alias("v")) if rgb else px


def encoded(px: DataFrame, kind: str, form: str = "png") -> DataFrame:
    """(image_id, data): the file of each image. RGB px have a struct v."""
    flat = px.select("image_id", "y", "x", (F.col("v.r") * 65536 + F.col("v.g") * 256 + F.col("v.b")).alias("v")) if kind == "rgb" else px

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = grid_of(pdf)
        a = np.stack([a >> 16, a >> 8 & 255, a & 255], axis=2) if kind == "rgb" else a
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "data": [(encode_png if form == "png" else encode_tiff)(a, kind)]})

    return flat.groupBy("image_id").applyInPandas(run, "image_id long, data binary")


def save_images(px: DataFrame, folder: str, kind: str, form: str = "png") -> None:
    """Writes <folder>/<image_id>.<form> through the Hadoop file system of the folder, from the driver's JVM.

    For a handful of results; keep large sets in the (image_id, data) relation of ``encoded``.
    """
    spark = px.sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for r in encoded(px, kind, form).toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['image_id']}.{form}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(r["data"]))
        out.close()


def from_numpy(spark: SparkSession, arrays: dict[int, np.ndarray]) -> DataFrame:
    """px of two-dimensional arrays by image id."""
    rows = [pd.DataFrame({"image_id": i, "y": np.indices(a.shape)[0].ravel().astype("int32"), "x": np.indices(a.shape)[1].ravel().astype("int32"), "v": a.ravel()}) for i, a in arrays.items()]
    return spark.createDataFrame(pd.concat(rows))


def to_numpy(px: DataFrame, image_id: int) -> np.ndarray:
    """The raster of one image, on the driver."""
    return grid_of(px.where(F.col("image_id") == image_id).toPandas())
