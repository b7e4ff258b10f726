"""Pixel algebra: casts, colour, arithmetic, logic, geometry of the grid, utilities. All plain projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.raster import sizes

KEY = ["image_id", "y", "x"]
LIMIT = {"onebit": 1, "greyscale": 255, "grey16": 65535}


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


# --- casts -----------------------------------------------------------------------------------------


def to_rgb(px: DataFrame, kind: str = "greyscale") -> DataFrame:
    g = F.when(F.col("v") > 0, 0).otherwise(255) if kind == "onebit" else F.least(F.lit(255), F.greatest(F.lit(0), F.col("v"))).cast("int")
    return px.withColumn("v", F.struct(g.alias("r"), g.alias("g"), g.alias("b")))


def luminance(rgb: Column) -> Column:
    return 0.3 * rgb["r"] + 0.59 * rgb["g"] + 0.11 * rgb["b"]


def rgb_to_greyscale(px: DataFrame) -> DataFrame:
    return px.withColumn("v", rounded(luminance(F.col("v"))).cast("int"))


def onebit_to_greyscale(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.when(F.col("v") > 0, 0).otherwise(255))


def float_to_greyscale(px: DataFrame) -> DataFrame:
    """Stretches each image's range to 0..255; flat images become 0."""
    ends = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return px.join(ends, "image_id").withColumn("v", F.floor(scaled).cast("int")).select(*KEY, "v")


def grey16_to_greyscale(px: DataFrame) -> DataFrame:
    top = px.groupBy("image_id").agg(F.max("v").alias("hi"))
    return px.join(top, "image_id").withColumn("v", F.floor(F.col("v") * 255.0 / F.greatest("hi", F.lit(1))).cast("int")).select(*KEY, "v")


def to_grey16(px: DataFrame) -> DataFrame:
    top = px.groupBy("image_id").agg(F.max("v").alias("hi"))
    return px.join(top, "image_id").withColumn("v", F.floor(F.col("v") * 65535.0 / F.greatest("hi", F.lit(1))).cast("int")).select(*KEY, "v")


def to_float(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.col("v").cast("double"))


def to_complex(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.struct(F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")))


def extract_real(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.col("v")["re"])


def extract_imaginary(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.col("v")["im"])


# --- colour ----------------------------------------------------------------------------------------

#: Linear RGB (0..1) to CIE XYZ; fixed values of the standard.
XYZ = {"x": (0.412453, 0.357580, 0.180423), "y": (0.212671, 0.715160, 0.072169), "z": (0.019334, 0.119193, 0.950227)}
D65 = (0.950456, 1.0, 1.088754)


def channel(name: str) -> Column:
    """Float value of a named channel of an RGB pixel: red green blue cyan magenta yellow hue saturation value cie_x cie_y cie_z cie_Lab_L cie_Lab_a cie_Lab_b."""
    r, g, b = F.col("v")["r"], F.col("v")["g"], F.col("v")["b"]
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (high - low).cast("double")
    if name in ("red", "green", "blue"):
        return F.col("v")[name[0]].cast("double")
    if name in ("cyan", "magenta", "yellow"):
        return (255 - F.col("v")[{"cyan": "r", "magenta": "g", "yellow": "b"}[name]]).cast("double")
    if name == "value":
        return high / 255.0
    if name == "saturation":
        return F.when(high > 0, d / high).otherwise(0.0)
    if name == "hue":
        h = F.when(high == r, (g - b) / d).when(high == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) / 6.0
        return F.when(d == 0, 0.0).otherwise(F.when(h < 0, h + 1).otherwise(h))
    xyz = {k: (m[0] * r + m[1] * g + m[2] * b) / 255.0 for k, m in XYZ.items()}
    if name in ("cie_x", "cie_y", "cie_z"):
        return xyz[name[-1]]
    f = {k: F.when(c / w > 0.008856, F.cbrt(c / w)).otherwise(7.787 * c / w + 16 / 116) for (k, c), w in zip(xyz.items(), D65, strict=True)}
    return {"cie_Lab_L": 116 * f["y"] - 16, "cie_Lab_a": 500 * (f["x"] - f["y"]), "cie_Lab_b": 200 * (f["y"] - f["z"])}[name]


def extract_channel(px: DataFrame, name: str) -> DataFrame:
    return px.withColumn("v", channel(name))


def false_color(px: DataFrame, colormap: str = "rainbow") -> DataFrame:
    """RGB of a float or grey image after its range is scaled to 0..1."""
    ends = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    byte = lambda c: F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) + 0.5).cast("int")
    if colormap == "rainbow":
        r, g, b = 1.5 - F.abs(4 * t - 3), 1.5 - F.abs(4 * t - 2), 1.5 - F.abs(4 * t - 1)
    else:  # diverging: blue over light grey to red
        r, g, b = F.least(F.lit(1.0), 0.23 + 1.3 * t), 0.87 - 1.4 * F.abs(t - 0.5), F.least(F.lit(1.0), 0.16 + 1.3 * (1 - t))
    return px.join(ends, "image_id").select(*KEY, F.struct(byte(r).alias("r"), byte(g).alias("g"), byte(b).alias("b")).alias("v"))


def colors_to_labels(px: DataFrame, labels: dict[tuple[int, int, int], int] | None = None) -> DataFrame:
    """One-bit labels of colours: by the mapping (others 0), or numbered by colour from 1 with white 0."""
    if labels is not None:
        out = F.lit(0)
        for (r, g, b), n in labels.items():
            out = F.when((F.col("v")["r"] == r) & (F.col("v")["g"] == g) & (F.col("v")["b"] == b), n).otherwise(out)
        return px.withColumn("v", out.cast("int"))
    white = (F.col("v")["r"] == 255) & (F.col("v")["g"] == 255) & (F.col("v")["b"] == 255)
    seen = px.where(~white).select("image_id", F.col("v")["r"].alias("r"), F.col("v")["g"].alias("g"), F.col("v")["b"].alias("b")).distinct()
    seen = seen.withColumn("n", F.expr("row_number() over (partition by image_id order by r, g, b)"))
    flat = px.select(*KEY, F.col("v")["r"].alias("r"), F.col("v")["g"].alias("g"), F.col("v")["b"].alias("b"))
    return flat.join(seen, ["image_id", "r", "g", "b"], "left").select(*KEY, F.coalesce("n", F.lit(0)).cast("int").alias("v"))


# --- two images ------------------------------------------------------------------------------------


def combine(a: DataFrame, b: DataFrame, value) -> DataFrame:
    """Pixelwise ``value(va, vb)`` of images of equal id and size; a size that differs is an error."""
    both = a.join(b.withColumnRenamed("v", "w"), KEY, "full")
    missing = F.col("v").isNull() | F.col("w").isNull()
    out = value(F.col("v"), F.col("w"))
    return both.withColumn("v", F.when(missing, F.raise_error(F.lit("images differ in size"))).otherwise(out)).select(*KEY, "v")


def clipped(x: Column, kind: str) -> Column:
    return x.cast("double") if kind == "float" else F.least(F.lit(LIMIT[kind]), F.greatest(F.lit(0), x)).cast("int")


def arithmetic(a: DataFrame, b: DataFrame, op: str, kind: str = "greyscale") -> DataFrame:
    """op: add, subtract, multiply or divide, in the promoted type, clipped to the pixel type; x / 0 is 0."""
    if kind == "onebit":
        rule = {"add": lambda p, q: (p > 0) | (q > 0), "subtract": lambda p, q: (p > 0) & (q == 0), "multiply": lambda p, q: (p > 0) & (q > 0)}[op]
        return combine(a, b, lambda p, q: rule(p, q).cast("int"))
    rule = {
        "add": lambda p, q: p + q,
        "subtract": lambda p, q: p - q,
        "multiply": lambda p, q: p.cast("double" if kind == "float" else "long") * q,
        "divide": lambda p, q: F.when(q == 0, 0).otherwise(p / q if kind == "float" else F.floor(p / q)),
    }[op]
    return combine(a, b, lambda p, q: clipped(rule(p, q), kind))


def logical(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    rule = {"and": lambda p, q: (p > 0) & (q > 0), "or": lambda p, q: (p > 0) | (q > 0), "xor": lambda p, q: (p > 0) != (q > 0)}[op]
    return combine(a, b, lambda p, q: rule(p, q).cast("int"))


def mask(px: DataFrame, onebit: DataFrame) -> DataFrame:
    """Keeps greyscale pixels where the mask is black; white elsewhere."""
    return combine(px, onebit, lambda p, q: F.when(q > 0, p).otherwise(255))


def union_images(px: DataFrame) -> DataFrame:
    """One image (id 0), black where any image is, over the union of their boxes."""
    return px.groupBy("y", "x").agg(F.max((F.col("v") > 0).cast("int")).alias("v")).select(F.lit(0).cast("long").alias("image_id"), "y", "x", "v")


def diff_images(a: DataFrame, b: DataFrame) -> DataFrame:
    """RGB: black in both, red only in a, green only in b, white in none."""
    rgb = lambda r, g, b_: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b_).alias("b"))
    return combine(a, b, lambda p, q: F.when((p > 0) & (q > 0), rgb(0, 0, 0)).when(p > 0, rgb(255, 0, 0)).when(q > 0, rgb(0, 255, 0)).otherwise(rgb(255, 255, 255)))


def mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, mse) of RGB images: mean over pixels and channels."""
    both = a.join(b.withColumnRenamed("v", "w").hint("merge"), KEY)
    d = lambda c: F.pow((F.col("v")[c] - F.col("w")[c]).cast("double"), 2)
    return both.groupBy("image_id").agg((F.avg(d("r") + d("g") + d("b")) / 3).alias("mse"))


def highlight(px: DataFrame, cc: DataFrame, value) -> DataFrame:
    """px with ``value`` where the component ``cc`` is black."""
    on = cc.where(F.col("v") > 0).select(*KEY, F.lit(True).alias("hit"))
    return px.join(on.hint("merge"), KEY, "left").withColumn("v", F.when(F.col("hit"), F.lit(value)).otherwise(F.col("v"))).select(*KEY, "v")


# --- one image -------------------------------------------------------------------------------------


def invert(px: DataFrame, kind: str = "greyscale") -> DataFrame:
    return px.withColumn("v", (F.col("v") == 0).cast("int") if kind == "onebit" else LIMIT[kind] - F.col("v"))


def fill(px: DataFrame, value) -> DataFrame:
    return px.withColumn("v", F.lit(value))


def grey_convert(px: DataFrame, table: list[int]) -> DataFrame:
    return px.withColumn("v", F.element_at(F.array(*[F.lit(t) for t in table]), F.col("v") + 1))


def reset_onebit(px: DataFrame) -> DataFrame:
    return px.withColumn("v", (F.col("v") > 0).cast("int"))


def subimage(px: DataFrame, ulx: int, uly: int, lrx: int, lry: int) -> DataFrame:
    inside = px.where(F.col("x").between(ulx, lrx) & F.col("y").between(uly, lry))
    return inside.select("image_id", (F.col("y") - uly).alias("y"), (F.col("x") - ulx).alias("x"), "v")


def clip_image(px: DataFrame, ulx: int, uly: int, lrx: int, lry: int) -> DataFrame:
    """The part inside the rectangle, in page coordinates; the first pixel of images without any."""
    inside = px.where(F.col("x").between(ulx, lrx) & F.col("y").between(uly, lry))
    return inside.unionByName(px.where("x = 0 and y = 0").join(inside.select("image_id").distinct(), "image_id", "left_anti"))


def pad_image(px: DataFrame, top: int, right: int, bottom: int, left: int, value) -> DataFrame:
    moved = px.select("image_id", (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), "v")
    grid = sizes(px).select("image_id", F.explode(F.sequence(F.lit(0), F.col("nrows") + (top + bottom - 1))).alias("y"), "ncols")
    grid = grid.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("ncols") + (left + right - 1))).alias("x"))
    return grid.join(moved.hint("merge"), KEY, "left").withColumn("v", F.coalesce("v", F.lit(value)))


def trim_image(px: DataFrame, value=0) -> DataFrame:
    """Cut to the box of pixels other than ``value``; whole where there is none."""
    box = px.groupBy("image_id").agg(
        *[F.coalesce(f(F.when(F.col("v") != value, F.col(c))), g(c)).alias(n) for n, f, g, c in (("y0", F.min, F.min, "y"), ("y1", F.max, F.max, "y"), ("x0", F.min, F.min, "x"), ("x1", F.max, F.max, "x"))]
    )
    return px.join(box, "image_id").where("y between y0 and y1 and x between x0 and x1").select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def mirror_horizontal(px: DataFrame) -> DataFrame:
    """Top and bottom change places."""
    return px.join(sizes(px), "image_id").select("image_id", (F.col("nrows") - 1 - F.col("y")).alias("y"), "x", "v")


def mirror_vertical(px: DataFrame) -> DataFrame:
    """Left and right change places."""
    return px.join(sizes(px), "image_id").select("image_id", "y", (F.col("ncols") - 1 - F.col("x")).alias("x"), "v")


def shear_row(px: DataFrame, row: int, distance: int) -> DataFrame:
    """Shifts one row to the right by ``distance`` (left if negative); its edge value fills."""
    line = px.where(F.col("y") == row)
    w = sizes(px)
    source = line.join(w, "image_id").select("image_id", "y", "x", F.least(F.greatest(F.col("x") - distance, F.lit(0)), F.col("ncols") - 1).alias("s"))
    moved = source.join(line.select("image_id", F.col("x").alias("s"), "v"), ["image_id", "s"]).select(*KEY, "v")
    return px.where(F.col("y") != row).unionByName(moved)


def transposed(px: DataFrame) -> DataFrame:
    return px.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def shear_column(px: DataFrame, column: int, distance: int) -> DataFrame:
    return transposed(shear_row(transposed(px), column, distance))


def resize(px: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Nearest-neighbour resize of every image: a target pixel takes the source pixel of its proportional place."""
    grid = sizes(px).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(nrows - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))))
    at = grid.select("image_id", "y", "x", F.floor(F.col("y") * F.col("nrows") / nrows).cast("int").alias("sy"), F.floor(F.col("x") * F.col("ncols") / ncols).cast("int").alias("sx"))
    return at.join(px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["image_id", "sy", "sx"]).select(*KEY, "v")


def scale(px: DataFrame, factor: float) -> DataFrame:
    """Nearest-neighbour resize of every image by a factor."""
    size = sizes(px).select("image_id", "nrows", "ncols", F.greatest(F.floor(F.col("nrows") * factor), F.lit(1)).alias("nr"), F.greatest(F.floor(F.col("ncols") * factor), F.lit(1)).alias("nc"))
    grid = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nr").cast("int") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nc").cast("int") - 1)))
    at = grid.select("image_id", "y", "x", F.floor(F.col("y") * F.col("nrows") / F.col("nr")).cast("int").alias("sy"), F.floor(F.col("x") * F.col("ncols") / F.col("nc")).cast("int").alias("sx"))
    return at.join(px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["image_id", "sy", "sx"]).select(*KEY, "v")


def histogram(px: DataFrame, levels: int = 256) -> DataFrame:
    """(image_id, v, share) for the values that occur; others of 0..levels-1 are 0."""
    n = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("image_id").agg(F.sum("n").alias("area")), "image_id").select("image_id", "v", (F.col("n") / F.col("area")).alias("share"))


def min_max_location(px: DataFrame, onebit: DataFrame | None = None) -> DataFrame:
    """Smallest and largest value and where; the last pixel in raster order wins ties. Only where the mask is black, if given."""
    if onebit is not None:
        px = px.join(onebit.where(F.col("v") > 0).select(*KEY), KEY, "left_semi")
    low = F.min(F.struct(F.col("v").alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    high = F.max(F.struct(F.col("v").alias("v"), F.col("y"), F.col("x")))
    out = px.groupBy("image_id").agg(low.alias("lo"), high.alias("hi"))
    return out.select("image_id", F.col("lo.v").alias("min_v"), (-F.col("lo.y")).alias("min_y"), (-F.col("lo.x")).alias("min_x"), F.col("hi.v").alias("max_v"), F.col("hi.y").alias("max_y"), F.col("hi.x").alias("max_x"))


def ccs_from_labeled_image(px: DataFrame) -> DataFrame:
    """(image_id, label, ulx, uly, lrx, lry, n) of every label above 0."""
    return px.where(F.col("v") > 0).groupBy("image_id", F.col("v").alias("label")).agg(F.min("x").alias("ulx"), F.min("y").alias("uly"), F.max("x").alias("lrx"), F.max("y").alias("lry"), F.count("*").alias("n"))


#: Colours that labels cycle through.
PALETTE = ((215, 25, 28), (253, 174, 97), (171, 217, 233), (44, 123, 182), (77, 175, 74), (152, 78, 163), (166, 86, 40), (247, 129, 191))


def color_ccs(px: DataFrame, ignore_unlabeled: bool = True) -> DataFrame:
    """RGB by label modulo the palette; white stays; label 1 is black if unlabelled pixels are ignored."""
    rgb = lambda c: F.struct(*[F.lit(x).alias(n) for n, x in zip("rgb", c, strict=True)])
    out = rgb((255, 255, 255))
    for k, c in enumerate(PALETTE):
        out = F.when((F.col("v") > 0) & (F.col("v") % len(PALETTE) == k), rgb(c)).otherwise(out)
    return px.withColumn("v", F.when(F.col("v") == 1, rgb((0, 0, 0))).otherwise(out) if ignore_unlabeled else out)
