"""Features of one-bit images: aggregations of pixels, runs and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.raster import sizes



def black(px: DataFrame) -> DataFrame:
    return px.where((F.col("v") > 0)).select("image_id", "y", "x")


def page_features(px: DataFrame) -> DataFrame:
    """black_area, area, volume, aspect_ratio, nrows, ncols of every image, in one aggregation."""
    out = px.groupBy("image_id").agg((F.max("y") + 1).alias("nrows"), (F.max("x") + 1).alias("ncols"), F.sum((F.col("v") > 0).cast("long")).alias("black_area"))
    area = F.col("nrows") * F.col("ncols")
    return out.select("image_id", "nrows", "ncols", "black_area", area.cast("long").alias("area"), (F.col("black_area") / area).alias("volume"), (F.col("ncols") / F.col("nrows")).alias("aspect_ratio"))


def moments(px: DataFrame) -> DataFrame:
    """The nine moments: both centres over (n - 1), then the central moments 20 02 11 30 12 21 03 over m00 to the power (p + q + 2) / 2.

    One aggregation of raw moments; central ones follow algebraically.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    raw = {(p, q): F.sum(F.when((F.col("v") > 0), F.pow(x, p) * F.pow(y, q)).otherwise(0.0)).alias(f"m{p}{q}") for p in range(4) for q in range(4) if p + q < 4}
    s = px.groupBy("image_id").agg((F.max("y") + 1).alias("nrows"), (F.max("x") + 1).alias("ncols"), *raw.values())
    m = {k: F.col(f"m{k[0]}{k[1]}") for k in raw}
    n = F.when(m[0, 0] == 0, 1.0).otherwise(m[0, 0])
    cx, cy = m[1, 0] / n, m[0, 1] / n
    mu = {
        "20": m[2, 0] - cx * m[1, 0],
        "02": m[0, 2] - cy * m[0, 1],
        "11": m[1, 1] - cy * m[1, 0],
        "30": m[3, 0] - 3 * cx * m[2, 0] + 2 * cx * cx * m[1, 0],
        "12": m[1, 2] - 2 * cy * m[1, 1] - cx * m[0, 2] + 2 * cy * cy * m[1, 0],
        "21": m[2, 1] - 2 * cx * m[1, 1] - cy * m[2, 0] + 2 * cx * cx * m[0, 1],
        "03": m[0, 3] - 3 * cy * m[0, 2] + 2 * cy * cy * m[0, 1],
    }
    centre = lambda c, size: F.when(size > 1, c / (size - 1)).otherwise(0.5)
    power = lambda k: F.pow(n, 2.0 if sum(map(int, k)) == 2 else 2.5)
    return s.select("image_id", centre(cx, F.col("ncols")).alias("cx"), centre(cy, F.col("nrows")).alias("cy"), *[(mu[k] / power(k)).alias(f"mu{k}") for k in mu])


def projection_rows(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "y").agg(F.sum((F.col("v") > 0).cast("long")).alias("n"))


def projection_cols(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "x").agg(F.sum((F.col("v") > 0).cast("long")).alias("n"))


def projections(px: DataFrame) -> DataFrame:
    """Both projections in one pass: (image_id, axis, at, n)."""
    both = px.groupingSets([["image_id", "y"], ["image_id", "x"]], "image_id", "y", "x").agg(F.sum((F.col("v") > 0).cast("long")).alias("n"))
    return both.select("image_id", F.when(F.col("y").isNotNull(), "row").otherwise("col").alias("axis"), F.coalesce("y", "x").alias("at"), "n")


def projection_skewed_cols(px: DataFrame, angles: list[float]) -> DataFrame:
    """(image_id, angle, at, n): column projections after a skew by each angle in degrees; bin 0 and what falls out are dropped."""
    a = black(px).join(sizes(px), "image_id").withColumn("angle", F.explode(F.array(*[F.lit(float(x)) for x in angles])))
    at = F.floor(F.col("x") * F.cos(F.radians("angle")) - F.col("y") * F.sin(F.radians("angle")) + 0.5).cast("int")
    return a.withColumn("at", at).where("at > 0 and at < ncols").groupBy("image_id", "angle", "at").agg(F.count("*").alias("n"))


def projection_skewed_rows(px: DataFrame, angles: list[float]) -> DataFrame:
    """Row projections likewise."""
    a = black(px).join(sizes(px), "image_id").withColumn("angle", F.explode(F.array(*[F.lit(float(x)) for x in angles])))
    at = F.floor(F.col("x") * F.sin(F.radians("angle")) + F.col("y") * F.cos(F.radians("angle")) + 0.5).cast("int")
    return a.withColumn("at", at).where("at > 0 and at < nrows").groupBy("image_id", "angle", "at").agg(F.count("*").alias("n"))


def rotation_angle_projections(px: DataFrame, low: float = -2.5, high: float = 2.5, step: float = 0.5) -> DataFrame:
    """(image_id, angle): the skew whose row projection is the most uneven, sum of squared differences of neighbours."""
    n = round((high - low) / step) + 1
    p = projection_skewed_rows(px, [low + k * step for k in range(n)])
    w = Window.partitionBy("image_id", "angle").orderBy("at")
    before = F.when(F.lag("at").over(w) == F.col("at") - 1, F.lag("n").over(w)).otherwise(0)
    s = p.withColumn("d", F.pow((F.col("n") - before).cast("double"), 2)).groupBy("image_id", "angle").agg(F.sum("d").alias("score"))
    return s.groupBy("image_id").agg(F.max_by("angle", F.struct("score", (-F.abs("angle")), "angle")).alias("angle"))


def islands(px: DataFrame, line: str, at: str) -> DataFrame:
    """px with b, whether a pixel is black, and island, the number of its run along its line."""
    w = Window.partitionBy("image_id", line).orderBy(at)
    island = px.withColumn("b", (F.col("v") > 0)).withColumn("new", (F.lag("b").over(w).isNull() | (F.lag("b").over(w) != F.col("b"))).cast("int"))
    return island.withColumn("island", F.sum("new").over(w))


def runs(px: DataFrame, direction: str = "horizontal") -> DataFrame:
    """(image_id, line, start, end, black): maximal runs of a colour along rows or columns."""
    line, at = ("y", "x") if direction == "horizontal" else ("x", "y")
    return islands(px, line, at).groupBy("image_id", F.col(line).alias("line"), "island", F.col("b").alias("black")).agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("island")


def run_histogram(px: DataFrame, color: str = "black", direction: str = "horizontal") -> DataFrame:
    """(image_id, length, n). Vertical runs that touch the bottom edge don't count."""
    r = runs(px, direction).where(F.col("black") == (color == "black"))
    if direction == "vertical":
        r = r.join(sizes(px), "image_id").where(F.col("end") < F.col("nrows") - 1)
    return r.groupBy("image_id", (F.col("end") - F.col("start") + 1).alias("length")).agg(F.count("*").alias("n"))


def most_frequent_run(px: DataFrame, color: str = "black", direction: str = "horizontal") -> DataFrame:
    """(image_id, length): the smallest of the most frequent lengths."""
    h = run_histogram(px, color, direction)
    return h.groupBy("image_id").agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("length"))


def most_frequent_runs(px: DataFrame, n: int, color: str = "black", direction: str = "horizontal") -> DataFrame:
    """The n most frequent (length, n) of each image, by falling count, then length; all for n < 0."""
    h = run_histogram(px, color, direction)
    if n < 0:
        return h
    w = Window.partitionBy("image_id").orderBy(F.desc("n"), "length")
    return h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def filter_runs(px: DataFrame, length: int, keep: str, color: str = "black", direction: str = "horizontal") -> DataFrame:
    """Turns runs of the colour shorter (keep="long") or longer (keep="short") than ``length`` to the other colour.

    Narrow and wide runs are horizontal, short and tall ones vertical.
    """
    line, at = ("y", "x") if direction == "horizontal" else ("x", "y")
    run = Window.partitionBy("image_id", line, "island")
    size = F.max(at).over(run) - F.min(at).over(run) + 1
    gone = (F.col("b") == (color == "black")) & (size < length if keep == "long" else size > length)
    other = 0 if color == "black" else 1
    return islands(px, line, at).select("image_id", "y", "x", F.when(gone, other).otherwise(F.col("v")).alias("v"))


def to_rle(px: DataFrame) -> DataFrame:
    """(image_id, rle): alternating white and black run lengths in raster order, white first, an even number of them."""
    w = Window.partitionBy("image_id").orderBy("y", "x")
    b = px.withColumn("b", (F.col("v") > 0)).withColumn("new", (F.lag("b").over(w).isNull() | (F.lag("b").over(w) != F.col("b"))).cast("int")).withColumn("run", F.sum("new").over(w))
    r = b.groupBy("image_id", "run", "b").agg(F.count("*").alias("n"))
    each = r.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("run", "b", "n"))).alias("runs"))
    lead = F.when(F.col("runs")[0]["b"], F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.element_at("runs", -1)["b"], F.array().cast("array<string>")).otherwise(F.array(F.lit("0")))
    return each.select("image_id", F.array_join(F.concat(lead, F.transform("runs", lambda s: s["n"].cast("string")), tail), " ").alias("rle"))


def from_rle(df: DataFrame, ncols: str = "ncols") -> DataFrame:
    """px from (image_id, rle, ncols); raises on anything but numbers."""
    parts = F.split(F.trim("rle"), r"\s+")
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\d+$"))
    n = df.select("image_id", ncols, F.posexplode(F.when(bad, F.raise_error(F.lit("run lengths must be numbers"))).otherwise(parts)).alias("k", "n"))
    w = Window.partitionBy("image_id").orderBy("k")
    n = n.withColumn("n", F.col("n").cast("int")).withColumn("end", F.sum("n").over(w)).where("n > 0")
    at = n.select("image_id", ncols, (F.col("k") % 2).cast("int").alias("v"), F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("at"))
    return at.select("image_id", F.floor(F.col("at") / F.col(ncols)).cast("int").alias("y"), (F.col("at") % F.col(ncols)).cast("int").alias("x"), "v")


def runlength_from_point(px: DataFrame, x: int, y: int, color: str, direction: str) -> DataFrame:
    """(image_id, n): pixels of the colour from a point towards top, bottom, left or right until it ends."""
    axis, line, sign = {"top": ("y", "x", -1), "bottom": ("y", "x", 1), "left": ("x", "y", -1), "right": ("x", "y", 1)}[direction]
    here, fixed = (y, x) if axis == "y" else (x, y)
    ray = px.where((F.col(line) == fixed) & ((F.col(axis) - here) * sign >= 0)).select("image_id", ((F.col(axis) - here) * sign).alias("d"), ((F.col("v") > 0) == (color == "black")).alias("same"))
    return ray.groupBy("image_id").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("d"))), F.max("d") + 1).alias("n"))


def contour(px: DataFrame, side: str) -> DataFrame:
    """(image_id, at, d): distance to the first black pixel; bottom and right count from 1; infinite where there is none."""
    line, at = ("x", "y") if side in ("top", "bottom") else ("y", "x")
    size = "nrows" if at == "y" else "ncols"
    far = F.max(F.when((F.col("v") > 0), F.col(at))) if side in ("bottom", "right") else F.min(F.when((F.col("v") > 0), F.col(at)))
    e = px.groupBy("image_id", F.col(line).alias("at")).agg(far.alias("e")).join(sizes(px), "image_id")
    d = F.col(size) - F.col("e") if side in ("bottom", "right") else F.col("e")
    return e.select("image_id", "at", F.coalesce(d.cast("double"), F.lit(float("inf"))).alias("d"))


def nholes(px: DataFrame) -> DataFrame:
    """(image_id, vertical, horizontal): white gaps between black pixels over columns and over rows, per column and row.

    The count runs on over the columns (rows): a column that ends in white takes one off only while the
    running count is above zero.
    """

    def holes(line: str, at: str) -> DataFrame:
        w = Window.partitionBy("image_id", line).orderBy(at)
        t = px.withColumn("b", (F.col("v") > 0)).withColumn("fall", ((~F.col("b")) & F.coalesce(F.lag("b").over(w), F.lit(False))).cast("int"))
        per = t.groupBy("image_id", line).agg(F.sum("fall").alias("falls"), F.max_by("b", at).alias("last"), F.max(F.col("b").cast("int")).alias("any"))
        cells = per.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), "falls", "last", "any"))).alias("lines"))
        total = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, s: acc + s["falls"] - F.when((~s["last"]) & (acc + s["falls"] > 0) & (s["any"] > 0), 1).otherwise(0))
        return cells.select("image_id", (total / F.size("lines")).alias("n"))

    return holes("x", "y").withColumnRenamed("n", "vertical").join(holes("y", "x").withColumnRenamed("n", "horizontal"), "image_id")


def top_bottom(px: DataFrame) -> DataFrame:
    """(image_id, top, bottom): first and last black row over the number of rows; (1, 0) if empty. Row 0 never counts as the last."""
    s = px.groupBy("image_id").agg((F.max("y") + 1).alias("nrows"), F.min(F.when((F.col("v") > 0), F.col("y"))).alias("t"), F.max(F.when((F.col("v") > 0) & (F.col("y") > 0), F.col("y"))).alias("b"))
    n = F.col("nrows")
    return s.select("image_id", F.coalesce(F.col("t") / n, F.lit(1.0)).alias("top"), F.when(F.col("t").isNull(), 0.0).otherwise(F.coalesce("b", F.lit(-1)) / n).alias("bottom"))


def region_volumes(px: DataFrame, k: int = 4) -> DataFrame:
    """(image_id, region, volume): share of black of a k x k grid, regions numbered by column, then row."""
    s = px.join(sizes(px), "image_id")
    i = F.least(F.floor(F.col("x") * k / F.col("ncols")), F.lit(k - 1)).cast("int")
    j = F.least(F.floor(F.col("y") * k / F.col("nrows")), F.lit(k - 1)).cast("int")
    return s.groupBy("image_id", (i * k + j).alias("region")).agg(F.avg((F.col("v") > 0).cast("double")).alias("volume"))


def shifted(px: DataFrame, dy: int, dx: int) -> DataFrame:
    return px.select("image_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))


def compactness(px: DataFrame) -> DataFrame:
    """(image_id, compactness): (pixels of the outline outside the shape, beyond the page too) / black area; the largest double if empty."""
    b = black(px)
    ring = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("d")
    grown = b.select("image_id", "y", "x", ring).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()
    n = grown.groupBy("image_id").agg(F.count("*").alias("grown"))
    out = px.groupBy("image_id").agg(F.sum((F.col("v") > 0).cast("long")).alias("area")).join(n, "image_id", "left")
    return out.select("image_id", F.when(F.col("area") == 0, F.lit(1.7976931348623157e308)).otherwise((F.col("grown") - F.col("area")) / F.col("area")).alias("compactness"))


def zernike_terms(n: int, m: int) -> list[tuple[float, int]]:
    from math import factorial as f

    return [((-1) ** s * f(n - s) / (f(s) * f((n + m) // 2 - s) * f((n - m) // 2 - s)), n - 2 * s) for s in range((n - m) // 2 + 1)]


ZERNIKE = [(n, m) for n in range(2, 7) for m in range(n % 2, n + 1, 2)]


def zernike_moments(px: DataFrame) -> DataFrame:
    """(image_id, z: 14 values): moduli of the Zernike moments of orders 2 to 6 of the black pixels."""
    b = black(px)
    c = b.groupBy("image_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("m00"))
    d = b.join(c, "image_id").withColumn("dx", F.col("x") - F.col("cx")).withColumn("dy", F.col("y") - F.col("cy")).withColumn("r", F.hypot("dx", "dy"))
    top = d.groupBy("image_id").agg((F.max("r") * 1.01).alias("top")).select("image_id", F.when(F.col("top") < 1e-5, 1.0).otherwise(F.col("top")).alias("top"))
    d = d.join(top, "image_id").withColumn("q", F.col("r") / F.col("top")).withColumn("t", F.atan2("dy", "dx"))

    def radial(n: int, m: int) -> Column:
        out = F.lit(0.0)
        for a, p in zernike_terms(n, m):
            out = out + a * F.pow("q", p)
        return out

    seen = F.col("r") >= 1e-5
    parts = [F.sum(F.when(seen, radial(n, m) * f(F.col("t") * m)).otherwise(0.0)).alias(f"{s}{n}{m}") for n, m in ZERNIKE for s, f in (("re", F.cos), ("im", F.sin))]
    sums = d.groupBy("image_id").agg(F.first("m00").alias("m00"), *parts)
    return sums.select("image_id", F.array(*[F.hypot(f"re{n}{m}", f"im{n}{m}") * (n + 1) / 3.141592653589793 / F.col("m00") for n, m in ZERNIKE]).alias("z"))
