"""Connected components, page layout and rectangles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.raster import by_image, from_image, sizes
from .features import runs
from .graph import SMALL, connected_components

BOX = ("ulx", "uly", "lrx", "lry")


#: Pixels up to which an image is labelled in one task.
LARGEST = 1 << 26


def cc_analysis(px: DataFrame, keep: Callable[[DataFrame, str], DataFrame], largest: int = LARGEST) -> DataFrame:
    """(image_id, y, x, v): 8-connected components, labelled by the place (y * columns + x) + 2 of their first pixel; white is 0.

    Components never leave an image, so each image is labelled by one vectorised pass over its runs; images of more
    than ``largest`` pixels by ``cc_of_large``.
    """
    from . import kernels

    label = lambda some: by_image(some, kernels.components, "long")
    big = keep(sizes(px).where(F.col("nrows").cast("long") * F.col("ncols") > largest).select("image_id"), "large")
    if big.isEmpty():
        return label(px)
    return label(px.join(big, "image_id", "left_anti")).unionByName(cc_of_large(px.join(big, "image_id", "left_semi"), keep).withColumn("v", F.col("v").cast("long")))


def cc_of_large(px: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``cc_analysis`` without an image in one task. Runs, not pixels, are the nodes: runs of neighbouring rows touch if they overlap by at most one column
    of slack. A row has few runs, so the join on (image, row) stays small.
    """
    r = runs(px).where("black").join(sizes(px), "image_id").select("image_id", F.col("line").alias("y"), "start", "end", (F.col("line").cast("long") * F.col("ncols") + F.col("start")).alias("place"))
    node = F.struct("image_id", "place")
    a = r.select("image_id", "y", "start", "end", node.alias("a"))
    b = r.select("image_id", (F.col("y") - 1).alias("y"), F.col("start").alias("s2"), F.col("end").alias("e2"), node.alias("b"))
    edges = a.join(b, ["image_id", "y"]).where("start <= e2 + 1 and s2 <= end + 1").select("a", "b")
    stars = connected_components(edges, keep, small=SMALL)
    own = r.select("image_id", "y", "start", "end", node.alias("node")).join(stars, "node", "left").select("image_id", "y", "start", "end", F.coalesce("root", "node").alias("root"))
    cells = own.select("image_id", "y", F.explode(F.sequence("start", "end")).alias("x"), (F.col("root.place") + 2).alias("v"))
    return px.select("image_id", "y", "x").join(cells, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def boxes(labelled: DataFrame) -> DataFrame:
    """(image_id, label, ulx, uly, lrx, lry, n) of labelled pixels."""
    return labelled.where("v > 0").groupBy("image_id", F.col("v").alias("label")).agg(F.min("x").alias("ulx"), F.min("y").alias("uly"), F.max("x").alias("lrx"), F.max("y").alias("lry"), F.count("*").alias("n"))


def despeckle(px: DataFrame, size: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Whitens components of fewer than ``size`` pixels."""
    cc = cc_analysis(px, keep)
    small = cc.where("v > 0").groupBy("image_id", "v").agg(F.count("*").alias("n")).where(F.col("n") < size).drop("n")
    return cc.join(small.withColumn("gone", F.lit(True)), ["image_id", "v"], "left").select("image_id", "y", "x", F.when(F.col("gone") | (F.col("v") == 0), 0).otherwise(1).alias("v"))


def split(px: DataFrame, axis: str = "x", centers: tuple[float, ...] = (0.5,), strongest: bool = False) -> DataFrame:
    """(image_id, label, ulx, uly, lrx, lry): components of each image cut near the centre fractions."""
    from . import kernels

    return from_image(px, lambda a: kernels.split(a, axis, centers, strongest), "label int, ulx int, uly int, lrx int, lry int")


def projection_cutting(px: DataFrame, tx: int = 0, ty: int = 0, noise: int = 0) -> DataFrame:
    from . import kernels

    return from_image(px, lambda a: kernels.projection_cutting(a, tx, ty, noise), "label int, ulx int, uly int, lrx int, lry int")


def runlength_smearing(px: DataFrame, cx: int, cy: int, csm: int) -> DataFrame:
    """Fills white runs of at most cx columns and cy rows, keeps what both fill, then fills rows by csm."""
    a, b = fill_white(px, cx, "horizontal"), fill_white(px, cy, "vertical")
    both = a.join(b.withColumnRenamed("v", "w"), ["image_id", "y", "x"]).select("image_id", "y", "x", ((F.col("v") > 0) & (F.col("w") > 0)).cast("int").alias("v"))
    return fill_white(both, csm, "horizontal")


def fill_white(px: DataFrame, most: int, direction: str) -> DataFrame:
    """Blackens white runs of at most ``most`` pixels that lie between black ones."""
    line, at = ("y", "x") if direction == "horizontal" else ("x", "y")
    before = Window.partitionBy("image_id", line).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("image_id", line).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    on = F.when(F.col("v") > 0, F.col(at))
    gap = F.first(on, ignorenulls=True).over(after) - F.last(on, ignorenulls=True).over(before) - 1
    return px.withColumn("v", F.when((F.col("v") > 0) | (gap <= most), 1).otherwise(0))


def cells_of(df: DataFrame, size: int, pad: int = 0) -> DataFrame:
    """df with a row for every grid cell that its box, grown by ``pad``, touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - pad) / size), F.floor((F.col(b) + pad) / size)))
    return df.withColumn("gx", span("ulx", "lrx")).withColumn("gy", span("uly", "lry"))


def rect_join(a: DataFrame, b: DataFrame, condition: Column, size: int = 100, pad: int = 0, on: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(..., a_id, b_id): pairs of boxes that meet a condition which only boxes less than ``pad`` apart can.

    Boxes are spread over grid cells and meet by an equi-join on the cell; a pair is kept in the first
    cell that both share, so it appears once.
    """
    left = cells_of(a, size, pad).select(*on, "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in ("id", *BOX)])
    right = cells_of(b, size).select(*on, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in ("id", *BOX)])
    first = (F.col("gx") == F.greatest(F.floor((F.col("a_ulx") - pad) / size), F.floor(F.col("b_ulx") / size))) & (F.col("gy") == F.greatest(F.floor((F.col("a_uly") - pad) / size), F.floor(F.col("b_uly") / size)))
    return left.join(right, [*on, "gx", "gy"]).where(first & condition).drop("gx", "gy")


def intersects(p: str = "a_", q: str = "b_") -> Column:
    c = lambda s, n: F.col(s + n)
    return (c(p, "ulx") <= c(q, "lrx")) & (c(q, "ulx") <= c(p, "lrx")) & (c(p, "uly") <= c(q, "lry")) & (c(q, "uly") <= c(p, "lry"))


def contains(p: str = "a_", q: str = "b_") -> Column:
    c = lambda s, n: F.col(s + n)
    return (c(p, "ulx") <= c(q, "ulx")) & (c(q, "lrx") <= c(p, "lrx")) & (c(p, "uly") <= c(q, "uly")) & (c(q, "lry") <= c(p, "lry"))


def expanded(df: DataFrame, n: int) -> DataFrame:
    """Boxes grown by n to the upper left, not below 0, and by n + 1 to the lower right."""
    return df.withColumns({"ulx": F.greatest(F.col("ulx") - n, F.lit(0)), "uly": F.greatest(F.col("uly") - n, F.lit(0)), "lrx": F.col("lrx") + n + 1, "lry": F.col("lry") + n + 1})


def union_rects(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min("ulx").alias("ulx"), F.min("uly").alias("uly"), F.max("lrx").alias("lrx"), F.max("lry").alias("lry"))


def intersection(p: str = "a_", q: str = "b_") -> list[Column]:
    """The common box, possibly empty (upper left beyond lower right)."""
    return [F.greatest(p + "ulx", q + "ulx").alias("ulx"), F.greatest(p + "uly", q + "uly").alias("uly"), F.least(p + "lrx", q + "lrx").alias("lrx"), F.least(p + "lry", q + "lry").alias("lry")]


def center(p: str, axis: str) -> Column:
    return F.floor((F.col(f"{p}ul{axis}") + F.col(f"{p}lr{axis}")) / 2)


def distance_euclid(p: str = "a_", q: str = "b_") -> Column:
    return F.hypot(center(p, "x") - center(q, "x"), center(p, "y") - center(q, "y"))


def distance_cx(p: str = "a_", q: str = "b_") -> Column:
    return F.abs(center(p, "x") - center(q, "x"))


def distance_cy(p: str = "a_", q: str = "b_") -> Column:
    return F.abs(center(p, "y") - center(q, "y"))


def distance_bb(p: str = "a_", q: str = "b_") -> Column:
    """Hypotenuse of the smallest gap between any two edges on each axis."""
    gap = lambda axis: F.least(*[F.abs(F.col(f"{p}{i}{axis}") - F.col(f"{q}{j}{axis}")) for i in ("ul", "lr") for j in ("ul", "lr")])
    return F.hypot(gap("x"), gap("y"))


def bbox_merging(ccs: DataFrame, ex: int, ey: int, keep: Callable[[DataFrame, str], DataFrame], iterations: int = 2) -> DataFrame:
    """(image_id, id, ulx, uly, lrx, lry): boxes grown by ex, ey and merged while they touch, ``iterations`` times.

    A merged box takes the smallest id of its members.
    """
    now = ccs.select("image_id", "id", *BOX)
    for _ in range(iterations):
        grown = now.withColumns({"ulx": F.greatest(F.col("ulx") - ex, F.lit(0)), "uly": F.greatest(F.col("uly") - ey, F.lit(0)), "lrx": F.col("lrx") + ex, "lry": F.col("lry") + ey})
        pairs = rect_join(grown, grown, (F.col("a_id") < F.col("b_id")) & intersects())
        node = lambda c: F.struct("image_id", F.col(c).alias("id"))
        stars = connected_components(pairs.select(node("a_id").alias("a"), node("b_id").alias("b")), keep, small=SMALL)
        member = now.withColumn("node", F.struct("image_id", "id")).join(stars, "node", "left").withColumn("id", F.coalesce("root.id", "id"))
        now = keep(union_rects(member, "image_id", "id"), "boxes")
    return now


def sub_cc_analysis(labelled: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(image_id, segment, label, box): components inside each segment (label) of an image."""
    parts = labelled.where("v > 0").select("image_id", F.col("v").alias("segment"), "y", "x")
    as_images = parts.select(F.xxhash64("image_id", "segment").alias("image_id"), "y", "x", F.lit(1).alias("v"))
    found = boxes(cc_analysis(as_images, keep))
    return found.join(parts.select(F.xxhash64("image_id", "segment").alias("k"), F.col("image_id").alias("page"), "segment").distinct(), F.col("image_id") == F.col("k")).select(F.col("page").alias("image_id"), "segment", "label", *BOX, "n")


def segmentation_error(truth: DataFrame, found: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(image_id, correct, missed, extra, split, merged, both): classes of overlapping segments by their numbers of members."""
    both = truth.withColumnRenamed("v", "g").join(found.withColumnRenamed("v", "s"), ["image_id", "y", "x"])
    hits = both.where("g > 0 and s > 0").select("image_id", "g", "s").distinct()
    node = lambda side, c: F.struct("image_id", F.lit(side).alias("side"), F.col(c).cast("long").alias("label"))
    stars = connected_components(hits.select(node(0, "g").alias("a"), node(1, "s").alias("b")), keep, small=SMALL)
    nodes = both.where("g > 0").select(node(0, "g").alias("node")).unionByName(both.where("s > 0").select(node(1, "s").alias("node"))).distinct()
    of = nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    n = of.groupBy("root").agg(F.sum((F.col("node.side") == 0).cast("int")).alias("g"), F.sum((F.col("node.side") == 1).cast("int")).alias("s"))
    kinds = {"correct": "g = 1 and s = 1", "missed": "g = 1 and s = 0", "extra": "g = 0 and s = 1", "split": "g = 1 and s > 1", "merged": "g > 1 and s = 1", "both": "g > 1 and s > 1"}
    return n.groupBy(F.col("root.image_id").alias("image_id")).agg(*[F.sum(F.expr(f"cast({c} as int)")).alias(k) for k, c in kinds.items()])


def labeled_region_neighbors(px: DataFrame, eight: bool = True) -> DataFrame:
    """(image_id, a, b): unordered pairs of labels that touch; diagonally only towards the lower right."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    n = px.withColumn("r", F.lead("v").over(row))
    col = Window.partitionBy("image_id", "x").orderBy("y")
    n = n.withColumn("b", F.lead("v").over(col)).withColumn("d", F.lead("r").over(col))
    near = F.explode(F.array(*[F.col(c) for c in ("r", "b", *(["d"] if eight else []))])).alias("w")
    pairs = n.select("image_id", "v", near).where("w is not null and v <> w and v > 0 and w > 0")
    return pairs.select("image_id", F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def textline_reading_order(lines: DataFrame) -> DataFrame:
    """(image_id, id, place): a line comes before one it overlaps in x and lies above, or else lies left of with no line between."""

    import pandas as pd

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["id", *BOX]].itertuples(index=False, name=None), key=lambda r: (r[2], r[1], r[0]))
        n = len(rows)

        def overlap(a, b) -> bool:
            return a[1] <= b[3] and b[1] <= a[3]

        def before(a, b) -> bool:
            if overlap(a, b):
                return a[2] < b[2]
            return a[3] < b[1] and not any(c not in (a, b) and c[2] >= min(a[2], b[2]) and c[4] <= max(a[4], b[4]) and overlap(c, a) and overlap(c, b) for c in rows)

        after = {i: [j for j in range(n) if i != j and before(rows[i], rows[j])] for i in range(n)}
        seen: set[int] = set()
        out: list[int] = []
        for start in reversed(range(n)):  # depth-first by y; finished lines are put in front
            todo = [(start, iter(sorted(after[start], reverse=True)))] if start not in seen else []
            seen.add(start)
            while todo:
                at, rest = todo[-1]
                nxt = next((j for j in rest if j not in seen), None)
                if nxt is None:
                    out.insert(0, at)
                    todo.pop()
                else:
                    seen.add(nxt)
                    todo.append((nxt, iter(sorted(after[nxt], reverse=True))))
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]] * n, "id": [rows[i][0] for i in out], "place": range(n)})

    return lines.groupBy("image_id").applyInPandas(order, "image_id long, id long, place int")


def kise_block_extraction(ccs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], ta: float = 40.0, fr: float = 0.34) -> DataFrame:
    """(image_id, id, root): components joined over edges of nearest neighbours that are short for the page.

    An edge of length d between boxes of areas A stays if d / t <= 1 or fr d / t + ratio / ta <= 1, with t the
    page's median nearest gap and ratio the larger area over the smaller.
    """
    pairs = rect_join(ccs, ccs, F.col("a_id") < F.col("b_id"), size=64, pad=32)
    area = lambda p: (F.col(p + "lrx") - F.col(p + "ulx") + 1) * (F.col(p + "lry") - F.col(p + "uly") + 1)
    gap = lambda axis: F.greatest(F.lit(0), F.col(f"a_ul{axis}") - F.col(f"b_lr{axis}"), F.col(f"b_ul{axis}") - F.col(f"a_lr{axis}"))
    e = pairs.select("image_id", "a_id", "b_id", F.hypot(gap("x"), gap("y")).alias("d"), (F.greatest(area("a_"), area("b_")) / F.least(area("a_"), area("b_"))).alias("ratio"))
    both = e.select("image_id", F.col("a_id").alias("id"), "d").unionByName(e.select("image_id", F.col("b_id").alias("id"), "d"))
    t = both.groupBy("image_id", "id").agg(F.min("d").alias("d")).groupBy("image_id").agg(F.greatest(F.expr("percentile(d, 0.5)"), F.lit(1.0)).alias("t"))
    kept = e.join(t, "image_id").where((F.col("d") <= F.col("t")) | (fr * F.col("d") / F.col("t") + F.col("ratio") / ta <= 1))
    node = lambda c: F.struct("image_id", F.col(c).alias("id"))
    stars = connected_components(kept.select(node("a_id").alias("a"), node("b_id").alias("b")), keep, small=SMALL)
    own = ccs.select("image_id", "id").withColumn("node", F.struct("image_id", "id"))
    return own.join(stars, "node", "left").select("image_id", "id", F.coalesce("root.id", "id").alias("root"))


def graph_color_ccs(labelled: DataFrame, keep: Callable[[DataFrame, str], DataFrame], colors: int = 6) -> DataFrame:
    """(image_id, y, x, v): components coloured from 1 so that neighbours in the area Voronoi diagram differ; white stays 0."""
    from ..sources.raster import by_image
    from . import kernels
    from .graph import colorize

    # labels become small numbers within their image before the rasters are grown
    n = Window.partitionBy("image_id").orderBy("v")
    numbers = labelled.where("v > 0").select("image_id", "v").distinct().withColumn("n", F.row_number().over(n))
    small = labelled.join(numbers, ["image_id", "v"], "left").select("image_id", "y", "x", F.coalesce("n", F.lit(0)).cast("int").alias("v"))
    pairs = labeled_region_neighbors(by_image(small, kernels.voronoi_from_labeled_image))
    node = lambda c: F.struct("image_id", F.col(c).cast("long").alias("n"))
    edges = pairs.select(node("a").alias("src"), node("b").alias("dst"))
    found = colorize(numbers.select(node("n").alias("id")), edges, keep, colors)
    of = found.select("id.image_id", F.col("id.n").cast("int").alias("v"), (F.col("color") + 1).alias("c"))
    return small.join(of, ["image_id", "v"], "left").select("image_id", "y", "x", F.coalesce("c", F.lit(0)).alias("v"))


def section_stats(glyphs: DataFrame) -> DataFrame:
    """(image_id, section, n, mean and deviation of the glyphs' widths and heights)."""
    w, h = F.col("lrx") - F.col("ulx") + 1, F.col("lry") - F.col("uly") + 1
    return glyphs.groupBy("image_id", "section").agg(F.count("*").alias("n"), F.avg(w).alias("width"), F.stddev_samp(w).alias("width_sd"), F.avg(h).alias("height"), F.stddev_samp(h).alias("height_sd"))
