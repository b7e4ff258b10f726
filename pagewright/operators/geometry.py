"""Points, lines, templates and glyph pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.raster import by_image, from_image
from . import kernels
from .blocks import nearest_rows


def k_nearest_points(query: DataFrame, points: DataFrame, k: int, kind: int = 2, weights: list[float] | None = None, where: Column | None = None) -> DataFrame:
    """(q, t, d, rank): nearest points by L-infinity (0), L1 (1) or squared L2 (2), each coordinate times its weight; only points that meet ``where``.

    query(id, p), points(id, p) with p an array of doubles; ties go to the smaller id.
    """
    own = query.select("id", F.col("p").alias("features"))
    others = (points if where is None else points.where(where)).select("id", F.lit("").alias("class"), F.col("p").alias("features"))
    names = ("chebyshev", "city_block", "fast_euclidean")
    return nearest_rows(own, others, k, names[kind], False, [list(map(float, weights))] if weights else None).select("q", "t", "d", "rank")


def convex_hulls(points: DataFrame) -> DataFrame:
    """(image_id, place, x, y): hull corners of each image's points (x, y)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = kernels.convex_hull(list(zip(pdf["x"].astype(float), pdf["y"].astype(float), strict=True)))
        return pd.DataFrame([(pdf["image_id"].iloc[0], i, *p) for i, p in enumerate(h)], columns=["image_id", "place", "x", "y"])

    # interior points can't be corners: per row only the outermost two are sent
    ends = points.groupBy("image_id", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("image_id", "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    return ends.groupBy("image_id").applyInPandas(run, "image_id long, place int, x double, y double")


def convex_hull_as_image(px: DataFrame, filled: bool = False) -> DataFrame:
    return by_image(px, lambda a: kernels.convex_hull_as_image(a, filled))


def max_empty_rect(px: DataFrame) -> DataFrame:
    return from_image(px, kernels.max_empty_rect, "ulx int, uly int, lrx int, lry int")


def contour_points(px: DataFrame) -> DataFrame:
    """(image_id, place, y, x) of the border walk."""
    return from_image(px, lambda a: [(i, *p) for i, p in enumerate(kernels.contour_pavlidis(a))], "place int, y int, x int")


def delaunay_pairs(points: DataFrame) -> DataFrame:
    """(image_id, a, b): pairs of different labels joined by a Delaunay edge of points (image_id, label, x, y)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.drop_duplicates(["x", "y"])
        lab = p["label"].tolist()
        e = {(min(lab[i], lab[j]), max(lab[i], lab[j])) for i, j in kernels.delaunay(list(zip(p["x"], p["y"], strict=True))) if lab[i] != lab[j]}
        return pd.DataFrame([(pdf["image_id"].iloc[0], a, b) for a, b in sorted(e)], columns=["image_id", "a", "b"])

    return points.groupBy("image_id").applyInPandas(run, "image_id long, a long, b long")


def voronoi_from_points(px: DataFrame, points: DataFrame) -> DataFrame:
    """White pixels take the label of the nearest of an image's points (image_id, label, x, y); ties go to the smaller label."""
    near = px.where("v = 0").select("image_id", "y", "x").join(points.select("image_id", "label", F.col("x").alias("px"), F.col("y").alias("py")), "image_id")
    d = F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0))
    best = near.groupBy("image_id", "y", "x").agg(F.min_by("label", F.struct(d.alias("d"), "label")).alias("label"))
    return px.join(best, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.when(F.col("v") > 0, F.col("v")).otherwise(F.coalesce("label", F.col("v"))).alias("v"))


def hough_lines(points: DataFrame, theta_min: float, theta_step: float, n_theta: int, rho_step: float = 1.0, most: int = 10, above: int = 2) -> DataFrame:
    """(image_id, theta, rho, votes): local maxima of the accumulator within 2 cells, at most ``most`` an image, by falling votes.

    Angles in degrees; rho = x cos + y sin.
    """
    from pyspark.sql import Window

    v = points.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1))))
    theta = F.radians(F.lit(theta_min) + F.col("t") * theta_step)
    acc = v.select("image_id", "t", F.floor((F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta)) / rho_step + 0.5).alias("r")).groupBy("image_id", "t", "r").agg(F.count("*").alias("votes"))
    # the maximum over 5 x 5 cells is that over 5 of r, found at empty cells too, then over 5 of t
    near = acc.withColumn("d", F.explode(F.sequence(F.lit(-2), F.lit(2)))).groupBy("image_id", "t", (F.col("r") + F.col("d")).alias("r")).agg(F.max("votes").alias("top"), F.max(F.when(F.col("d") == 0, F.col("votes"))).alias("votes"))
    top = F.max("top").over(Window.partitionBy("image_id", "r").orderBy("t").rangeBetween(-2, 2))
    peaks = near.withColumn("top", top).where((F.col("votes") >= F.col("top")) & (F.col("votes") > above))
    w = Window.partitionBy("image_id").orderBy(F.desc("votes"), "t", "r")
    out = peaks.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return out.select("image_id", (F.lit(theta_min) + F.col("t") * theta_step).alias("theta"), (F.col("r") * rho_step).alias("rho"), "votes")


# --- structure -------------------------------------------------------------------------------------


def polar_distance(p: str = "a_", q: str = "b_") -> list[Column]:
    """r over the mean diagonal, angle q and r between the centres of two boxes."""
    cx = lambda s: (F.col(s + "ulx") + F.col(s + "lrx")) / 2
    cy = lambda s: (F.col(s + "uly") + F.col(s + "lry")) / 2
    x, y = cx(q) - cx(p), cy(q) - cy(p)
    r = F.hypot(x, y)
    diagonal = lambda s: F.hypot(F.col(s + "lrx") - F.col(s + "ulx") + 1, F.col(s + "lry") - F.col(s + "uly") + 1)
    angle = F.when(x == 0, math.pi / 2).otherwise(F.atan(y / x)) + F.when(y > 0, math.pi).otherwise(0.0)
    return [(r / ((diagonal(p) + diagonal(q)) / 2)).alias("share"), angle.alias("angle"), r.alias("r")]


def polar_match(r1: Column, q1: Column, r2: Column, q2: Column) -> Column:
    """Angles within 30 degrees and ratio of distances below 1.6."""
    d = F.abs(q1 - q2)
    return (F.least(d, 2 * math.pi - d) < math.pi / 6) & (F.greatest(r1, r2) / F.greatest(F.least(r1, r2), F.lit(1e-12)) < 1.6)


def least_squares_fit(points: DataFrame) -> DataFrame:
    """(image_id, b, a): y = b x + a. A single point gives slope 0 and its x as offset."""
    one = F.count("*") == 1
    return points.groupBy("image_id").agg(
        F.when(one, 0.0).otherwise(F.regr_slope(F.col("y").cast("double"), F.col("x").cast("double"))).alias("b"),
        F.when(one, F.max("x").cast("double")).otherwise(F.regr_intercept(F.col("y").cast("double"), F.col("x").cast("double"))).alias("a"),
    )


def least_squares_fit_xy(points: DataFrame) -> DataFrame:
    """(image_id, b, a, x_of_y): axes change places where points extend at least as far in y as in x."""
    tall = (F.max("y") - F.min("y")) >= (F.max("x") - F.min("x"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return points.groupBy("image_id").agg(F.when(tall, F.regr_slope(x, y)).otherwise(F.regr_slope(y, x)).alias("b"), F.when(tall, F.regr_intercept(x, y)).otherwise(F.regr_intercept(y, x)).alias("a"), tall.cast("int").alias("x_of_y"))


def edit_distance(a: str, b: str) -> Column:
    return F.levenshtein(a, b)


def bounding_box_grouping(threshold: float) -> Column:
    """b touches a grown by the rounded threshold (one more on the lower right)."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    t = math.floor(threshold + 0.5)
    c = F.col
    return (c("b_ulx") <= c("a_lrx") + t + 1) & (F.greatest(c("a_ulx") - t, F.lit(0)) <= c("b_lrx")) & (c("b_uly") <= c("a_lry") + t + 1) & (F.greatest(c("a_uly") - t, F.lit(0)) <= c("b_lry"))


def shaped_grouping(labelled: DataFrame, threshold: float) -> DataFrame:
    """(image_id, a, b): labels with black pixels at most the threshold apart; pixels meet by grid cells of its size."""
    size = max(1, math.ceil(threshold))
    p = labelled.where("v > 0").select("image_id", "y", "x", "v", F.floor(F.col("y") / size).alias("gy"), F.floor(F.col("x") / size).alias("gx"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("y"), F.lit(j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    q = p.withColumn("d", near).select("image_id", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("v").alias("w"), (F.col("gy") + F.col("d.y")).alias("gy"), (F.col("gx") + F.col("d.x")).alias("gx"))
    close = F.pow(F.col("y") - F.col("y2"), F.lit(2.0)) + F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) <= threshold**2
    return p.join(q, ["image_id", "gy", "gx"]).where((F.col("v") < F.col("w")) & close).select("image_id", F.col("v").alias("a"), F.col("w").alias("b")).distinct()


# --- templates -------------------------------------------------------------------------------------


def template_pairs(px: DataFrame, template: list[list[int]], y0: int, x0: int) -> DataFrame:
    """(image_id, v, t): image pixels under the template placed at (y0, x0), with the template's value."""
    cells = [(y, x, int(c > 0)) for y, row in enumerate(template) for x, c in enumerate(row)]
    t = F.array(*[F.lit(c) for _, _, c in cells])
    w = len(template[0])
    inside = px.where(F.col("y").between(y0, y0 + len(template) - 1) & F.col("x").between(x0, x0 + w - 1))
    return inside.select("image_id", "v", F.element_at(t, ((F.col("y") - y0) * w + F.col("x") - x0 + 1).cast("int")).alias("t"))


def corelation_weighted(px: DataFrame, template: list[list[int]], y0: int, x0: int, bb: float, bw: float, wb: float, ww: float) -> DataFrame:
    """(image_id, score): weights by template and image colour, over the template's number of black pixels."""
    n = sum(int(c > 0) for row in template for c in row)
    p = template_pairs(px, template, y0, x0)
    score = F.when(F.col("t") == 1, F.when(F.col("v") > 0, bb).otherwise(bw)).otherwise(F.when(F.col("v") > 0, wb).otherwise(ww))
    return p.groupBy("image_id").agg((F.sum(score) / n).alias("score"))


def corelation_sum(px: DataFrame, template: list[list[int]], y0: int, x0: int, squares: bool = False) -> DataFrame:
    """(image_id, score): absolute or squared differences; the plain sum reads the image at the template's own coordinates."""
    n = sum(int(c > 0) for row in template for c in row)
    p = template_pairs(px, template, y0 if squares else 0, x0 if squares else 0)
    d = F.abs((F.col("v") > 0).cast("int") - F.col("t"))
    return p.groupBy("image_id").agg((F.sum(d * d if squares else d) / n).alias("score"))
