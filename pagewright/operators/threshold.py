"""Binarisation: global thresholds from histograms, local ones from separable window sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.raster import at_pixels
from .neighborhood import box, convolved, min_max_filter, places

KEY = ["image_id", "y", "x"]


def threshold(px: DataFrame, t) -> DataFrame:
    """Black where v is not above t; t is a number or a relation (image_id, t)."""
    if isinstance(t, DataFrame):
        return px.join(t, "image_id").select(*KEY, (F.col("v") <= F.col("t")).cast("int").alias("v"))
    return px.withColumn("v", (F.col("v") <= t).cast("int"))


def counts(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def otsu_find_threshold(px: DataFrame) -> DataFrame:
    """(image_id, t): the first value that maximises the between-class variance; 127 where nothing does."""
    h = counts(px)
    up = Window.partitionBy("image_id").orderBy("v")
    of = Window.partitionBy("image_id")
    h = h.withColumn("w", F.sum("n").over(up)).withColumn("m", F.sum(F.col("v") * F.col("n")).over(up)).withColumn("nt", F.sum("n").over(of)).withColumn("mt", F.sum(F.col("v") * F.col("n")).over(of))
    # sums of whole numbers: equal criteria compare as equal
    spread = (F.col("mt") * F.col("w") - F.col("m") * F.col("nt")).cast("double")
    score = F.when(F.col("w") < F.col("nt"), spread * spread / (F.col("w").cast("double") * (F.col("nt") - F.col("w"))))
    best = h.withColumn("s", score).groupBy("image_id").agg(F.max_by("v", F.when(F.col("s") > 0, F.struct("s", -F.col("v")))).alias("t"))
    return best.select("image_id", F.coalesce("t", F.lit(127)).cast("int").alias("t"))


def otsu_threshold(px: DataFrame) -> DataFrame:
    return threshold(px, otsu_find_threshold(px))


def tsai_find_threshold(px: DataFrame) -> DataFrame:
    """(image_id, t): the first value up to which more than the share p0 lies that keeps three moments."""
    h = counts(px)
    x = F.col("v").cast("double")
    m = h.groupBy("image_id").agg(F.sum("n").alias("nt"), *[(F.sum(F.pow(x, k) * F.col("n")) / F.sum("n")).alias(f"m{k}") for k in (1, 2, 3)])
    m1, m2, m3 = (F.col(f"m{k}") for k in (1, 2, 3))
    cd = m2 - m1 * m1
    c0, c1 = (-m2 * m2 + m1 * m3) / cd, (-m3 + m2 * m1) / cd
    root = F.sqrt(c1 * c1 - 4 * c0)
    p0 = (0.5 * (-c1 + root) - m1) / root
    up = Window.partitionBy("image_id").orderBy("v")
    cum = h.withColumn("cum", F.sum("n").over(up)).join(m.select("image_id", "nt", F.when(cd > 0, p0).alias("p0")), "image_id")
    return cum.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("cum") > F.col("p0") * F.col("nt"), F.col("v"))), F.lit(256)).cast("int").alias("t"))


def tsai_threshold(px: DataFrame) -> DataFrame:
    """A threshold of 255 counts as 0."""
    t = tsai_find_threshold(px)
    return threshold(px, t.select("image_id", F.when(F.col("t") == 255, 0).otherwise(F.col("t")).alias("t")))


def brink_find_threshold(px: DataFrame) -> DataFrame:
    """(image_id, t): minimum cross entropy over the 256-bin histogram, one more than the first minimum."""
    h = counts(px)
    n = h.groupBy("image_id").agg(F.sum("n").alias("nt"))
    bins = n.select("image_id", "nt", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v")).join(h, ["image_id", "v"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.col("nt"))
    up = Window.partitionBy("image_id").orderBy("v")
    bins = bins.withColumn("mf", F.sum(F.col("v") * F.col("p")).over(up)).withColumn("mb", F.sum(F.col("v") * F.col("p")).over(Window.partitionBy("image_id")) - F.col("mf"))
    t = bins.select("image_id", F.col("v").alias("t"), "mf", "mb")
    own = bins.where((F.col("p") > 0) & (F.col("v") > 0)).select("image_id", F.col("v").alias("i"), "p")
    m = F.when(F.col("i") <= F.col("t"), F.col("mf")).otherwise(F.col("mb"))
    term = F.col("p") * (m * F.log(m / F.col("i")) + F.col("i") * F.log(F.col("i") / m))
    pairs = t.where("mf > 1e-12 and mb > 1e-12").join(own, "image_id")  # 256 x 256 an image
    score = pairs.groupBy("image_id", "t").agg(F.sum(term).alias("s"))
    best = score.groupBy("image_id").agg(F.min_by("t", F.struct(F.round("s", 9), "t")).alias("t"))
    return n.join(best, "image_id", "left").select("image_id", (F.coalesce("t", F.lit(0)) + 1).cast("int").alias("t"))


def brink_threshold(px: DataFrame) -> DataFrame:
    return threshold(px, brink_find_threshold(px))


def entropy_split(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where both arrays lie at or below the pair of values that maximises the two-dimensional entropy; everywhere if no pair does."""
    vs, i = np.unique(v, return_inverse=True)
    ms, j = np.unique(m, return_inverse=True)
    p = np.bincount(i * len(ms) + j, minlength=len(vs) * len(ms)).reshape(len(vs), len(ms)) / len(v)
    h = -p * np.log(np.where(p > 0, p, 1))
    # cumulative over both axes on the grid of values that occur
    p, h = (c.cumsum(axis=1).cumsum(axis=0) for c in (p, h))
    ok = (p > 1e-6) & (p < 1 - 1e-6)
    if not ok.any():
        return np.ones(len(v), dtype=bool)
    q = np.where(ok, p, 0.5)
    s = np.where(ok, np.round(np.log(q * (1 - q)) + h / q + (h.max() - h) / (1 - q), 9), -np.inf)
    a, b = np.unravel_index(np.argmax(s), s.shape)  # the first in order of v, then m
    return (i <= a) & (j <= b)


def abutaleb_threshold(px: DataFrame) -> DataFrame:
    """Black where both a pixel and its 3 x 3 mean are low, at the pair that maximises the two-dimensional entropy."""

    def split(a: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        ones = [[1.0] * 3] * 3
        s, n = (convolved(x, there, ones, "none") for x in (a, there))
        out = np.zeros(a.shape, dtype=bool)
        out[there] = entropy_split(a[there], np.floor(s[there] / n[there] + 0.5).astype(int))
        return [out]

    return at_pixels(px, split, {"v": "int"})


def bernsen_threshold(px: DataFrame, region: int = 5, contrast: int = 15, doubt_to_black: bool = False) -> DataFrame:
    """Local mid-range over the window [-h, h); offsets that leave the image are mirrored at the pixel."""
    h = region // 2
    steps = range(-h, h) if h else (0, -1)

    def ends(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minima of lo and maxima of hi along the rows."""
        at = np.arange(lo.shape[1])
        near = [np.where((at + d < 0) | (at + d >= len(at)), at - d, at + d) for d in steps]
        near = [places(c, len(at), "none") for c in near]
        lo, hi = np.pad(lo, ((0, 0), (0, 1)), constant_values=np.inf), np.pad(hi, ((0, 0), (0, 1)), constant_values=-np.inf)
        return np.min([lo[:, c] for c in near], axis=0), np.max([hi[:, c] for c in near], axis=0)

    def split(a: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        # mirrored rows first, then columns: minima and maxima are separable
        lo, hi = ends(np.where(there, a, np.inf), np.where(there, a, -np.inf))
        lo, hi = (x.T for x in ends(np.where(there, lo, np.inf).T, np.where(there, hi, -np.inf).T))
        lo, hi = np.where(there, lo, 0), np.where(there, hi, 0)
        return [np.where(hi - lo < contrast, int(doubt_to_black), a < np.floor((hi + lo) / 2))]

    return at_pixels(px, split, {"v": "int"})


def local_statistics(px: DataFrame, region: int) -> DataFrame:
    """px with the window's mean and population variance; windows are clipped at the borders."""
    s = box(px, region // 2)
    mean = F.col("s") / F.col("c")
    return s.select(*KEY, "v", mean.alias("mean"), F.greatest(F.col("q") / F.col("c") - mean * mean, F.lit(0.0)).alias("var"))


def mean_filter(px: DataFrame, region: int = 5) -> DataFrame:
    return local_statistics(px, region).select(*KEY, F.col("mean").alias("v"))


def variance_filter(px: DataFrame, region: int = 5) -> DataFrame:
    return local_statistics(px, region).select(*KEY, F.col("var").alias("v"))


def wiener_filter(px: DataFrame, region: int = 5, noise: float = -1.0) -> DataFrame:
    """Adaptive denoising; a negative noise variance is taken as the lower median of the local variances."""
    s = local_statistics(px, region)
    if noise < 0:
        mid = Window.partitionBy("image_id").orderBy("var", "y", "x")
        ranked = s.withColumn("k", F.row_number().over(mid) - 1).withColumn("area", F.count("*").over(Window.partitionBy("image_id")))
        n = ranked.where(F.col("k") == F.floor((F.col("area") - 1) / 2)).select("image_id", F.col("var").alias("noise"))
        s = s.join(n, "image_id")
    else:
        s = s.withColumn("noise", F.lit(noise))
    flat = F.col("mean")
    kept = F.col("mean") + (F.col("var") - F.col("noise")) * (F.col("v") - F.col("mean")) / F.col("var")
    return s.select(*KEY, F.when(F.col("var") < F.col("noise"), flat).when(F.col("var") == 0, flat).otherwise(kept).alias("v"))


def image_mean(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.sum("v") / F.count("*")).alias("mean"))


def image_variance(px: DataFrame) -> DataFrame:
    x = F.col("v").cast("double")
    return px.groupBy("image_id").agg((F.sum(x * x) / F.count("*") - F.pow(F.sum(x) / F.count("*"), 2)).alias("variance"))


def bounded(white: Column, lower: int, upper: int) -> Column:
    return F.when(F.col("v") < lower, 1).when(F.col("v") >= upper, 0).otherwise((~white).cast("int")).cast("int")


def niblack_threshold(px: DataFrame, region: int = 15, sensitivity: float = -0.2, lower: int = 20, upper: int = 150) -> DataFrame:
    s = local_statistics(px, region)
    return s.select(*KEY, bounded(F.col("v") > F.col("mean") + sensitivity * F.sqrt("var"), lower, upper).alias("v"))


def sauvola_threshold(px: DataFrame, region: int = 15, sensitivity: float = 0.5, dynamic: int = 128, lower: int = 20, upper: int = 150) -> DataFrame:
    """The threshold adds to the mean: mean + (1 - k (1 - sd / R))."""
    s = local_statistics(px, region)
    return s.select(*KEY, bounded(F.col("v") > F.col("mean") + (1 - sensitivity * (1 - F.sqrt("var") / dynamic)), lower, upper).alias("v"))


def gatos_background(px: DataFrame, onebit: DataFrame, region: int = 15) -> DataFrame:
    """White pixels keep v; black ones take the mean of the window's white pixels, white if there is none."""
    both = px.join(onebit.withColumnRenamed("v", "b"), KEY)
    w = box(both.select(*KEY, F.when(F.col("b") > 0, 0).otherwise(F.col("v")).alias("v"), F.when(F.col("b") > 0, 0).otherwise(1).alias("one")), region // 2, weight="one").select(*KEY, "s", "c")
    fill = F.when(F.col("c") > 0, F.floor(F.col("s") / F.col("c") + 0.5)).otherwise(255)
    return both.join(w, KEY).select(*KEY, F.when(F.col("b") > 0, fill).otherwise(F.col("v")).cast("int").alias("v"))


def gatos_threshold(px: DataFrame, background: DataFrame, onebit: DataFrame, q: float = 0.6, p1: float = 0.5, p2: float = 0.8) -> DataFrame:
    both = px.join(background.withColumnRenamed("v", "g"), KEY).join(onebit.withColumnRenamed("v", "b"), KEY)
    d = F.col("g") - F.col("v")
    s = both.groupBy("image_id").agg((F.sum(F.when(F.col("b") > 0, d).otherwise(0)) / F.sum((F.col("b") > 0).cast("int"))).alias("delta"), F.avg(F.when(F.col("b") == 0, F.col("g"))).alias("bg"))
    limit = q * F.col("delta") * ((1 - p2) / (1 + F.exp(-4 * F.col("g") / (F.col("bg") * (1 - p1)) + 2 * (1 + p1) / (1 - p1))) + p2)
    return both.join(s, "image_id").select(*KEY, F.coalesce(d > limit, F.lit(False)).cast("int").alias("v"))


def shading_subtraction(px: DataFrame, k: int = 7, t: int | None = None) -> DataFrame:
    """Background by a k x k maximum; black where background - v is large (otsu of the stretched difference without t)."""
    d = px.join(min_max_filter(px, k, "max").withColumnRenamed("v", "g"), KEY).select(*KEY, (F.col("g") - F.col("v")).cast("int").alias("v"))
    if t is not None:
        return d.withColumn("v", (F.col("v") >= t).cast("int"))
    top = d.groupBy("image_id").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    grey = d.join(top, "image_id").select(*KEY, (255 - F.floor(255.0 * (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).cast("int").alias("v"))
    return otsu_threshold(grey)


def soft_threshold(px: DataFrame, t: int, sigma: float = 0.0, dist: str = "logistic") -> DataFrame:
    """Grey values through a distribution function centred on t; sigma 0 is found from the mean of values above t."""
    if sigma <= 0:
        s = px.groupBy("image_id").agg(F.avg(F.when(F.col("v") > t, F.col("v"))).alias("vw")).select("image_id", sigma_of(F.coalesce("vw", F.lit(float(t + 1))) - t, dist).alias("sigma"))
        px = px.join(s, "image_id")
    else:
        px = px.withColumn("sigma", F.lit(sigma))
    z = (F.col("v") - t) / F.col("sigma")
    if dist == "logistic":
        cdf = 1 / (1 + F.exp(-z * math.pi / math.sqrt(3)))
    elif dist == "uniform":
        cdf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + z / math.sqrt(12)))
    else:  # normal, by Abramowitz and Stegun 7.1.26
        a = F.abs(z) / math.sqrt(2)
        u = 1 / (1 + 0.3275911 * a)
        erf = 1 - ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * F.exp(-a * a)
        cdf = F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))
    return px.select(*KEY, F.least(F.lit(255), F.floor(256 * cdf + 0.5)).cast("int").alias("v"))


def sigma_of(spread: Column, dist: str) -> Column:
    """The sigma at which a value ``spread`` above the centre reaches 0.99."""
    factor = {"logistic": math.pi / (4.59512 * math.sqrt(3)), "normal": 1 / 2.32635, "uniform": 1 / (0.49 * math.sqrt(12))}[dist]
    return F.greatest(spread * factor, F.lit(1e-9))


def soft_threshold_find_sigma(px: DataFrame, t: int, dist: str = "logistic") -> DataFrame:
    return px.groupBy("image_id").agg(F.avg(F.when(F.col("v") > t, F.col("v"))).alias("vw")).select("image_id", sigma_of(F.coalesce("vw", F.lit(float(t + 1))) - t, dist).alias("sigma"))


def white_rohrer_threshold(px: DataFrame, x_lookahead: int = 8, y_lookahead: int = 1, bias_factor: float = 100.0, f: float = 0.25, g: float = 0.25) -> DataFrame:
    """Black where a pixel lies under a running average that goes along rows and down columns; sequential within an image.

    f and g are the averages' slopes; the responses are linear.
    """
    from ..sources.raster import by_image
    from .kernels import running_threshold

    return by_image(px, lambda a: running_threshold(a, x_lookahead, y_lookahead, bias_factor, f, g))


def djvu_threshold(px: DataFrame, smoothness: float = 0.2, block: int = 64) -> DataFrame:
    """Black where an RGB pixel is nearer to its block's foreground colour than to its background colour."""
    from .kernels import two_colour_blocks

    flat = px.select(*KEY, (F.col("v.r") * 65536 + F.col("v.g") * 256 + F.col("v.b")).alias("v"))
    from ..sources.raster import by_image

    return by_image(flat, lambda a: two_colour_blocks(a, smoothness, block))
