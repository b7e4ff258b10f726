"""Neighbourhood operators.

Sums, minima and maxima over boxes run as two window frames, along rows and then along columns, so their
cost doesn't depend on the window's size more than linearly in its side. Small masks run over the raster of
an image, so pixels are never joined with pixels.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.raster import at_pixels, by_image, sizes

KEY = ["image_id", "y", "x"]


def frame(line: str, at: str, h: int):
    return Window.partitionBy("image_id", line).orderBy(at).rangeBetween(-h, h)


def box(px: DataFrame, h: int, weight: str | None = None) -> DataFrame:
    """px with s, q, c: sum, sum of squares and count (or weight) over the (2 h + 1)^2 window, clipped at the borders."""
    x = F.col("v").cast("double")
    one = F.col(weight).cast("double") if weight else F.lit(1.0)
    w = frame("y", "x", h)
    a = px.withColumn("s1", F.sum(x).over(w)).withColumn("q1", F.sum(x * x).over(w)).withColumn("c1", F.sum(one).over(w))
    w = frame("x", "y", h)
    return a.withColumn("s", F.sum("s1").over(w)).withColumn("q", F.sum("q1").over(w)).withColumn("c", F.sum("c1").over(w)).select(*KEY, "v", "s", "q", "c")


def mean(px: DataFrame, k: int = 3, border: str = "padwhite", white: int = 255) -> DataFrame:
    """k x k mean, rounded; outside the image is white ("padwhite") or mirrored ("reflect")."""
    h = k // 2
    if border == "reflect":
        return convolve(px, [[1.0 / (k * k)] * k] * k, "reflect").select(*KEY, F.floor(F.col("v") + 0.5).cast("int").alias("v"))
    s = box(px, h)
    return s.select(*KEY, F.floor((F.col("s") + (k * k - F.col("c")) * white) / (k * k) + 0.5).cast("int").alias("v"))


def min_max_filter(px: DataFrame, k: int = 3, which: str = "min", k_vertical: int = 0) -> DataFrame:
    f = F.min if which == "min" else F.max
    a = px.withColumn("v", f("v").over(frame("y", "x", k // 2)))
    return a.withColumn("v", f("v").over(frame("x", "y", (k_vertical or k) // 2)))


def neighbours(px: DataFrame, h: int, border: str = "padwhite", white=255) -> DataFrame:
    """(image_id, y, x, u): for each pixel the values of its (2 h + 1)^2 window."""
    d = [(dy, dx) for dy in range(-h, h + 1) for dx in range(-h, h + 1)]
    s = sizes(px)
    cells = px.select(*KEY).withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in d]))).join(s, "image_id")
    cells = cells.select("image_id", "y", "x", "nrows", "ncols", (F.col("y") + F.col("d.dy")).alias("sy"), (F.col("x") + F.col("d.dx")).alias("sx"))
    if border == "reflect":
        inside = lambda c, n: F.when(c < 0, -c).when(c >= n, 2 * n - 2 - c).otherwise(c)
        cells = cells.withColumn("sy", inside(F.col("sy"), F.col("nrows"))).withColumn("sx", inside(F.col("sx"), F.col("ncols")))
    near = px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("u"))
    return cells.join(near.hint("merge"), ["image_id", "sy", "sx"], "left").select(*KEY, F.coalesce("u", F.lit(white)).alias("u"))


def rank(px: DataFrame, r: int, k: int = 3, border: str = "padwhite", white: int = 255) -> DataFrame:
    """The r-th smallest (from 1) of the k x k window."""
    return neighbours(px, k // 2, border, white).groupBy(*KEY).agg(F.element_at(F.array_sort(F.collect_list("u")), r).alias("v"))


def erode_dilate(px: DataFrame, times: int = 1, direction: str = "dilate", shape: str = "rectangular", dark_is_low: bool = False) -> DataFrame:
    """Repeated 3 x 3 dilation or erosion of black; "octagonal" alternates with the cross. In greyscale black is low."""
    grow = (direction == "dilate") != dark_is_low
    f, pick = (F.max, F.greatest) if grow else (F.min, F.least)
    for n in range(times):
        if shape == "octagonal" and n % 2:
            px = px.withColumn("v", pick(f("v").over(frame("y", "x", 1)), f("v").over(frame("x", "y", 1))))
        else:
            px = px.withColumn("v", f("v").over(frame("y", "x", 1))).withColumn("v", f("v").over(frame("x", "y", 1)))
    return px


def dilate(px: DataFrame) -> DataFrame:
    return erode_dilate(px, 1, "dilate")


def erode(px: DataFrame) -> DataFrame:
    return erode_dilate(px, 1, "erode")


def outline(px: DataFrame, which: str = "outer") -> DataFrame:
    own = px.withColumn("own", F.col("v"))
    other = dilate(own) if which == "outer" else erode(own)
    return other.select(*KEY, ((F.col("own") > 0) != (F.col("v") > 0)).cast("int").alias("v"))


def offsets_of(element: list[list[int]], origin: tuple[int, int]) -> list[tuple[int, int]]:
    """(dy, dx) of a structuring element's black cells from its origin (x, y)."""
    return [(y - origin[1], x - origin[0]) for y, row in enumerate(element) for x, c in enumerate(row) if c]


def hits(a: np.ndarray, d: list[tuple[int, int]], sign: int = 1) -> np.ndarray:
    """How many cells of an element lie on each pixel when it is laid on every black one."""
    h, w = a.shape
    n = np.zeros((h, w), dtype=np.int32)
    for dy, dx in d:
        dy, dx = sign * dy, sign * dx
        if abs(dy) < h and abs(dx) < w:
            n[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] += a[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)] > 0
    return n


def dilate_with_structure(px: DataFrame, element: list[list[int]], origin: tuple[int, int]) -> DataFrame:
    d = offsets_of(element, origin)
    return at_pixels(px, lambda a, there: [(a > 0) | (hits(a, d) > 0)], {"v": "int"})


def erode_with_structure(px: DataFrame, element: list[list[int]], origin: tuple[int, int]) -> DataFrame:
    """Black where the whole element lies on black."""
    d = offsets_of(element, origin)
    return at_pixels(px, lambda a, there: [(hits(a, d, -1) == len(d)) & bool(d)], {"v": "int"})


def labeled_region_edges(px: DataFrame, mark_both: bool = False) -> DataFrame:
    """Black where the right, lower or lower right neighbour differs; with mark_both the neighbour too."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    col = Window.partitionBy("image_id", "x").orderBy("y")
    n = px.withColumn("r", F.lead("v").over(row))
    if mark_both:
        n = n.withColumn("l", F.lag("v").over(row))
    n = n.withColumn("b", F.lead("v").over(col)).withColumn("d", F.lead("r").over(col))
    if mark_both:
        n = n.withColumn("t", F.lag("v").over(col)).withColumn("u", F.lag("l").over(col))
    differs = [F.coalesce(F.col(c) != F.col("v"), F.lit(False)) for c in ("rbdltu" if mark_both else "rbd")]
    return n.select(*KEY, reduce(or_, differs).cast("int").alias("v"))


# --- convolution -----------------------------------------------------------------------------------


def gaussian_kernel(sd: float = 1.0, order: int = 0) -> list[float]:
    """One-dimensional Gaussian of radius 3 sd + order / 2, or its derivative, normalised."""
    r = max(1, math.floor(3 * sd + 0.5 * order + 0.5))
    xs = range(-r, r + 1)
    g = [math.exp(-x * x / (2 * sd * sd)) for x in xs]
    if order == 0:
        return [a / sum(g) for a in g]
    if order == 1:
        k = [-x * a for x, a in zip(xs, g, strict=True)]
        return [a / -sum(x * b for x, b in zip(xs, k, strict=True)) for a in k]
    k = [(x * x / sd**2 - 1) * a for x, a in zip(xs, g, strict=True)]
    k = [a - sum(k) / len(k) for a in k]
    return [2 * a / sum(x * x * b for x, b in zip(xs, k, strict=True)) for a in k]


def binomial_kernel(radius: int = 3) -> list[float]:
    return [math.comb(2 * radius, i) / 4.0**radius for i in range(2 * radius + 1)]


def averaging_kernel(radius: int = 3) -> list[float]:
    return [1.0 / (2 * radius + 1)] * (2 * radius + 1)


def symmetric_gradient_kernel() -> list[float]:
    return [0.5, 0.0, -0.5]


def sharpening_kernel(factor: float = 0.5) -> list[list[float]]:
    a, b = -factor / 16, -factor / 8
    return [[a, b, a], [b, 1 + 0.75 * factor, b], [a, b, a]]


def places(at: np.ndarray, size: int, border: str) -> np.ndarray:
    """Where a border rule finds the values of the places ``at`` of an axis; ``size`` where there is none."""
    if border == "repeat":
        at = np.clip(at, 0, size - 1)
    elif border == "reflect":
        at = np.abs(at)
        at = np.zeros_like(at) if size == 1 else np.where(at >= size, 2 * (size - 1) - at, at)
    elif border == "wrap":
        at = at % size
    return np.where((at < 0) | (at >= size), size, at)


def convolved(a: np.ndarray, there: np.ndarray, kernel: list[list[float]], border: str) -> np.ndarray:
    """Two-dimensional convolution of a raster whose pixels are those of ``there``."""
    a = np.where(there, a, 0).astype(np.float64)
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    rows, cols = np.arange(a.shape[0]), np.arange(a.shape[1])
    p, s, kept = np.pad(a, (0, 1)), np.zeros(a.shape), np.zeros(a.shape)
    known = np.pad(there, (0, 1)) if border == "clip" else None
    for i, row in enumerate(kernel):
        for j, k in enumerate(row):
            at = np.ix_(places(rows - (i - h), len(rows), border), places(cols - (j - w), len(cols), border))
            s += k * p[at]
            if known is not None:
                kept += k * known[at]
    if border == "avoid":
        inside = np.zeros(a.shape, dtype=bool)
        inside[len(kernel) - 1 - h : max(0, a.shape[0] - h), len(kernel[0]) - 1 - w : max(0, a.shape[1] - w)] = True
        return np.where(inside, s, a)
    if border == "clip":
        return np.where(kept != 0, s * sum(map(sum, kernel)) / np.where(kept != 0, kept, 1), s)
    return s


def passes(a: np.ndarray, there: np.ndarray, kx: list[float], ky: list[float], border: str = "reflect") -> np.ndarray:
    """Convolution of the rows by kx, then of the columns by ky."""
    return convolved(convolved(a, there, [kx], border), there, [[k] for k in ky], border)


def convolve(px: DataFrame, kernel: list[list[float]], border: str = "reflect") -> DataFrame:
    """Two-dimensional convolution. Border: avoid (keeps v), clip (renormalises), repeat, reflect or wrap."""
    return at_pixels(px, lambda a, there: [convolved(a, there, kernel, border)], {"v": "double"})


def convolve_x(px: DataFrame, kernel: list[float], border: str = "reflect") -> DataFrame:
    return convolve(px, [kernel], border)


def convolve_y(px: DataFrame, kernel: list[float], border: str = "reflect") -> DataFrame:
    return convolve(px, [[k] for k in kernel], border)


def convolve_xy(px: DataFrame, kx: list[float], ky: list[float] | None = None, border: str = "reflect") -> DataFrame:
    return at_pixels(px, lambda a, there: [passes(a, there, kx, ky or kx, border)], {"v": "double"})


def gaussian_smoothing(px: DataFrame, sd: float = 1.0) -> DataFrame:
    return convolve_xy(px, gaussian_kernel(sd))


def simple_sharpen(px: DataFrame, factor: float = 0.5) -> DataFrame:
    return convolve(px, sharpening_kernel(factor), "reflect")


def gaussian_gradient(px: DataFrame, sd: float = 0.5) -> tuple[DataFrame, DataFrame]:
    g, d = gaussian_kernel(sd), gaussian_kernel(sd, 1)
    return convolve_xy(px, d, g), convolve_xy(px, g, d)


def gaussian_gradients(px: DataFrame, sd: float = 0.5) -> DataFrame:
    """Both parts of ``gaussian_gradient`` as v and w."""
    g, d = gaussian_kernel(sd), gaussian_kernel(sd, 1)
    return at_pixels(px, lambda a, there: [passes(a, there, d, g), passes(a, there, g, d)], {"v": "double", "w": "double"})


def hessian_matrix_of_gaussian(px: DataFrame, sd: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    g, d, dd = (gaussian_kernel(sd, n) for n in range(3))
    return convolve_xy(px, dd, g), convolve_xy(px, g, dd), convolve_xy(px, d, d)


def laplacian_of_gaussian(px: DataFrame, sd: float = 0.5) -> DataFrame:
    g, _, dd = (gaussian_kernel(sd, n) for n in range(3))
    return at_pixels(px, lambda a, there: [passes(a, there, dd, g) + passes(a, there, g, dd)], {"v": "double"})


def sobel_edge_detection(px: DataFrame) -> DataFrame:
    """Magnitude of the Sobel gradient."""
    s, d = [0.25, 0.5, 0.25], symmetric_gradient_kernel()
    return at_pixels(px, lambda a, there: [np.hypot(passes(a, there, d, s), passes(a, there, s, d))], {"v": "double"})


def create_gabor_filter(px: DataFrame, orientation: float = 45.0, frequency: float = 0.375, direction: int = 5) -> DataFrame:
    """Filters with a Gabor kernel: a cosine of the frequency along the orientation under a Gaussian."""
    t = math.radians(orientation)
    sd = 1 / (2 * frequency)
    r = max(1, math.ceil(2 * sd))
    k = [[math.exp(-(x * x + y * y) / (2 * sd * sd)) * math.cos(2 * math.pi * frequency * (x * math.cos(t) + y * math.sin(t)) * direction / 5) for x in range(-r, r + 1)] for y in range(-r, r + 1)]
    mean_ = sum(map(sum, k)) / (2 * r + 1) ** 2
    return convolve(px, [[c - mean_ for c in row] for row in k])


# --- sequential within an image: numpy kernels -----------------------------------------------------


def kernel_op(name: str, kind: str = "int", **options):
    """An operator that runs a kernel of ``kernels`` on each image."""
    from . import kernels

    return lambda px: by_image(px, lambda a: getattr(kernels, name)(a, **options), kind)
