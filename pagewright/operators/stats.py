"""Statistics of numeric columns as aggregations and windows. The special functions run on single results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- special functions -----------------------------------------------------------------------------


def gammln(x: float) -> float:
    return math.lgamma(x)


def betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def betai(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * betacf(b, a, 1 - x) / b


def gammainc_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < s + 1:
        term = total = 1 / s
        n = s
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b = x + 1 - s
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def chisqprob(chisq: float, df: float) -> float:
    return 1.0 if chisq <= 0 or df < 1 else gammainc_upper(df / 2, chisq / 2)


def erfcc(x: float) -> float:
    return math.erfc(x)


def zprob(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def ksprob(x: float) -> float:
    if x <= 0:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def fprob(dfnum: float, dfden: float, f: float) -> float:
    return betai(0.5 * dfden, 0.5 * dfnum, dfden / (dfden + dfnum * f))


def F_value(er: float, ef: float, dfr: float, dff: float) -> float:  # noqa: N802
    return ((er - ef) / (dfr - dff)) / (ef / dff)


def tprob(t: float, df: float) -> float:
    """Two-sided."""
    return betai(0.5 * df, 0.5, df / (df + t * t))


def p2t(p: float, df: float) -> float:
    """The t whose two-sided probability is p."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tprob(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def incr(at: list[int], tops: list[int]) -> list[int]:
    """The next state of an odometer; [-1] after the last."""
    out = list(at)
    for i in range(len(out) - 1, -1, -1):
        out[i] += 1
        if out[i] <= tops[i]:
            return out
        out[i] = 0
    return [-1]


# --- moments ---------------------------------------------------------------------------------------


def describe(x: str | Column) -> dict[str, Column]:
    """Aggregates by name: geometricmean harmonicmean mean moments variation skew kurtosis variances and sums."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    n, mean = F.count(c), F.avg(c)
    return {
        "n": n, "mean": mean, "min": F.min(c), "max": F.max(c), "geometricmean": F.exp(F.avg(F.log(c))), "harmonicmean": n / F.sum(1 / c),
        "samplevar": F.var_pop(c), "samplestdev": F.stddev_pop(c), "var": F.var_samp(c), "stdev": F.stddev_samp(c), "sterr": F.stddev_samp(c) / F.sqrt(n),
        "sem": F.stddev_pop(c) / F.sqrt(n), "variation": 100 * F.stddev_samp(c) / mean, "skew": F.skewness(c), "kurtosis": F.kurtosis(c) + 3,
        "signaltonoise": mean / F.stddev_pop(c), "sum": F.sum(c), "ss": F.sum(c * c), "square_of_sums": F.pow(F.sum(c), 2.0), "moment2": F.var_pop(c),
    }


def describe_table(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    d = describe(x)
    return df.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in d.items()])


def moment(df: DataFrame, x: str, k: int, by: list[str]) -> DataFrame:
    """(by, moment): k-th central moment."""
    w = Window.partitionBy(*by)
    return df.withColumn("__d", F.col(x) - F.avg(x).over(w)).groupBy(*by).agg(F.avg(F.pow("__d", F.lit(float(k)))).alias("moment"))


def medianscore(x: str) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return F.expr(f"percentile({x}, 0.5)")


def mode(df: DataFrame, x: str) -> DataFrame:
    """(x, n): all most frequent values."""
    n = df.groupBy(x).agg(F.count("*").alias("n"))
    return n.join(n.agg(F.max("n").alias("n")), "n").select(x, "n")


def itemfreq(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(x).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, x: str, bins: int = 10, limits: tuple[float, float] | None = None) -> DataFrame:
    """(bin, n, low): counts of equal bins from min - width / 2, with width (max - min + e) / bins and e = (max - min) / bins + 1e-6.

    With limits, bins span them exactly and values outside are left out. Empty bins count 0.
    """
    if limits:
        low, width = F.lit(float(limits[0])), F.lit((limits[1] - limits[0]) / bins)
        base = df.select(F.col(x).cast("double").alias("x"), low.alias("low"), width.alias("width"))
        edges = df.sparkSession.createDataFrame([(float(limits[0]), (limits[1] - limits[0]) / bins)], "low double, width double")
    else:
        e = (F.max(x) - F.min(x)) / bins + 1e-6
        edges = df.agg(((F.max(x) - F.min(x) + e) / bins).alias("width"), F.min(x).cast("double").alias("lo")).select((F.col("lo") - F.col("width") / 2).alias("low"), "width")
        base = df.select(F.col(x).cast("double").alias("x")).join(F.broadcast(edges), F.lit(True))  # one row
    n = base.select(F.floor((F.col("x") - F.col("low")) / F.col("width")).cast("int").alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))
    grid = edges.select("low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("low") + F.col("bin") * F.col("width")).alias("low"))


def cumfreq(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """(bin, n, low): cumulative counts."""
    return histogram(df, x, bins).withColumn("n", F.sum("n").over(Window.orderBy("bin")))  # a row per bin


def relfreq(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    h = histogram(df, x, bins)
    n = df.where(F.col(x).isNotNull()).count()
    return h.withColumn("n", F.col("n") / F.lit(float(max(1, n))))


def median(df: DataFrame, x: str, bins: int = 1000) -> float:
    """Interpolated inside the histogram over [min, max] (whose largest value lies outside the bins)."""
    lo, hi, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if hi == lo:
        return float(lo)
    h = histogram(df, x, bins, (float(lo), float(hi))).orderBy("bin").collect()  # ``bins`` rows
    cum, width = 0, (hi - lo) / bins
    for r in h:
        if cum + r["n"] >= n / 2:
            return r["low"] + (n / 2 - cum) / max(1, r["n"]) * width
        cum += r["n"]
    return float(hi)


def scoreatpercentile(df: DataFrame, x: str, percent: float) -> float:
    """By interpolation in a histogram of ten bins."""
    n = df.where(F.col(x).isNotNull()).count()
    rows = histogram(df, x).orderBy("bin").collect()
    target, cum = n * percent / 100, 0
    for i, r in enumerate(rows):
        if cum + r["n"] >= target:
            width = rows[1]["low"] - rows[0]["low"]
            return r["low"] + (target - cum) / max(1, r["n"]) * width
        cum += rows[i]["n"]
    return float("nan")


def percentileofscore(df: DataFrame, x: str, score: float) -> float:
    n = df.where(F.col(x).isNotNull()).count()
    rows = histogram(df, x).orderBy("bin").collect()
    width = rows[1]["low"] - rows[0]["low"]
    i = min(max(int((score - rows[0]["low"]) / width), 0), len(rows) - 1)
    below = sum(r["n"] for r in rows[:i])
    return (below + (score - rows[i]["low"]) / width * rows[i]["n"]) / n * 100


# --- transformations -------------------------------------------------------------------------------


def zs(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """df with z, the score in its group by the population deviation."""
    w = Window.partitionBy(*by)
    return df.withColumn("z", (F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w))


def zmap(df: DataFrame, x: str, compare: DataFrame, y: str) -> DataFrame:
    c = compare.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s"))
    return df.join(F.broadcast(c), F.lit(True)).withColumn("z", (F.col(x) - F.col("m")) / F.col("s")).drop("m", "s")  # one row


def threshold(x: str, low: float | None, high: float | None, value: float = 0.0) -> Column:
    out = F.col(x)
    if low is not None:
        out = F.when(F.col(x) < low, value).otherwise(out)
    return F.when(F.col(x) > high, value).otherwise(out) if high is not None else out


def trim(df: DataFrame, x: str, share: float, by: list[str], both: bool = True, tail: str = "right") -> DataFrame:
    """Drops int(share * n) rows of each group from both ends, or from one tail."""
    w = Window.partitionBy(*by).orderBy(x)
    r = df.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by))).withColumn("__cut", F.floor(F.col("__n") * share))
    low = F.col("__k") > F.col("__cut") if both or tail == "left" else F.lit(True)
    high = F.col("__k") <= F.col("__n") - F.col("__cut") if both or tail == "right" else F.lit(True)
    return r.where(low & high).drop("__k", "__n", "__cut")


def trimmed(x: str, low: float | None = None, high: float | None = None) -> dict[str, Column]:
    """tmean tvar tmin tmax tstdev tsem of the values within [low, high]."""
    c = F.col(x).cast("double")
    ok = (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
    t = F.when(ok, c)
    return {"tmean": F.avg(t), "tvar": F.var_samp(t), "tmin": F.min(t), "tmax": F.max(t), "tstdev": F.stddev_samp(t), "tsem": F.stddev_samp(t) / F.sqrt(F.count(t))}


def cumsum(df: DataFrame, x: str, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("cumsum", F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def rankdata(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """df with rank, ties averaged: rank + (peers - 1) / 2."""
    w = Window.partitionBy(*by).orderBy(x)
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0)


def obrientransform(df: DataFrame, x: str, group: str) -> DataFrame:
    """df with t: ((n - 1.5) n (x - m)^2 - 0.5 v (n - 1)) / ((n - 1)(n - 2)) by group."""
    w = Window.partitionBy(group)
    n, m, v = F.count(x).over(w), F.avg(x).over(w), F.var_samp(x).over(w)
    return df.withColumn("t", ((n - 1.5) * n * F.pow(F.col(x) - m, 2.0) - 0.5 * v * (n - 1)) / ((n - 1.0) * (n - 2.0)))


# --- correlation and regression --------------------------------------------------------------------


def correlations(x: str, y: str) -> dict[str, Column]:
    """r, lincc, slope, intercept, cov, sterrest, summult, sumdiffsquared."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = F.corr(a, b)
    return {
        "n": F.count("*"), "r": r, "lincc": 2 * F.covar_samp(a, b) / (F.var_samp(a) + F.var_samp(b) + F.pow(F.avg(a) - F.avg(b), 2.0)), "slope": F.regr_slope(b, a), "intercept": F.regr_intercept(b, a),
        "cov": F.covar_samp(a, b), "sterrest": F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)) * F.stddev_pop(b), "summult": F.sum(a * b), "sumdiffsquared": F.sum((a - b) * (a - b)),
    }


def pearsonr(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    r, n = df.agg(F.corr(x, y), F.count("*")).first()
    t = r * math.sqrt((n - 2) / max(1e-20, (1 - r) * (1 + r)))
    return r, tprob(t, n - 2)


def linregress(df: DataFrame, x: str, y: str) -> tuple[float, float, float, float, float]:
    """slope, intercept, r, p, standard error of the estimate."""
    row = df.agg(*[c.alias(k) for k, c in correlations(x, y).items()]).first()
    t = row["r"] * math.sqrt((row["n"] - 2) / max(1e-20, (1 - row["r"]) * (1 + row["r"])))
    return row["slope"], row["intercept"], row["r"], tprob(t, row["n"] - 2), row["sterrest"]


def spearmanr(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rs): 1 - 6 sum d^2 / (n (n^2 - 1)) on average ranks, without a correction for ties."""
    r = rankdata(rankdata(df, x, by).withColumnRenamed("rank", "__rx"), y, by)
    n = F.count("*").cast("double")
    return r.groupBy(*by).agg(F.count("*").alias("n"), (1 - 6 * F.sum(F.pow(F.col("__rx") - F.col("rank"), 2.0)) / (n * (n * n - 1))).alias("rs"))


def pointbiserialr(df: DataFrame, category: str, y: str) -> DataFrame:
    """(rpb): of a column of two values and a numeric one; the smaller value counts as the first group."""
    low = df.agg(F.min(category).alias("low"))
    d = df.join(F.broadcast(low), F.lit(True))  # one row
    one = F.col(category) == F.col("low")
    n, n1 = F.count("*"), F.sum(one.cast("double"))
    return d.agg(((F.avg(F.when(~one, F.col(y))) - F.avg(F.when(one, F.col(y)))) / F.stddev_pop(y) * F.sqrt(n1 / n * (n - n1) / n)).alias("rpb"))


def kendalltau(df: DataFrame, x: str, y: str, key: str, by: list[str]) -> DataFrame:
    """(by, tau): over all pairs within a group, each row paired with itself too, which adds to both denominators' ties."""
    a = df.select(*by, F.col(key).alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = df.select(*by, F.col(key).alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    p = a.join(b, by).where("i <= j")
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    n1 = F.sum((F.col("x1") != F.col("x2")).cast("double"))
    n2 = F.sum(((F.col("y1") != F.col("y2"))).cast("double"))
    return p.groupBy(*by).agg((F.sum(s) / F.sqrt(n1 * n2)).alias("tau"))


def correlation_matrix(df: DataFrame, columns: list[str], f=F.corr) -> DataFrame:
    """(a, b, value) of all pairs of columns; F.covar_samp for covariances."""
    row = df.agg(*[f(a, b).alias(f"{a}|{b}") for a in columns for b in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("value")) for a in columns for b in columns])).alias("s")).select("s.*")


def glm(df: DataFrame, y: str, xs: list[str]) -> list[float]:
    """Least-squares coefficients (intercept first) from the normal equations, one aggregation."""
    import numpy as np

    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    n = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(n)], *[F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(n)]).first()
    return np.linalg.lstsq(np.array([[row[f"a{i}_{j}"] for j in range(n)] for i in range(n)]), np.array([row[f"b{i}"] for i in range(n)]), rcond=None)[0].tolist()


def masslinregress(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in correlations(x, y).items() if k in ("n", "slope", "intercept", "r")])


# --- tests -----------------------------------------------------------------------------------------


def ttest_1samp(df: DataFrame, x: str, popmean: float) -> tuple[float, float]:
    m, v, n = df.agg(F.avg(x), F.var_samp(x), F.count(x)).first()
    t = (m - popmean) / math.sqrt(v / n)
    return t, tprob(t, n - 1)


def ttest_ind(df: DataFrame, x: str, group: Column) -> tuple[float, float]:
    """group: a boolean column."""
    r = df.agg(*[f(F.when(g, F.col(x))) for g in (group, ~group) for f in (F.avg, F.var_samp, F.count)]).first()
    m1, v1, n1, m2, v2, n2 = r
    df_ = n1 + n2 - 2
    t = (m1 - m2) / math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df_ * (1 / n1 + 1 / n2))
    return t, tprob(t, df_)


def ttest_rel(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    d = df.select((F.col(x) - F.col(y)).alias("d"))
    return ttest_1samp(d, "d", 0.0)


def chisquare(df: DataFrame, observed: str, expected: str | None = None) -> tuple[float, float]:
    """Equal expectations by default."""
    total, k = df.agg(F.sum(observed), F.count("*")).first()
    e = F.col(expected) if expected else F.lit(total / k)
    (chi,) = df.agg(F.sum(F.pow(F.col(observed) - e, 2.0) / e)).first()
    return chi, chisqprob(chi, k - 1)


def ks_2samp(df: DataFrame, x: str, group: Column) -> DataFrame:
    """(d): the largest absolute distance of both distribution functions, read at each value. group: boolean."""
    n = df.groupBy(F.col(x).alias("x")).agg(F.sum(group.cast("int")).alias("a"), F.sum((~group).cast("int")).alias("b"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # a row per value
    c = n.select("x", F.sum("a").over(w).alias("ca"), F.sum("b").over(w).alias("cb"))
    t = n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return c.join(F.broadcast(t), F.lit(True)).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"))


def rank_sums(df: DataFrame, x: str, group: str) -> DataFrame:
    """(group, n, ranks, total, ties): rank sums over the union, with sum(t^3 - t) over ties.

    Ranks come from counts of values and their running sum, not from a window over all rows.
    """
    c = df.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("t"))
    up = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # a row per value
    c = c.withColumn("rank", F.sum("t").over(up) - (F.col("t") - 1) / 2.0)
    ties = c.agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.sum("t").alias("total"))
    g = df.groupBy(F.col(group).alias("group"), F.col(x).alias("x")).agg(F.count("*").alias("m")).join(c, "x")
    return g.groupBy("group").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("ranks")).join(F.broadcast(ties), F.lit(True))


def tiecorrect(df: DataFrame, x: str) -> float:
    r = rank_sums(df.withColumn("__g", F.lit(0)), x, "__g").first()
    n = r["total"]
    return 1 - r["ties"] / (n**3 - n) if n > 1 else 1.0


def mannwhitneyu(df: DataFrame, x: str, group: str) -> tuple[float, float]:
    """The smaller U and its one-tailed p, corrected for ties."""
    a, b = sorted(rank_sums(df, x, group).collect(), key=lambda r: str(r["group"]))
    u1 = a["n"] * b["n"] + a["n"] * (a["n"] + 1) / 2 - a["ranks"]
    u2 = a["n"] * b["n"] - u1
    n = a["total"]
    t = math.sqrt(max(1e-12, 1 - a["ties"] / (n**3 - n)))
    z = abs((max(u1, u2) - a["n"] * b["n"] / 2) / math.sqrt(t * a["n"] * b["n"] * (n + 1) / 12))
    return min(u1, u2), 1 - zprob(z)


def ranksums(df: DataFrame, x: str, group: str) -> tuple[float, float]:
    a, b = sorted(rank_sums(df, x, group).collect(), key=lambda r: str(r["group"]))
    z = (a["ranks"] - a["n"] * (a["n"] + b["n"] + 1) / 2) / math.sqrt(a["n"] * b["n"] * (a["n"] + b["n"] + 1) / 12)
    return z, 2 * (1 - zprob(abs(z)))


def wilcoxont(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Signed ranks of nonzero differences; the smaller sum."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).alias("plus"))
    s = {r["group"]: r for r in rank_sums(d, "m", "plus").collect()}
    n = sum(r["n"] for r in s.values())
    wt = min(s[k]["ranks"] if k in s else 0.0 for k in (True, False))
    z = abs(wt - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return wt, 2 * (1 - zprob(z))


def kruskalwallish(df: DataFrame, x: str, group: str) -> tuple[float, float]:
    s = rank_sums(df, x, group).collect()
    n = s[0]["total"]
    h = (12 / (n * (n + 1)) * sum(r["ranks"] ** 2 / r["n"] for r in s) - 3 * (n + 1)) / (1 - s[0]["ties"] / (n**3 - n))
    return h, chisqprob(h, len(s) - 1)


def friedmanchisquare(df: DataFrame, x: str, block: str, treatment: str) -> tuple[float, float]:
    r = rankdata(df, x, [block]).groupBy(treatment).agg(F.sum("rank").alias("s"), F.count("*").alias("n")).collect()
    k, n = len(r), r[0]["n"]
    chi = 12 / (k * n * (k + 1)) * sum(t["s"] ** 2 for t in r) - 3 * n * (k + 1)
    return chi, chisqprob(chi, k - 1)


def F_oneway(df: DataFrame, x: str, group: str) -> DataFrame:  # noqa: N802
    """(f, dfbn, dfwn) of a one-way analysis of variance."""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    t = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return t.select(((between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("dfbn"), (F.col("n") - F.col("k")).alias("dfwn"))


def skewtest(df: DataFrame, x: str) -> tuple[float, float]:
    b2, n = df.agg(F.skewness(x), F.count(x)).first()
    y = b2 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    a = math.sqrt(2 / (w2 - 1))
    z = math.asinh((y or 1.0) / a) / math.sqrt(0.5 * math.log(w2))
    return z, 2 * (1 - zprob(abs(z)))


def kurtosistest(df: DataFrame, x: str) -> tuple[float, float]:
    b2, n = df.agg(F.kurtosis(x) + 3, F.count(x)).first()
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    y = (b2 - e) / math.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / (s * s)))
    d = 1 + y * math.sqrt(2 / (a - 4))
    z = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / d) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
    return z, 2 * (1 - zprob(abs(z)))


def normaltest(df: DataFrame, x: str) -> tuple[float, float]:
    s, k = skewtest(df, x)[0], kurtosistest(df, x)[0]
    return s * s + k * k, chisqprob(s * s + k * k, 2)
