"""Nearest neighbours over feature vectors.

Training data is ``train(id, class, features)``, queries are ``query(id, features)``. Both go in blocks
(``blocks``): queries meet each block, keep their k best, and the k best of all blocks are merged, so no task
holds all pairs.
Distances: "city_block", "euclidean" (sums the roots of squares by coordinate, so it equals city block),
"fast_euclidean" (squares, no root), and "l2".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import distances, nearest_rows, pair_statistics, rows_within

BROADCAST_ROWS = 20_000


def distance(a: Column, b: Column, kind: str = "city_block", weights: list[float] | None = None, selections: list[int] | None = None) -> Column:
    """Weighted distance of two arrays of doubles; selections are 0 or 1 a feature."""
    step = (lambda p, q: F.abs(p - q)) if kind in ("city_block", "euclidean") else (lambda p, q: (p - q) * (p - q))
    parts = F.zip_with(a, b, step)
    if weights or selections:
        n = len(weights or selections)
        w = F.array(*[F.lit(float((weights or [1] * n)[i] * (selections or [1] * n)[i])) for i in range(n)])
        parts = F.zip_with(parts, w, lambda p, q: p * q)
    out = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(out) if kind == "l2" else out


def doubles(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("array<double>"))


def normalization(train: DataFrame) -> DataFrame:
    """(means, sds): per feature, sample standard deviations of at least 1e-5; one row."""
    each = train.select(F.posexplode("features").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(1e-5)).alias("s"))
    cells = each.agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("c"))
    return cells.select(F.transform("c", lambda r: r["m"]).alias("means"), F.transform("c", lambda r: r["s"]).alias("sds"))


def normalize(df: DataFrame, by: DataFrame) -> DataFrame:
    """Features minus means over sds; ``by`` is the one row of ``normalization``."""
    row = by.first()
    means, sds = (F.array(*[F.lit(float(x)) for x in row[c]]) for c in ("means", "sds"))
    return df.withColumn("features", F.zip_with(F.zip_with("features", means, lambda a, m: a - m), sds, lambda a, s: a / s))


def weights_of(weights: list[float] | None, selections: list[int] | None) -> list[list[float]] | None:
    """One candidate's weights; a feature that isn't selected has none."""
    if not weights and not selections:
        return None
    n = len(weights or selections)
    return [[float((weights or [1] * n)[i] * (selections or [1] * n)[i]) for i in range(n)]]


def nearest(query: DataFrame, train: DataFrame, k: int, kind: str = "city_block", skip_self: bool = False, weights: list[float] | None = None, selections: list[int] | None = None) -> DataFrame:
    """(q, t, class, d, rank): the k nearest training rows of each query; of equally near ones the smaller id."""
    return nearest_rows(query, train, k, kind, skip_self, weights_of(weights, selections)).drop("candidate")


def majority(near: DataFrame, *more: str) -> DataFrame:
    """(q, class, n, total): the most frequent class; ties go to the smaller total distance, then name."""
    votes = near.groupBy(*more, "q", "class").agg(F.count("*").alias("n"), F.sum("d").alias("total"))
    best = Window.partitionBy(*more, "q").orderBy(F.desc("n"), F.round("total", 9), "class")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


CONFIDENCES = ("default", "knnfraction", "inverseweight", "linearweight", "nun", "nndistance", "avgdistance")


def confidences(near: DataFrame, winners: DataFrame, k: int) -> DataFrame:
    """Seven confidence measures of each winner.

    default (1 - d1 / dk)^10; knnfraction n / k; inverseweight and linearweight the winner's share of weights
    1 / d and (dk - d) / (dk - d1); nun 1 - d1 / distance of the nearest unlike neighbour; nndistance 1 - d1 / dk;
    avgdistance 1 - mean d of the winner's / dk.
    """
    w = near.join(winners.select("q", F.col("class").alias("win")), "q")
    own = F.col("class") == F.col("win")
    ends = w.groupBy("q").agg(F.min("d").alias("d1"), F.max("d").alias("dk"))
    w = w.join(ends, "q")
    inv = 1 / F.greatest("d", F.lit(1e-10))
    lin = F.when(F.col("dk") > F.col("d1"), (F.col("dk") - F.col("d")) / (F.col("dk") - F.col("d1"))).otherwise(1.0)
    one = F.max("dk")
    return w.groupBy("q", "win").agg(
        F.when(one > 0, F.pow(1 - F.min("d") / one, F.lit(10.0))).otherwise(1.0).alias("default"),
        (F.sum(own.cast("int")) / k).alias("knnfraction"),
        (F.sum(F.when(own, inv).otherwise(0.0)) / F.sum(inv)).alias("inverseweight"),
        (F.sum(F.when(own, lin).otherwise(0.0)) / F.greatest(F.sum(lin), F.lit(1e-10))).alias("linearweight"),
        F.coalesce(1 - F.min("d") / F.greatest(F.min(F.when(~own, F.col("d"))), F.lit(1e-10)), F.lit(1.0)).alias("nun"),
        F.when(one > 0, 1 - F.min("d") / one).otherwise(1.0).alias("nndistance"),
        F.when(one > 0, 1 - F.avg(F.when(own, F.col("d"))) / one).otherwise(1.0).alias("avgdistance"),
    ).withColumnRenamed("win", "class")


def get_confidence(found: DataFrame, kind: str = "default") -> DataFrame:
    """(q, class, confidence) of one measure from ``confidences``; -1 where a glyph has no class."""
    if kind not in CONFIDENCES:
        raise ValueError(f"no such confidence: {kind}")
    return found.select("q", "class", F.when(F.col("class").isNull(), -1.0).otherwise(F.col(kind)).alias("confidence"))


def classify(query: DataFrame, train: DataFrame, k: int = 1, kind: str = "city_block", **more) -> DataFrame:
    """(q, class, n, total) of each query."""
    return majority(nearest(query, train, k, kind, **more))


def leave_one_out(train: DataFrame, k: int = 1, kind: str = "city_block", **more) -> DataFrame:
    """(q, class, n, total, truth) of each training row against the others.

    Rows of classes with fewer than int((k + 0.5) / 2) members are left out.
    """
    of = Window.partitionBy("class")
    frequent = train.withColumn("members", F.count("*").over(of)).where(F.col("members") >= int((k + 0.5) / 2)).drop("members")
    found = classify(frequent.select("id", "features"), train, k, kind, skip_self=True, **more)
    return found.join(frequent.select(F.col("id").alias("q"), F.col("class").alias("truth")), "q")


def accuracy(train: DataFrame, k: int = 1, kind: str = "city_block", **more) -> DataFrame:
    """(correct, total)."""
    return leave_one_out(train, k, kind, **more).agg(F.coalesce(F.sum((F.col("class") == F.col("truth")).cast("long")), F.lit(0)).alias("correct"), F.count("*").alias("total"))


def confusion_matrix(train: DataFrame, k: int = 1, kind: str = "city_block") -> DataFrame:
    """(truth, class, n, percent) of leave-one-out, whole percents of the truth's rows."""
    c = leave_one_out(train, k, kind).groupBy("truth", "class").agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy("truth"))))


def distances_from(query: DataFrame, train: DataFrame, most: float, kind: str = "city_block") -> DataFrame:
    """(q, t, d) of all training rows nearer than ``most``; every row is compared with the query set."""
    return rows_within(query, train, most, kind)


def unique_distances(images: DataFrame, kind: str = "city_block", within: str | None = None) -> DataFrame:
    """(i, j, d) for i < j; ``within`` restricts pairs to equal values of a column, as an equi-join."""
    extra = [F.col(within).alias("g")] if within else [F.lit(0).alias("g")]
    a = images.select(F.col("id").alias("i"), F.col("features").cast("array<double>").alias("a"), *extra)
    b = images.select(F.col("id").alias("j"), F.col("features").cast("array<double>").alias("b"), *extra)
    return a.join(b, "g").where("i < j").select("i", "j", *(["g"] if within else []), distance(F.col("a"), F.col("b"), kind).alias("d"))


def distance_matrix(images: DataFrame, kind: str = "city_block") -> DataFrame:
    """(i, j, d) for all pairs, both ways, with zeros on the diagonal."""
    u = unique_distances(images, kind)
    return u.unionByName(u.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(images.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))


def knndistance_statistics(train: DataFrame, k: int = 5, kind: str = "city_block") -> DataFrame:
    """(t, avg_d): mean distance of each training row to its k nearest others."""
    return nearest(train.select("id", "features"), train, k, kind, skip_self=True).groupBy(F.col("q").alias("t")).agg(F.avg("d").alias("avg_d"))


def glyphs_by_category(train: DataFrame) -> DataFrame:
    return train.groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def get_glyphs_stats(train: DataFrame, kind: str = "city_block", keep=None) -> DataFrame:
    """(class, n, mean, stdev, median) of the pair distances in each class; singletons get (1, 1, 1, 1)."""
    d = pair_statistics(train, kind, "class", keep or (lambda df, name: df)).select(F.col("g").alias("class"), "mean", "stdev", "median")
    n = train.groupBy("class").agg(F.count("*").alias("n"))
    return n.join(d, "class", "left").select("class", "n", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("mean", "stdev", "median")])


def class_name_histogram(train: DataFrame) -> DataFrame:
    return train.groupBy("class").agg(F.count("*").alias("n"))


def strip_small_categories(train: DataFrame, more_than: int = 3) -> DataFrame:
    return train.withColumn("members", F.count("*").over(Window.partitionBy("class"))).where(F.col("members") > more_than).drop("members")


def edit_mnn(train: DataFrame, k: int = 3, kind: str = "city_block", protect: int = 0) -> DataFrame:
    """Drops rows that leave-one-out misclassifies, except in classes of at most ``protect`` members."""
    wrong = leave_one_out(train, k, kind).where("class <> truth").select(F.col("q").alias("id"))
    sizes = train.groupBy("class").agg(F.count("*").alias("members"))
    safe = train.join(sizes, "class").where(F.col("members") <= protect).select("id")
    return train.join(wrong.join(safe, "id", "left_anti"), "id", "left_anti")


def edit_cnn(train: DataFrame, k: int = 1, kind: str = "city_block", keep=None) -> DataFrame:
    """Condensing until nothing changes: the store starts with the first row; each round adds, of each class, the first row it misclassifies.

    At most BROADCAST_ROWS rows are condensed in one task; more in rounds on relations, each written by ``keep``.
    """
    import numpy as np
    import pandas as pd

    if train.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:

        def condense(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)
            m = np.array(pdf["features"].tolist(), dtype=np.float64)
            names, ones = pdf["class"].tolist(), np.ones(m.shape[1])
            store, d = [0], [distances(m, m[:1], kind, ones)[:, 0]]
            while True:
                inside, first = set(store), {}
                near = np.stack(d, axis=1)
                order = np.lexsort((np.broadcast_to(np.array(store), near.shape), near), axis=1)[:, :k]
                for i, best in enumerate(order):
                    if i not in inside and names[i] not in first:
                        votes: dict = {}
                        for j in best:
                            n, total = votes.get(names[store[j]], (0, 0.0))
                            votes[names[store[j]]] = (n + 1, total + near[i, j])
                        if min(votes, key=lambda c: (-votes[c][0], round(votes[c][1], 9), c)) != names[i]:
                            first[names[i]] = i
                if not first:
                    return pdf.loc[sorted(store)]
                for i in first.values():
                    store.append(i)
                    d.append(distances(m, m[i : i + 1], kind, ones)[:, 0])

        own = train.select(F.col("id").cast("long").alias("id"), F.col("class").cast("string").alias("class"), F.col("features").cast("array<double>").alias("features"))
        return own.groupBy().applyInPandas(condense, own.schema)  # bounded by the check above
    store = keep(train.orderBy("id").limit(1), "store")
    while True:
        bag = train.join(store.select("id"), "id", "left_anti")
        wrong = classify(bag.select("id", "features"), store, k, kind).join(bag.select(F.col("id").alias("q"), F.col("class").alias("truth")), "q").where("class <> truth")
        # of each class only the first misclassified row moves, which keeps the store small
        new = keep(train.join(wrong.groupBy("truth").agg(F.min("q").alias("id")).select("id"), "id", "left_semi"), "moved")
        if new.isEmpty():
            return store
        store = keep(store.unionByName(new), "store")


def edit_mnn_cnn(train: DataFrame, k: int = 3, kind: str = "city_block", keep=None) -> DataFrame:
    return edit_cnn(edit_mnn(train, k, kind), 1, kind, keep)


def feature_subsets(n: int, size: int) -> list[list[int]]:
    from itertools import combinations

    return [[int(i in c) for i in range(n)] for c in combinations(range(n), size)]


def simple_feature_selector(train: DataFrame, sizes: list[int], n: int, k: int = 1, kind: str = "city_block") -> DataFrame:
    """(mask, correct, total) of each subset of the features of the given sizes, by leave-one-out; all subsets are scored in one job."""
    masks = [mask for size in sizes for mask in feature_subsets(n, size)]
    near = nearest_rows(train.select("id", "features"), train, k, kind, True, [[float(x) for x in mask] for mask in masks])
    found = majority(near, "candidate").join(train.select(F.col("id").cast("long").alias("q"), F.col("class").alias("truth")), "q")
    scored = found.groupBy("candidate").agg(F.sum((F.col("class") == F.col("truth")).cast("long")).alias("correct"), F.count("*").alias("total"))
    names = train.sparkSession.createDataFrame([(i, "".join(map(str, mask))) for i, mask in enumerate(masks)], "candidate int, mask string")
    return scored.join(names, "candidate").select("mask", "correct", "total")


# --- saving and settings ---------------------------------------------------------------------------


def serialize(train: DataFrame, path: str, settings: dict | None = None) -> None:
    """Training rows as Parquet under <path>/train and settings (k, distance, weights, selections) as JSON under <path>/settings."""
    import json

    train.write.mode("overwrite").parquet(f"{path}/train")
    spark = train.sparkSession
    spark.createDataFrame([(json.dumps(settings or {}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def unserialize(spark, path: str) -> tuple[DataFrame, dict]:
    import json

    return spark.read.parquet(f"{path}/train"), json.loads(spark.read.text(f"{path}/settings").first()["value"])


def by_feature(layout: dict[str, int], values: dict[str, list]) -> list:
    """A flat vector of weights or selections from values by feature; features lie in the order of their names, 1 where not given."""
    return [x for name in sorted(layout) for x in values.get(name, [1] * layout[name])]


def delimited(train: DataFrame, separator: str = ",") -> DataFrame:
    """(line): features and class of each row."""
    return train.select(F.concat_ws(separator, F.transform("features", lambda x: x.cast("string")), F.col("class")).alias("line"))
