"""Nearest rows by matrix blocks.

Both sides are packed into blocks of at most BLOCK_ROWS rows, one matrix a row of the table. Every pair of blocks meets
once, by an equi-join on the block's number; a task holds two blocks and a slice of their distances and sends on only
the k best of each query row, so memory is bounded and what is shuffled grows with queries, not with pairs. Distances
are found roughly first; those that could be among the best are found again in double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Rows whose distances are added up at a time, and pairs of blocks of a task.
TILE, PAIRS = 8, 8
#: Query rows whose distances to a block are held at a time.
SLICE = 256


def packed(df: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, classes, m, width) of df(id, class, features)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.array(pdf["features"].tolist(), dtype=np.float64)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["id"].to_numpy(dtype=np.int64).tobytes()], "classes": [pdf["class"].tolist()], "m": [m.tobytes()], "width": [m.shape[1]]})

    own = df.select(F.col("id").cast("long").alias("id"), F.col("class").cast("string").alias("class"), F.col("features").cast("array<double>").alias("features"))
    return own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(run, "block int, ids binary, classes array<string>, m binary, width int")


def distances(a: np.ndarray, b: np.ndarray, kind: str, w: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed in the order of the features."""
    out = np.zeros((len(a), len(b)), dtype=a.dtype)
    d, t = np.empty((min(len(a), TILE), len(b)), dtype=a.dtype), np.ascontiguousarray(b.T)
    for at in range(0, len(a), TILE):  # a tile stays in the cache while the features are added
        q, total = a[at : at + TILE], out[at : at + TILE]
        part = d[: len(q)]
        for f in np.flatnonzero(w):
            np.subtract(q[:, f, None], t[f], out=part)
            if kind in ("fast_euclidean", "l2"):
                np.multiply(part, part, out=part)
            else:
                np.abs(part, out=part)
            if w[f] != 1:
                np.multiply(part, w[f], out=part)
            (np.maximum if kind == "chebyshev" else np.add)(total, part, out=total)
    return np.sqrt(out) if kind == "l2" else out


def distances_of(a: np.ndarray, b: np.ndarray, kind: str, w: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to the rows of b at the same place, summed like those of ``distances``."""
    out = np.zeros(len(a))
    for f in np.flatnonzero(w):
        d = a[:, f] - b[:, f]
        d = (d * d if kind in ("fast_euclidean", "l2") else np.abs(d)) * w[f]
        out = np.maximum(out, d) if kind == "chebyshev" else out + d
    return np.sqrt(out) if kind == "l2" else out


class Near:
    """Which rows of a block can be near: rough distances and how far they can be off.

    City block distances without weights are found in 16-bit whole numbers, off by what the values lose, others in single
    precision, off by at most (features + 8) roundings of the largest sum that the values allow. Where single precision
    may run over or under, distances are found in double. ``unit`` is the distance of 1, ``off`` is in units.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, kind: str, w: np.ndarray):
        self.a, self.b, self.kind, self.w = a, b, kind, w
        self.far, self.unit, self.off = np.inf, 1.0, 0.0
        with np.errstate(over="ignore"):
            top = np.abs(a).max(axis=0, initial=0) + np.abs(b).max(axis=0, initial=0)
            top = float((np.abs(w) * (top * top if kind in ("fast_euclidean", "l2") else top)).sum())
        self.single = 1e-25 < top < 1e30 and bool((w >= 0).all())
        self.whole = self.single and kind in ("city_block", "euclidean") and 8 <= len(w) <= 512 and bool((w == 1).all()) and len(a) and len(b)
        if self.whole:
            low, most = min(a.min(), b.min()), 65534 // len(w)
            self.unit, self.far = float(max(a.max(), b.max()) - low) / most or 1.0, 65535
            whole = [np.rint((m - low) / self.unit).astype(np.int16) for m in (a, b)]
            lost = sum(np.abs((m - low) / self.unit - q).sum(axis=1).max() for m, q in zip((a, b), whole, strict=True))
            self.off = 2 * math.ceil(lost * (1 + 1e-9) + 1e-3)
            self.fa, self.fb = whole[0], np.ascontiguousarray(whole[1].T)
        elif self.single:
            self.off = 2 * (len(w) + 8) * 2.0**-24 * top
            self.fa, self.fb = a.astype(np.float32), b.astype(np.float32)

    def rough(self, rows: slice) -> np.ndarray:
        """Distances of some rows of a, of l2 the squares."""
        if not self.single:
            return distances(self.a[rows], self.b, "fast_euclidean" if self.kind == "l2" else self.kind, self.w)
        if not self.whole:
            return distances(self.fa[rows], self.fb, "fast_euclidean" if self.kind == "l2" else self.kind, self.w)
        q = self.fa[rows]
        out, part = np.empty((len(q), self.fb.shape[1]), dtype=np.uint16), np.empty_like(self.fb)
        for i, one in enumerate(q):
            np.abs(np.subtract(self.fb, one[:, None], out=part), out=part)
            np.add.reduce(part.view(np.uint16), axis=0, out=out[i])
        return out

    def under(self, d: np.ndarray, limit) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rough distances that can be at most ``limit``, itself rough or in units."""
        limit = np.where(np.isnan(limit), np.inf, limit) + self.off
        if self.kind == "l2":  # squares that differ can have one root
            limit = limit * (1 + 1e-12)
        if self.whole:
            limit = np.clip(np.floor(limit), 0, self.far - 1).astype(np.uint16)
        return np.nonzero((d <= limit) & (d < self.far))

    def exact(self, rows: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the pairs of places i in these rows and j in b."""
        out = np.empty(len(i))
        for at in range(0, len(i), 1 << 17):
            one = slice(at, at + (1 << 17))
            out[one] = distances_of(self.a[rows][i[one]], self.b[j[one]], self.kind, self.w)
        return out

    def best(self, rows: slice, k: int, known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, d, rank) of the k nearest rows of b, whose ids ascend; rows of an id in ``known`` aren't its neighbours."""
        d = self.rough(rows)
        if len(known):
            lo, hi = np.searchsorted(ids, known), np.searchsorted(ids, known, "right")
            for i in np.flatnonzero(hi > lo):
                d[i, lo[i] : hi[i]] = self.far
        limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        i, j = self.under(d, limit[:, None])
        exact = self.exact(rows, i, j)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        ok = (rank <= k) & np.isfinite(exact)
        return i[ok], j[ok], exact[ok], rank[ok]


def matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, width)


def nearest_rows(query: DataFrame, train: DataFrame, k: int, kind: str, skip_self: bool, candidates: list[list[float]] | None) -> DataFrame:
    """(candidate, q, t, class, d, rank): the k nearest training rows of each query row, for each candidate's weights; ties go to the smaller id."""
    n, m = query.count(), train.count()
    tasks = query.sparkSession.sparkContext.defaultParallelism
    t_blocks = -(-m // BLOCK_ROWS) or 1
    q_blocks = max(-(-n // BLOCK_ROWS), min(n // 64 + 1, tasks))
    a = packed(query if "class" in query.columns else query.withColumn("class", F.lit(None).cast("string")), q_blocks).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "m", "width")])
    b = packed(train, t_blocks)
    # every pair of blocks is a row; blocks are dealt by their number, never sent through the driver
    pairs = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1)))).join(b.hint("merge"), "block")
    pairs = pairs.repartition(max(tasks, q_blocks * t_blocks // PAIRS))
    schema = "candidate int, q long, t long, class string, d double, rank int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                width = r.width
                qi, ti = np.frombuffer(r.q_ids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                classes = np.array(list(r.classes), dtype=object)
                for c, w in enumerate([[1.0] * width] if candidates is None else candidates):
                    near = Near(matrix(r.q_m, r.q_width), matrix(r.m, width), kind, np.asarray(w, dtype=np.float64))
                    for at in range(0, len(qi), SLICE):
                        own = qi[at : at + SLICE]
                        i, j, d, rank = near.best(slice(at, at + SLICE), k, own if skip_self else own[:0], ti)
                        yield pd.DataFrame({"candidate": np.full(len(i), c, dtype=np.int32), "q": own[i], "t": ti[j], "class": classes[j], "d": d, "rank": rank.astype(np.int32)})

    found = pairs.mapInPandas(run, schema)
    if t_blocks == 1:
        return found
    by = Window.partitionBy("candidate", "q").orderBy("d", "t")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rows_within(query: DataFrame, train: DataFrame, most: float, kind: str) -> DataFrame:
    """(q, t, d) of all pairs nearer than ``most``."""
    n, m = query.count(), train.count()
    tasks = query.sparkSession.sparkContext.defaultParallelism
    t_blocks, q_blocks = max(-(-m // BLOCK_ROWS), min(m // 64 + 1, tasks)), -(-n // BLOCK_ROWS) or 1
    a, b = (packed(df.select("id", F.lit("").alias("class"), "features"), blocks) for df, blocks in ((query, q_blocks), (train, t_blocks)))
    a = a.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "m", "width")])
    pairs = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1)))).join(b.hint("merge"), "block").drop("classes")
    pairs = pairs.repartition(max(tasks, q_blocks * t_blocks // PAIRS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qi, ti = np.frombuffer(r.q_ids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                near = Near(matrix(r.q_m, r.q_width), matrix(r.m, r.width), kind, np.ones(r.width))
                limit = (most * most if kind == "l2" else most) / near.unit
                for at in range(0, len(qi), SLICE):
                    rows = slice(at, at + SLICE)
                    i, j = near.under(near.rough(rows), limit)
                    d = near.exact(rows, i, j)
                    ok = d < most
                    yield pd.DataFrame({"q": qi[rows][i[ok]], "t": ti[j[ok]], "d": d[ok]})

    return pairs.mapInPandas(run, "q long, t long, d double")


# --- all pairs within groups -----------------------------------------------------------------------

#: Rows of a block of which all distances to another are held.
PAIR_ROWS = 2048


def block_pairs(images: DataFrame, within: str | None, rows: int = PAIR_ROWS) -> DataFrame:
    """(g, blocks, same, ids, m, width, b_ids, b_m): every two blocks of a group of images once, and each with itself.

    A group of up to ``rows`` rows is one block; larger ones are dealt over as many as they need.
    """
    own = images.select((F.col(within) if within else F.lit(0)).alias("g"), F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("f"))
    blocks = own.groupBy("g").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    dealt = own.join(blocks.hint("merge"), "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = dealt.groupBy("g", "blocks", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("f").alias("f"))
    a = held.where("blocks = 1").select("g", "blocks", F.lit(True).alias("same"), "ids", "f", F.lit(None).cast("array<long>").alias("b_ids"), F.lit(None).cast("array<array<double>>").alias("b_f"))
    large = held.where("blocks > 1")
    left = large.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = large.select("g", F.col("block").alias("other"), F.col("ids").alias("b_ids"), F.col("f").alias("b_f"))
    b = left.join(right.hint("merge"), ["g", "other"]).select("g", "blocks", (F.col("block") == F.col("other")).alias("same"), "ids", "f", "b_ids", "b_f")
    n = large.agg(F.sum(F.col("blocks") + 1)).first()[0] or 0
    return a.unionByName(b.repartition(max(images.sparkSession.sparkContext.defaultParallelism, n // 2 // PAIRS))) if n else a


def over_pairs(pairs: DataFrame, make, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (g, blocks, *) of the arrays that ``make(ids, m, b_ids, b_m, *more)`` yields for each row of ``block_pairs``; b_ids is None for a block with itself. Ids ascend."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    group = pairs.schema["g"].dataType.simpleString()

    def block(ids, f) -> tuple[np.ndarray, np.ndarray]:
        ids, m = np.asarray(ids, dtype=np.int64), np.array(list(f), dtype=np.float64)
        order = np.argsort(ids, kind="stable")
        return ids[order], m[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = block(r.ids, r.f), (None, None) if r.same else block(r.b_ids, r.b_f)
                for made in make(*a, *b, *(getattr(r, c) for c in more)):
                    out.append(pd.DataFrame({"g": r.g, "blocks": r.blocks, **dict(zip(names, made, strict=True))}))
                if len(out) >= 256:
                    yield pd.concat(out, ignore_index=True)
                    out = []
            if out:
                yield pd.concat(out, ignore_index=True)

    return pairs.mapInPandas(run, f"g {group}, blocks int, {schema}")


def spanning(ids: np.ndarray, m: np.ndarray, b_ids: np.ndarray | None, b_m: np.ndarray | None, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, cost): the minimum spanning tree of all distances of a block, or of those between two; equal costs are told apart by the ends.

    Prim's walk: each step takes the cheapest edge to a row outside and looks at that row's distances only.
    """
    n = len(ids)
    names = ids if b_ids is None else np.concatenate([ids, b_ids])
    d = distances(m, m if b_m is None else b_m, kind, np.ones(m.shape[1]))
    outside = np.ones(len(names), dtype=bool)
    best, by = np.full(len(names), np.inf), np.zeros(len(names), dtype=np.int64)
    src, dst, cost = [], [], []
    at = 0
    for _ in range(len(names) - 1):
        outside[at], best[at] = False, np.inf
        near = slice(0, len(names)) if b_ids is None else slice(n, len(names)) if at < n else slice(0, n)
        new = d[at] if b_ids is None or at < n else d[:, at - n]
        old = best[near]
        better = outside[near] & (new < old)
        equal = np.flatnonzero(outside[near] & (new == old))
        if len(equal):
            x, p, q = names[near][equal], names[at], names[by[near][equal]]
            lo, hi, old_lo, old_hi = np.minimum(x, p), np.maximum(x, p), np.minimum(x, q), np.maximum(x, q)
            better[equal] = (lo < old_lo) | ((lo == old_lo) & (hi < old_hi))
        old[better] = new[better]
        by[near][better] = at
        at = int(np.argmin(best))
        ties = np.flatnonzero(best == best[at])
        if len(ties) > 1:
            p, q = names[ties], names[by[ties]]
            at = int(ties[np.lexsort((np.maximum(p, q), np.minimum(p, q)))[0]])
        p, q = names[at], names[by[at]]
        src.append(min(p, q))
        dst.append(max(p, q))
        cost.append(best[at])
    return np.array(src, dtype=np.int64), np.array(dst, dtype=np.int64), np.array(cost)


def spanning_trees(images: DataFrame, kind: str, within: str | None, keep) -> DataFrame:
    """(src, dst, cost): the minimum spanning tree of all distances in each group, all rows' without ``within``.

    An edge that isn't in the tree of some of the edges isn't in that of all, so each two blocks send on their own tree;
    memory is bounded by two blocks and what is written is the number of pairs over the size of a block.
    """
    from .graph import minimum_spanning_tree

    found = keep(over_pairs(block_pairs(images, within), lambda *a: [spanning(*a, kind)], "src long, dst long, cost double"), "trees")
    whole = found.where("blocks = 1").select("src", "dst", "cost")
    parts = found.where("blocks > 1").select("src", "dst", "cost")
    return whole if parts.isEmpty() else whole.unionByName(minimum_spanning_tree(parts, keep))


def distance_slices(kind: str):
    """For ``over_pairs``: the distances of each pair of rows, a slice at a time."""

    def each(ids: np.ndarray, m: np.ndarray, b_ids: np.ndarray | None, b_m: np.ndarray | None) -> Iterator[np.ndarray]:
        for at in range(0, len(ids), SLICE):
            d = distances(m[at : at + SLICE], m[at:] if b_m is None else b_m, kind, np.ones(m.shape[1]))
            yield d[np.triu_indices(len(d), 1, d.shape[1])] if b_m is None else d.ravel()

    return each


def bins(d: np.ndarray) -> np.ndarray:
    """Numbers that ascend with distances: exponents and the first 12 bits of mantissas."""
    return (d + 0.0).view(np.int64) >> 40


def pair_statistics(images: DataFrame, kind: str, within: str, keep) -> DataFrame:
    """(g, n, mean, stdev, median) of the distances of all pairs in each group that has one.

    The median is exact: counts by bins tell which bins hold it, and only their distances are collected.
    """
    pairs, each = keep(block_pairs(images, within), "pairs"), distance_slices(kind)

    def summed(*block) -> Iterator[tuple]:
        n, mean, m2, counts = 0, 0.0, 0.0, []
        for d in each(*block):
            if len(d):
                own = d.mean()
                m2 += ((d - own) ** 2).sum() + (own - mean) ** 2 * n * len(d) / (n + len(d))
                mean += (own - mean) * len(d) / (n + len(d))
                n += len(d)
                b = bins(d)
                low = int(b[b > 0].min(initial=1 << 40))
                own = np.bincount(np.where(b > 0, b - low + 1, 0))
                at = np.flatnonzero(own)
                counts.append((np.where(at > 0, at - 1 + low, 0), own[at]))
        if n:
            at, where = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
            own = np.bincount(where, weights=np.concatenate([c[1] for c in counts])).astype(np.int64)
            first = np.arange(len(at)) == 0
            yield at, own, np.where(first, n, 0), np.where(first, mean, 0.0), np.where(first, m2, 0.0)

    found = keep(over_pairs(pairs, summed, "bin long, n long, total long, mean double, m2 double"), "bins")
    means = found.groupBy("g").agg(F.sum("total").alias("n"), (F.sum(F.col("total") * F.col("mean")) / F.sum("total")).alias("mean"))
    # a block's squares about its own mean, moved to the group's
    squares = found.where("total > 0").join(means.select("g", F.col("mean").alias("c")).hint("merge"), "g").groupBy("g").agg(F.sum(F.col("m2") + F.col("total") * F.pow(F.col("mean") - F.col("c"), F.lit(2.0))).alias("m2"))
    each_bin = found.groupBy("g", "bin").agg(F.sum("n").alias("n"))
    upto = each_bin.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    before = F.col("upto") - F.col("n")
    hold = keep(upto.where(((before <= low) & (low < F.col("upto"))) | ((before <= high) & (high < F.col("upto")))).select("g", "bin", before.alias("before"), low.alias("low"), high.alias("high")), "middle")
    wanted = hold.groupBy("g").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"))

    def middle(ids, m, b_ids, b_m, b0, b1) -> Iterator[tuple]:
        for d in each(ids, m, b_ids, b_m):
            b = bins(d)
            v, n = np.unique(d[(b == b0) | (b == b1)], return_counts=True)
            if len(v):
                yield v, bins(v), n

    values = over_pairs(pairs.join(wanted.hint("merge"), "g"), middle, "d double, bin long, n long", ("b0", "b1")).groupBy("g", "bin", "d").agg(F.sum("n").alias("n"))
    placed = values.join(hold.hint("merge"), ["g", "bin"]).withColumn("end", F.sum("n").over(Window.partitionBy("g", "bin").orderBy("d")) + F.col("before"))
    at = lambda c: F.max(F.when((F.col("end") - F.col("n") <= F.col(c)) & (F.col(c) < F.col("end")), F.col("d")))
    medians = placed.groupBy("g").agg(((at("low") + at("high")) / 2).alias("median"))
    stdev = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return means.join(squares, "g").join(medians, "g").select("g", "n", "mean", stdev.alias("stdev"), "median")
