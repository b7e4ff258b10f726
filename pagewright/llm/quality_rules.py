"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule rejects a document whose statistic exceeds a cutoff of a fixed grid. On labelled good
documents of a stratum, a cutoff is accepted only if the exact binomial test rejects "false
rejection rate > alpha" at level delta. The grid is walked from the loosest cutoff and stops at the
first that fails (fixed-sequence testing, no further correction within a rule); across rules and
strata the level is Bonferroni-corrected, and alpha is shared among the rules, so with probability
1 - delta no stratum loses more than alpha of its good documents to the rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\v\f"
#: Cutoffs of each rule, loosest first.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "long_words": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


class Ids(dict):
    """Numbers keys in the order they are first seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeated_words(words: list[bytes]) -> int:
    """Words lying in a 3-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids = Ids()
    w = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
    size = len(ids)
    pair = w[:-1] * size + w[1:]
    if size > 2_000_000:  # the key of three would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS; null counts as empty."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def base_statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, stratum and STATS of the whole text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, name, text in rows:
            yield doc_id, name, *text_stats(text)

    picked = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    return map_rows(picked, run, f"doc_id long, stratum string, {STATS}")


def level(rule: str):
    """Column: index of the first (loosest) cutoff of the rule's grid that the row exceeds, or its length."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    value = {
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "capitals": part("n_capitals", "word_chars"),
        "long_words": part("word_chars", "n_words"),
    }[rule]
    out = F.lit(len(GRIDS[rule]))
    for at in reversed(range(len(GRIDS[rule]))):
        out = F.when(value > GRIDS[rule][at], F.lit(at)).otherwise(out)
    return out.cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in the log domain."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    logs = log_fact[n] - log_fact[i] - log_fact[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(math.exp(top) * np.exp(logs - top).sum())


def least_size(alpha: float, delta: float) -> int:
    """Good documents that a stratum needs for any cutoff to pass, even with none of them rejected."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def accepted_cutoff(counts: dict[int, int], n: int, size: int, alpha: float, delta: float) -> int:
    """The last index of the grid up to which every cutoff passes the exact test; -1 if none does.

    counts: good documents by the index of the first cutoff that rejects them.
    """
    low, high = -1, n  # the largest count of rejections that passes
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if binomial_cdf(mid, n, alpha) <= delta else (low, mid)
    got = -1
    lost = 0
    for at in range(size):
        lost += counts.get(at, 0)
        if lost > low:
            break
        got = at
    return got


def select_cutoffs(levels: DataFrame, alpha: float = 0.02, delta: float = 0.1) -> tuple[DataFrame, int]:
    """levels: rows of good documents (stratum, one column of ``level`` per rule).

    Returns (stratum, cut: index of the accepted cutoff per rule, -1 where none) and the number of strata.
    Strata of fewer documents than any cutoff needs, even if it rejects none of them, share the cutoffs of
    their pool, whose guarantee is on the pool. Only histograms, bounded by the grids, are gathered; each stratum's is handled in one call.
    """
    rules = list(GRIDS)
    long = levels.select("stratum", F.posexplode(F.array(*rules)).alias("rule", "at"))
    hist = materialize(long.groupBy("stratum", "rule", "at").agg(F.count("*").alias("n")), "histogram")
    strata = hist.select("stratum").distinct().count()
    a, d = alpha / len(rules), delta / max(1, len(rules) * strata)

    sizes = hist.where("rule = 0").groupBy("stratum").agg(F.sum("n").alias("size"))
    members = sizes.select("stratum", (F.col("size") < least_size(a, d)).alias("pooled")).withColumn("own", F.when(~F.col("pooled"), F.col("stratum")))
    owned = members.withColumnRenamed("stratum", "of")
    pools = hist.join(owned, F.col("stratum").eqNullSafe(F.col("of"))).groupBy("pooled", "own", "rule", "at").agg(F.sum("n").alias("n"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        cut = []
        for k, rule in enumerate(rules):
            own = pdf[pdf["rule"] == k]
            counts = dict(zip(own["at"].tolist(), own["n"].tolist(), strict=True))
            cut.append(accepted_cutoff(counts, int(own["n"].sum()), len(GRIDS[rule]), a, d))
        return pd.DataFrame({"by_pool": [pdf["pooled"].iloc[0]], "by": [pdf["own"].iloc[0]], "cut": [cut]})

    cuts = pools.groupBy("pooled", "own").applyInPandas(pick, "by_pool boolean, by string, cut array<int>")
    same = (F.col("pooled") == F.col("by_pool")) & F.col("own").eqNullSafe(F.col("by"))
    return members.join(cuts, same).select("stratum", "cut"), strata


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.1, max_broadcast: int = 50_000) -> DataFrame:
    """Base statistics, the base rule and the risk-controlled verdict, one row per row of ``docs``.

    Null text counts as empty (base_failed). A null stratum is a stratum of its own. Strata with too
    few labelled good documents for cutoffs of their own share their pool's; where the pool is too small
    as well, or a stratum has none, nothing is rejected beyond the base rule. A document
    labelled more than once is good if any label says so; null labels are ignored. Extra columns of
    ``docs`` are ignored; a repeated row gives a repeated result; empty tables give an empty result.
    """
    base = base_statistics(docs, stratum)
    for rule in GRIDS:
        base = base.withColumn(rule, level(rule))
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    base = materialize(base, "rules")
    good = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("good")).where("good = 1")
    held = base.where("not base_failed").join(good, F.col("doc_id") == F.col("labelled")).select("stratum", *GRIDS)
    cuts, strata = select_cutoffs(held, alpha, delta)
    cuts = cuts.withColumnRenamed("stratum", "s")
    if strata <= max_broadcast:
        joined = base.join(F.broadcast(cuts), F.col("stratum").eqNullSafe(F.col("s")), "left")
    else:  # too many strata to broadcast: spread each stratum's documents over salted copies of its cutoffs
        salted = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        own = base.withColumn("of", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int"))
        joined = own.join(salted, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("of") == F.col("salt")), "left").drop("of", "salt")
    passed = F.lit(True)
    for k, rule in enumerate(GRIDS):
        passed = passed & (F.col(rule) > F.coalesce(F.col("cut")[k], F.lit(-1)))
    return joined.withColumn("kept", ~F.col("base_failed") & passed).drop("s", "cut")
