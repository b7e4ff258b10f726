"""SimHash near-duplicates by multi-index hashing.

Fingerprints at 4 or fewer differing bits link. A fingerprint is cut in two segments of 32 bits: a
linked pair differs by at most 2 bits in the upper one or at most 1 in the lower (else by 3 + 2). For
the upper, both sides look up their Hamming balls of radius 1 (a pair 2 apart meets in the middle); for
the lower, one side its ball of radius 1 and the table the segment itself. Pairs that meet are verified
on all 64 bits. A bucket of many fingerprints would emit all its pairs; its members instead list every
64-bit point within 2 bits, and those that list the same point are linked with its smallest: fingerprints
within 4 bits always share such a point and those that share one always are within 4, so no link is lost
and none is invented, in rows that are linear in the bucket.

Spark takes a table's size from its compressed files and doesn't count what explode adds, so it would send
tables of millions of rows through the driver; joins of tables that grow with the corpus are merged instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import join_hot, map_rows, materialize, space_words

NEAR = 4
#: Above so many fingerprints a bucket lists points instead of pairs.
PAIRWISE = 48


def fingerprint(raw: bytes | None, width: int = 4) -> int:
    """Majority of the bits of the XXH64 (seed 42) of the text's word shingles, as a signed 64-bit number."""
    words = space_words(raw.lower()) if raw else []
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - width + 1
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, raw in rows:
            yield doc_id, fingerprint(raw)

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, fp long", binary=("text",))


def bit(k: str) -> str:
    return f"CASE WHEN {k} = 64 THEN 0L ELSE shiftleft(1L, {k}) END"


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): linked fingerprints, enough of them to connect all that are linked. distinct: one row per ``fp``."""
    upper = F.expr("shiftrightunsigned(fp, 32)")
    lower = F.expr("fp & 4294967295L")
    flips = F.explode(F.sequence(F.lit(0), F.lit(32))).alias("flip")
    flip = F.expr("CASE WHEN flip = 32 THEN 0L ELSE shiftleft(1L, flip) END")
    balls = distinct.select("fp", upper.alias("u"), lower.alias("l"), flips)
    keyed = balls.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.col("u").bitwiseXOR(flip).alias("key"), F.lit(True).alias("table")),
                F.struct((F.col("l").bitwiseXOR(flip) + F.lit(1 << 32)).alias("key"), (F.col("flip") == 32).alias("table")),
            )
        ).alias("x"),
    ).select("fp", "x.key", "x.table")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("table").cast("int")).alias("tables")).where("n > 1 and tables > 0")
    met = materialize(keyed.join(buckets.hint("merge"), "key").select("key", "fp", "table", "n"), "met")
    small = met.where(F.col("n") <= PAIRWISE).select("key", "fp", "table")
    other = small.select("key", F.col("fp").alias("b"), F.col("table").alias("other"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= NEAR
    pairs = small.join(other.hint("merge"), "key").where((F.col("fp") < F.col("b")) & (F.col("table") | F.col("other")) & near).select(F.col("fp").alias("a"), "b")
    dense = met.where(F.col("n") > PAIRWISE).select("fp").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64))))
    dense = dense.withColumn("j", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))))
    points = dense.select("fp", F.expr(f"fp ^ ({bit('i')}) ^ ({bit('j')})").alias("point"))
    stars = points.groupBy("point").agg(F.collect_set("fp").alias("own")).where("size(own) > 1")  # at most 2081 share a point
    stars = stars.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp and component_id, the smallest doc_id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Null ids never are the smallest
    unless all of a component are null, which makes its component_id null. Texts of any length are read whole. Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    """
    own = materialize(fingerprints(docs), "fingerprints")
    first = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    stars = connected_components(links(first.select("fp")), materialize)
    member = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    lowest = materialize(member.join(first.hint("merge"), "fp").groupBy("root").agg(F.min("first").alias("lowest"), F.count("*").alias("n")), "lowest")
    of = join_hot(member, lowest, "root", "n", member.count()).select("fp", "lowest")
    ids = materialize(first.join(of.hint("merge"), "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id")), "components")
    return join_hot(own, ids, "fp", "n", own.count()).select("doc_id", "fp", "component_id")


def fingerprint_hex():
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))
