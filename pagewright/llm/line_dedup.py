"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its words, lower-cased (A-Z). Lines of fewer than ``shortest`` words go only if an earlier line
is equal, and only those of ``equal`` words or more; lines of no word stay. Any other line goes if an earlier line of the corpus (by doc_id, then line) is equal or one word edit away (a word inserted,
deleted or replaced; of five words or more, so at least 0.8 of it is the same).

Lines one replacement apart leave the same words when the same place is deleted; of lines one insertion
apart, the longer one leaves the shorter when that place is deleted. So every line emits its words without
one, hashed together with the place, and hashed alone beside the whole line's hash: lines that meet under
a key are near, each needs only the earliest it meets, and no pairs are listed however many meet. The
earliest is verified by its edit distance.

Only lines that can have a neighbour emit, and only the deletions that can meet it: a single edit leaves the
line's first or last half as it is, so a line emits deletions behind a first half and before a last half that
another line has as well (exactly: no neighbour is lost). The lines that emit are found again in the texts by
a filter in memory, sized by their number; beyond FILTER_PLACES of them by a join with the texts.

Texts that lose lines are found by such a filter as well, so only they are shuffled to meet their lines' numbers.

A row is named by its file and its place in it (``common.identified``), so all scans agree on it however the
files are split and whichever executors are lost. Keys that many lines share are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, identified, join_hot, map_rows, materialize

SHORTEST = 5
#: Emitting halves up to which their lines are found by a filter of 16 bits each, 32 MB at most.
FILTER_PLACES = 1 << 24
#: Bits that one row of the filter holds.
SLICE = 1 << 18
LAST = 2**63 - 1
PLACE = "struct<doc:long,file:long,row:long,line:int>"
#: Lowest bits of keys: a half's side; what a variant is.
FIRST, FINAL = 0, 1
PLACED, WHOLE, WITHOUT = 0, 1, 2


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def digest(words: list[bytes], seed: int = 0) -> int:
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words), seed))


def line_words(line: bytes, shortest: int) -> list[bytes] | None:
    words = line.lower().split()
    return words if len(words) >= shortest else None


def half_keys(words: list[bytes]) -> set[int]:
    """Hashes of which lines one edit apart share at least one; the lowest bit is the side."""
    n = len(words)
    first = {digest(words[:k], 1) & ~1 | FIRST for k in {n // 2, (n - 1) // 2}}
    return first | {digest(words[-k:], 2) & ~1 | FINAL for k in {(n + 1) // 2, n // 2}}


def slots_of(file: int, row: int, line: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Two numbers of 32 bits for each side of a line, for the filter."""
    h = xxhash.xxh3_128_intdigest(b"%d %d %d" % (file, row, line))
    return (h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF), (h >> 64 & 0xFFFFFFFF, h >> 96)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def all_lines(texts: DataFrame, shortest: int, equal: int) -> DataFrame:
    """(hash, at, halves) of every line of at least ``equal`` words; no halves below ``shortest``. texts: file, row, doc_id, text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, row, doc_id, raw in rows:
            for k, line in enumerate((raw or b"").split(b"\n")):
                if words := line_words(line, equal):
                    halves = list(half_keys(words)) if len(words) >= shortest else []
                    yield digest(words), {"doc": LAST if doc_id is None else doc_id, "file": file, "row": row, "line": k}, halves

    return map_rows(texts, run, f"hash long, at {PLACE}, halves array<long>", binary=("text",))


def filter_of(places: DataFrame, n: int) -> np.ndarray:
    """A bit array with two bits set for each of the n sides of lines that emit, in whole slices."""
    size = max(SLICE, 1 << (16 * n - 1).bit_length())

    def positions(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, row, line, *sides in rows:
            for own, x in zip(sides, slots_of(file, row, line), strict=True):
                if own:
                    for bit in x:
                        yield bit % size // SLICE, bit % size % SLICE

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SLICE, dtype=np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    set_ = map_rows(places.select("at.file", "at.row", "at.line", "first", "final"), positions, "slice int, bit int")
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in set_.groupBy("slice").applyInPandas(pack, "slice int, bits binary").collect():  # the filter itself
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def variants(texts: DataFrame, emit: DataFrame, shortest: int, most: int = FILTER_PLACES) -> DataFrame:
    """(at, words, keys) of the lines that ``emit`` lists (at, first, final: the sides that others share), and of a few more by chance."""
    schema = f"at {PLACE}, words binary, keys array<long>"
    n = emit.select(F.coalesce(F.sum(F.col("first").cast("int") + F.col("final").cast("int")), F.lit(0))).first()[0]

    def made(file: int, row: int, doc_id: int | None, k: int, words: list[bytes], first: bool, final: bool) -> tuple:
        return {"doc": LAST if doc_id is None else doc_id, "file": file, "row": row, "line": k}, b" ".join(words), keys_of(words, first, final)

    if n <= most:
        bits = texts.sparkSession.sparkContext.broadcast(filter_of(emit, n))  # 2 bytes for each of at most FILTER_PLACES

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            own = bits.value
            size = len(own) * 8
            has = lambda x: own[(a := x[0] % size) >> 3] >> (a & 7) & 1 and own[(b := x[1] % size) >> 3] >> (b & 7) & 1
            for file, row, doc_id, raw in rows:
                for k, line in enumerate((raw or b"").split(b"\n")):
                    first, final = map(has, slots_of(file, row, k))
                    if (first or final) and (words := line_words(line, shortest)):
                        yield made(file, row, doc_id, k, words, first, final)

        return map_rows(texts, run, schema, binary=("text",))

    def of_list(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, row, doc_id, raw, places in rows:
            pieces = (raw or b"").split(b"\n")
            for x in places:
                yield made(file, row, doc_id, x["line"], line_words(pieces[x["line"]], shortest), x["first"], x["final"])

    listed = emit.groupBy(F.col("at.file").alias("file"), F.col("at.row").alias("row")).agg(F.collect_list(F.struct("at.line", "first", "final")).alias("places"))
    return map_rows(texts.join(listed, ["file", "row"]).select("file", "row", "doc_id", "text", "places"), of_list, schema, binary=("text",))


def keys_of(words: list[bytes], first: bool = True, final: bool = True) -> list[int]:
    """The line's hash and its deletion neighbourhood as hashes, bare and with the place; the lowest two bits say which.

    first: an edit may lie behind the first half; final: one may lie before the last half.
    """
    n = len(words)
    out = {digest(words, 3) & ~3 | WHOLE}
    for k in range(0 if final else (n - 1) // 2, n if first else (n + 1) // 2):
        rest = b" ".join(words[:k] + words[k + 1 :])
        out.add(signed(xxhash.xxh3_64_intdigest(rest, 3)) & ~3 | WITHOUT)
        out.add(signed(xxhash.xxh3_64_intdigest(rest, 4 + k)) & ~3 | PLACED)
    return list(out)


def duplicate_lines(texts: DataFrame, shortest: int = SHORTEST, equal: int = 1, most: int = FILTER_PLACES) -> DataFrame:
    """(file, row, lines): the line numbers to drop in each row of ``texts`` (file, row, doc_id, text) that loses some."""
    lines = materialize(all_lines(texts, shortest, equal), "lines")
    first = lines.groupBy("hash").agg(F.min(F.struct("at", "halves")).alias("x"), F.count("*").alias("n"))  # copies of a line share their halves
    distinct = materialize(first.select("hash", "x.at", "x.halves", "n"), "distinct")
    keyed = distinct.select("at", F.explode("halves").alias("half"))
    shared = materialize(keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"), "halves")
    side = F.col("half").bitwiseAND(F.lit(1))
    emit = join_hot(keyed, shared, "half", "n", distinct.count()).groupBy("at").agg(F.max(side == FIRST).alias("first"), F.max(side == FINAL).alias("final"))
    near = materialize(variants(texts, materialize(emit, "emit"), shortest, most), "variants")
    each = near.select("at", F.explode("keys").alias("k")).select("at", F.col("k").bitwiseAND(F.lit(-4)).alias("key"), F.col("k").bitwiseAND(F.lit(3)).cast("int").alias("kind"))
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    meets = each.groupBy("key").agg(least(PLACED).alias("replaced"), least(WHOLE).alias("short"), least(WITHOUT).alias("long"), F.count("*").alias("n"))
    meets = materialize(meets.where("n > 1"), "meets")
    met = F.when(F.col("kind") == PLACED, F.col("replaced")).when(F.col("kind") == WHOLE, F.col("long")).otherwise(F.col("short"))
    witness = join_hot(each, meets, "key", "n", near.count()).select("at", met.alias("of")).where("of < at").groupBy("at").agg(F.min("of").alias("of"))
    witness = materialize(witness, "witness")
    wanted = witness.groupBy("of").agg(F.count("*").alias("n"))
    earlier = materialize(wanted.join(near.select(F.col("at").alias("of"), F.col("words").alias("earlier")), "of"), "earlier")
    candidates = join_hot(witness.join(near.select("at", "words"), "at"), earlier, "of", "n", witness.count()).select("at", "words", "earlier")

    def verify(rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, a, b in rows:
            if one_edit(a.split(b" "), b.split(b" ")):
                yield (at,)

    gone = map_rows(candidates, verify, f"at {PLACE}").withColumn("gone", F.lit(True))
    known = materialize(distinct.drop("halves").join(gone, "at", "left").where("gone or n > 1").select("hash", F.col("at").alias("first"), "n", "gone"), "known")
    drop = join_hot(lines.select("hash", "at"), known, "hash", "n", lines.count()).where("gone or at <> first")
    return drop.groupBy(F.col("at.file").alias("file"), F.col("at.row").alias("row")).agg(F.collect_set("at.line").alias("lines"))


def losing(docs: DataFrame, file: str, row: str, drop: DataFrame, n: int):
    """A condition on ``docs`` that holds for the n rows that ``drop`` (file, row) lists, and for a few more by chance."""
    places = drop.select(F.struct("file", "row", F.lit(0).alias("line")).alias("at"), F.lit(True).alias("first"), F.lit(False).alias("final"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(places, n))  # 2 bytes for each of at most FILTER_PLACES

    @F.pandas_udf("boolean")
    def has(files: pd.Series, rows: pd.Series) -> pd.Series:
        own = bits.value
        size = len(own) * 8
        slots = (slots_of(f, r, 0)[0] for f, r in zip(files, rows, strict=True))
        return pd.Series([all(own[x % size >> 3] >> (x % size & 7) & 1 for x in two) for two in slots], dtype=bool)

    return has(file, row)


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, equal: int = 1, most: int = FILTER_PLACES) -> DataFrame:
    """All columns of ``docs`` with the duplicate lines cut out of ``text``, and __n_lines and __n_dropped.

    Null text stays null with no line; an empty text is one line; null ids come last in the corpus's order; of
    lines with the same id, and of repeated rows, the one of the smaller file hash and place is the earlier, so a
    repeated row loses what its first copy holds; long lines and texts are handled whole; other columns pass
    through, whatever their names; empty tables give empty results.
    """
    known, (file, row) = identified(docs)
    drop = materialize(duplicate_lines(known.select(F.col(file).alias("file"), F.col(row).alias("row"), "doc_id", "text"), shortest, equal, most), "drop")
    n = drop.count()
    cut, n_lines, n_dropped = (free_name(known, x) for x in ("__lines", "__n_lines", "__n_dropped"))
    loses = losing(known, file, row, drop, n) if n <= most else F.lit(True)
    out = known.where(loses).join(drop.toDF(file, row, cut).hint("merge"), [file, row], "left")
    if n <= most:
        out = out.unionByName(known.where(~loses).withColumn(cut, F.lit(None).cast("array<int>")))
    pieces = F.split(F.col("text"), "\n", -1)
    kept = F.filter(pieces, lambda _, k: ~F.array_contains(cut, k))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long")
    dropped = F.when(F.col(cut).isNotNull(), F.size(cut)).otherwise(0).cast("long")
    out = out.withColumns({n_lines: lines, n_dropped: dropped, "text": text})
    return out.select(*docs.columns, n_lines, n_dropped)
