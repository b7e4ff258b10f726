"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut into blocks of whole documents; each block stores, for every term that the
test set uses, the ascending list of its positions (a term that no test text holds can never be looked
up, so its list is not kept). A query window takes the lists of its terms from the rarest on, shifts
each by the term's offset, and intersects: what survives all ten are exact phrase matches; with a slop,
proximity matches. Blocks are searched independently, so no term's list ever has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, identified, map_rows, materialize

#: A block ends once it holds so many bytes of text or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 60_000
#: Words of the test set that one pass over the index looks up; a larger test set takes several passes.
PASS_WORDS = 1_000_000


@dataclass
class Windows:
    """Distinct windows of one pass: term numbers (-1 pads short ones) and the items that hold each."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    items: list[list[int | None]]


def windows_of(items: list[tuple[int | None, bytes | None]], length: int) -> Windows:
    vocabulary: dict[bytes, int] = {}
    of: dict[tuple[int, ...], dict] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words(text)]
        if not ids:
            continue
        for k in range(max(1, len(ids) - length + 1)):
            of.setdefault(tuple(ids[k : k + length]), {})[item] = None
    terms = np.full((len(of), length), -1, dtype=np.int64)
    for k, w in enumerate(of):
        terms[k, : len(w)] = w
    return Windows(vocabulary, terms, [list(x) for x in of.values()])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int = 1) -> DataFrame:
    """Postings (block, term, n, positions: ascending uint32) and one row per block with term null and its documents.

    docs: file and row, which name a row for good, doc_id, text. Positions count words through the block with ``gap``
    empty places after each document. Blocks are cut anew by each index: only (file, row) is common to two of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by PASS_WORDS

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = shared.value.get
        spelled = [w.decode("utf-8", "replace") for w in shared.value]
        block, docs_, ids, places, size, base = None, [], [], [], 0, 0

        def end() -> Iterator[tuple]:
            term = np.concatenate(ids)
            place = np.concatenate(places)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(term)) + 1
            for own, t in zip(np.split(place, cuts), term[np.concatenate([[0], cuts])] if len(term) else (), strict=False):
                yield block, spelled[t], int(t), len(own), own.tobytes(), None
            yield block, None, None, len(docs_), None, docs_

        for number, file, row, doc_id, raw in rows:
            if block is None:
                block = number
            words = alnum_words(raw)
            found = np.fromiter(map(known, words, repeat(-1)), dtype=np.int32, count=len(words))
            at = np.flatnonzero(found >= 0)
            ids.append(found[at])
            places.append(at + base)
            docs_.append({"file": file, "row": row, "doc_id": doc_id, "n_words": len(words)})
            base += len(words) + gap
            size += len(raw or b"")
            if size >= BLOCK_BYTES or len(docs_) >= BLOCK_DOCS:
                yield from end()
                block, docs_, ids, places, size, base = None, [], [], [], 0, 0
        if block is not None:
            yield from end()

    picked = docs.select(F.monotonically_increasing_id().alias("number"), "file", "row", "doc_id", "text")
    schema = "block long, term string, number int, n long, positions binary, docs array<struct<file:long,row:long,doc_id:long,n_words:long>>"
    return materialize(map_rows(picked, run, schema, binary=("text",)), "postings")


def search_block(pdf: pd.DataFrame, windows: np.ndarray, offsets: np.ndarray, gap: int, slop: int) -> Iterator[tuple[int, list, list]]:
    """(document's place in the block, covered intervals, numbers of matching windows) of one block.

    windows, offsets: term numbers and their offsets in the window, each row from the rarest term on; -1 pads.
    """
    head = pdf["docs"].notna()
    lengths = np.array([d["n_words"] for d in pdf.loc[head, "docs"].iloc[0]], dtype=np.int64)
    lists = pdf[~head].sort_values("number")
    if lists.empty:
        return
    number = lists["number"].to_numpy(dtype=np.int64)
    count = lists["n"].to_numpy(dtype=np.int64)
    places = np.frombuffer(b"".join(lists["positions"]), dtype=np.uint32).astype(np.int64)
    keys = np.repeat(number, count) << 32 | places
    size = int(windows.max()) + 2
    first, many = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    inside = number < size
    first[number[inside]] = (np.cumsum(count) - count)[inside]
    many[number[inside]] = count[inside]
    many[-1] = 1  # the pad is everywhere
    alive = np.flatnonzero((many[windows] > 0).all(axis=1))
    word_length = (windows >= 0).sum(axis=1)
    base = np.cumsum(lengths + gap) - (lengths + gap)
    total = int((lengths + gap).sum())
    edge = np.zeros(total + windows.shape[1] + 1, dtype=np.int64)
    hits: list[np.ndarray] = []
    load = np.cumsum(many[windows[alive, 0]])
    for part in np.split(alive, np.searchsorted(load, np.arange(2_000_000, load[-1] if len(load) else 0, 2_000_000))):
        if not len(part):
            continue
        n = many[windows[part, 0]]
        which = np.repeat(part, n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start = places[first[windows[which, 0]] + within] - offsets[which, 0]
        for j in range(1, windows.shape[1]):
            term = windows[which, j]
            low = term << 32 | np.maximum(start + offsets[which, j] - slop, 0)
            at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            ok = (term < 0) | (keys[at] >= low) & (keys[at] <= low + 2 * slop) & (start + offsets[which, j] >= 0)
            which, start = which[ok], start[ok]
        start = np.maximum(start, 0)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + word_length[which], -1)
        doc = np.searchsorted(base, start, side="right") - 1
        hits.append(np.unique(doc * len(windows) + which))
    pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
    if not len(pairs):
        return
    covered = np.cumsum(edge) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    owner = np.searchsorted(base, starts, side="right") - 1
    by_doc = np.split(pairs % len(windows), np.flatnonzero(np.diff(pairs // len(windows))) + 1)
    for doc, own in zip(np.unique(pairs // len(windows)).tolist(), by_doc, strict=True):
        a, b = np.searchsorted(owner, [doc, doc + 1])
        limit = base[doc] + lengths[doc]
        spans = [{"s": int(s - base[doc]), "e": int(min(e, limit) - base[doc])} for s, e in zip(starts[a:b], ends[a:b], strict=True)]
        yield doc, spans, own.tolist()


def search_index(index: DataFrame, found: Windows, gap: int = 1, slop: int = 0) -> DataFrame:
    """(block, place, spans, items) for every document with a match: covered word intervals and item ids."""
    spark = index.sparkSession
    known = {r["number"]: r["n"] for r in index.where("term is not null").groupBy("number").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    often = np.array([known.get(k, 0) for k in range(len(found.vocabulary))] + [2**62], dtype=np.int64)
    rank = np.argsort(often[found.terms], axis=1, kind="stable") if len(found.terms) else np.zeros((0, 1), dtype=np.int64)
    sorted_terms = np.take_along_axis(found.terms, rank, axis=1) if len(found.terms) else np.full((0, 1), -1)
    keep = (often[sorted_terms] > 0).all(axis=1)
    sorted_terms, rank = sorted_terms[keep], rank[keep]
    items = [x for x, k in zip(found.items, keep, strict=True) if k]
    shared = spark.sparkContext.broadcast((sorted_terms, rank, items))  # bounded by PASS_WORDS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        terms, offsets, of = shared.value
        out = []
        if len(terms):
            for doc, spans, which in search_block(pdf, terms, offsets, gap, slop):
                out.append((int(pdf["block"].iloc[0]), doc, spans, list(dict.fromkeys(x for w in which for x in of[w]))))
        return pd.DataFrame(out, columns=["block", "place", "spans", "items"])

    return index.groupBy("block").applyInPandas(run, "block long, place int, spans array<struct<s:long,e:long>>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, slop: int = 0, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (words hit), items (ids that occur), n_hit, n_items, items_sha256, contaminated.

    A text that is null or has no word matches nothing; very long texts are searched whole, a block of their own.
    A null item_id still hits words but isn't listed; repeated items count once. Repeated documents give
    repeated results; other columns are ignored; with an empty test set all documents are clean.
    ``pass_words`` bounds the words of the test set that one pass over the index looks up.
    """
    texts = benchmark.select("item_id", F.col("text").cast("binary").alias("raw"))
    words = texts.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("n")).first()["n"] // 3
    passes = int(words // pass_words) + 1
    known, (file, row) = identified(docs.select("doc_id", "text"))
    known = known.select(F.col(file).alias("file"), F.col(row).alias("row"), "doc_id", "text")
    parts = []
    for k in range(passes):
        own = texts if passes == 1 else texts.where(F.pmod(F.xxhash64("raw"), F.lit(passes)) == k)
        found = windows_of([(r["item_id"], bytes(r["raw"]) if r["raw"] is not None else None) for r in own.toLocalIterator()], length)
        index = build_index(known, found.vocabulary, gap=slop + 1)
        own = index.where("term is null").select("block", F.posexplode("docs").alias("place", "d")).select("block", "place", "d.file", "d.row", "d.doc_id", "d.n_words")
        parts.append((own, search_index(index, found, slop + 1, slop)))
    heads, hits = parts[0]
    if passes == 1:
        out = heads.join(hits, ["block", "place"], "left")
    else:
        hits = reduce(DataFrame.unionByName, [a.join(b, ["block", "place"]).select("file", "row", "spans", "items") for a, b in parts])
        hits = hits.groupBy("file", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        out = heads.join(hits, ["file", "row"], "left")
    spans = F.array_sort(F.coalesce("spans", F.array().cast("array<struct<s:long,e:long>>")))
    items = F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<long>")), lambda x: x.isNotNull()))
    out = out.withColumn("spans", spans).withColumn("items", items)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["to"], x["e"]).alias("to"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n")),
        lambda acc: acc["n"],
    )
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "spans",
        "items",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )
