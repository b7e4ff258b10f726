"""Language-model scores: a word unigram base over the whole training part, and a causal attention model.

Words are counted over all training documents. To score, the most frequent words' counts go to every
worker (a fixed number of them); the other words of a document are joined with the rest of the table by
their hash. The attention model reads the same words, spelled as subword ids of a public tokenizer, in
overlapping windows, each token once. It starts from a fit in numpy on a bounded sample; from there every
partition goes on over every symbol of all its training documents, and the results are averaged. A word's
probability is the mean of what its spelling has in this model and of its share of all training words, so
what the score learns from grows with the corpus.
"""

from __future__ import annotations

import base64
import math
import os
from collections import Counter
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import as_bytes, crc_mod, map_rows, materialize, smallest_hashes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts a text before it merges. Words never hold a space and stand one space apart, so every
#: piece lies within one word; other white space, which words may hold, makes pieces of its own.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+| ?[^\S ]+"""
#: The tokenizer fills arrays only beside a special token; this one holds two spaces, so no text has it.
NEVER = "  "
#: Words whose counts every worker holds.
HEAD = 1 << 18
#: Documents the attention model starts from, and the most symbols taken from them.
SAMPLE_DOCS, SAMPLE_SYMBOLS = 2_000, 3_000_000
#: Step size, and windows a step, as the partitions go on from the common start.
RATE, BATCH = 0.001, 192
#: Symbols whose windows are laid at a time.
ROUND = 300_000
#: Words that a task keeps the spelling of, and their bytes; bytes of text spelled and scored at a time (or one text, if longer).
KEPT, KEPT_BYTES, BYTES = 400_000, 16_000_000, 500_000
#: Share of a word's probability that the counts give; its spelling gives the rest.
COUNTED = 0.5
#: Above every size class of a count.
LARGEST = 1 << 20
#: The end of a text counts as a token; no word can spell it.
END_KEY = -(2**63)


def word_keys(words: Collection[bytes]) -> np.ndarray:
    """64-bit keys of words. Among 10^9 different words 0.03 pairs are expected to share one."""
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.maximum((keys ^ np.uint64(1 << 63)).view(np.int64), END_KEY + 1)


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={NEVER: max(ranks.values()) + 1})


def spell(path: str, words: list[bytes]) -> np.ndarray:
    """Subword ids of the words, each with a space before it. The pattern cuts at spaces, so words don't affect each other."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    return encoding(path).encode_to_numpy(" " + b" ".join(words).decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)


def spell_each(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the words, and where each word's begin."""
    ids = spell(path, words)
    return ids, np.flatnonzero(opening(path)[ids])


@lru_cache(maxsize=2)
def opening(path: str) -> np.ndarray:
    """Of each subword id, whether it opens with a space, as the first of each word does."""
    ranks = encoding(path)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, dtype=bool)
    out[[k for raw, k in ranks.items() if raw.startswith(b" ")]] = True
    return out


def head_counts(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted keys by the head's sorted ``keys``; not a number for keys that it doesn't have."""
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


class Words:
    """Numbers of words, and the subword ids of each number, so that a word of many texts is spelled once."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        new: list[bytes] = []

        class Number(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = out = len(self)
                new.append(word)
                return out

        self.number, self.new = Number(), new
        self.ids, self.starts, self.many = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.bytes = 0

    def full(self) -> bool:
        return len(self.number) > KEPT or self.bytes > KEPT_BYTES

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def learn(self) -> list[bytes]:
        """Spells the words that came since the last call, and returns them."""
        new = self.new[:]
        self.new.clear()
        self.bytes += sum(map(len, new))
        ids, starts = spell_each(self.path, new)
        self.starts = np.append(self.starts, starts + len(self.ids))
        self.many = np.append(self.many, np.diff(np.append(starts, len(ids))))
        self.ids = np.append(self.ids, ids)
        return new

    def spelled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words of these numbers, all of them learned, and how many each has."""
        many = self.many[numbers]
        return self.ids[np.arange(many.sum()) + np.repeat(self.starts[numbers] - (np.cumsum(many) - many), many)], many


def by_bytes(rows: Iterator[tuple], most: int = BYTES, rows_most: int = 2000) -> Iterator[list[tuple]]:
    """The rows, whose last value is a text, in lists of about ``most`` bytes."""
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += len(row[-1] or b"")
        if size > most or len(out) >= rows_most:
            yield out
            out, size = [], 0
    if out:
        yield out


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """(sub, key, c): counts of the words of all ``docs`` and of the ends of texts and, where ``sub``, of their subword ids."""

    arrow = pa.schema([("sub", pa.bool_()), ("key", pa.int64()), ("c", pa.int64())])

    def flush(counts: Counter, ends: int) -> pa.RecordBatch:
        n = len(counts)
        keys = word_keys(counts)
        values = np.fromiter(counts.values(), dtype=np.int64, count=n)
        ids, starts = spell_each(path, list(counts))  # each different word once
        times = np.bincount(ids, weights=np.repeat(values, np.diff(np.append(starts, len(ids))))).astype(np.int64)
        used = np.flatnonzero(times)
        sub = np.arange(n + 1 + len(used)) > n
        return pa.RecordBatch.from_arrays([pa.array(sub), pa.array(np.concatenate([keys, [END_KEY], used])), pa.array(np.concatenate([values, [ends], times[used]]))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for raw in as_bytes(batch.slice(at, 256).column(0)).to_pylist():
                    ends += 1
                    counts.update(words_of(raw))
                if len(counts) > 400_000:
                    yield flush(counts, ends)
                    counts.clear()
                    ends = 0
        if ends:
            yield flush(counts, ends)

    parts = docs.select("text").mapInArrow(run, "sub boolean, key long, c long")
    return parts.groupBy("sub", "key").agg(F.sum("c").alias("c"))


def symbols_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each subword id by its count in all training documents, and the log of its share of its symbol.

    The most frequent have symbols of their own; the others share OTHER in proportion to their counts plus one.
    """
    symbol = np.full(len(counts), attention.OTHER, dtype=np.int64)
    top = np.argsort(-counts, kind="stable")[: attention.SYMBOLS - 2]
    top = top[counts[top] > 0]
    symbol[top] = np.arange(2, 2 + len(top))
    rest = symbol == attention.OTHER
    share = np.zeros(len(counts))
    share[rest] = np.log((counts[rest] + 1) / (counts[rest] + 1).sum())
    return symbol, share


def fit(train: DataFrame, path: str, symbol: np.ndarray, sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> attention.Params:
    """The model, fitted on the documents whose ids have the smallest hashes."""
    picked = smallest_hashes(train.select("doc_id", F.xxhash64("doc_id").alias("order")), sample_docs)
    ids = F.broadcast(picked.select(F.col("doc_id").alias("own"), "order").distinct())  # sample_docs rows

    def spelled(rows: Iterator[tuple]) -> Iterator[tuple]:
        for order, raw in rows:
            yield order, spell(path, words_of(raw)).astype(np.int32).tobytes()

    chosen = train.join(ids, F.col("doc_id").eqNullSafe(F.col("own"))).select("order", "text")
    got = sorted((r["order"], bytes(r["ids"])) for r in map_rows(chosen, spelled, "order long, ids binary", binary=("text",)).toLocalIterator())
    texts, total = [], 0
    for _, raw in got:
        if total < sample_symbols:
            texts.append(np.frombuffer(raw, dtype=np.int32).astype(np.int64))
            total += len(texts[-1])
    return attention.train([np.append(symbol[t], attention.END) for t in texts])


def go_on(train: DataFrame, model: attention.Params, path: str, symbol: np.ndarray) -> attention.Params:
    """The mean of the models that all partitions of ``train`` reach from ``model``, weighted by their windows.

    Every symbol of every document is learned once. Windows of ROUND symbols are laid at a time and dealt over the
    steps, so that a step's windows come from many documents.
    """
    shared = train.sparkSession.sparkContext.broadcast((attention.pack(model), symbol.astype(np.int16)))  # of fixed size

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        attention.keep_memory()
        start, symbol = shared.value
        adam = attention.Adam(attention.unpack(start))
        seen = 0

        def learn(texts: list[np.ndarray]) -> int:
            x, y, w, _ = attention.all_windows(texts, True, attention.WINDOW)
            steps = -(-len(x) // BATCH)
            for k in range(steps):
                adam.step(x[k::steps], y[k::steps], w[k::steps], RATE)
            return len(x)

        def texts() -> Iterator[np.ndarray]:
            words = Words(path)
            for part in by_bytes(rows):
                if words.full():
                    words.clear()
                numbers = [words.numbers(words_of(raw)) for (raw,) in part]
                words.learn()
                ids, many = words.spelled(np.concatenate(numbers))
                stop = np.append(0, np.cumsum(many))[np.cumsum([len(z) for z in numbers])]
                yield from np.split(symbol[ids], stop[:-1])

        waiting, size = [], 0
        for text in texts():
            text = np.append(text, np.int16(attention.END))
            for at in range(0, len(text), ROUND):  # a text of any length, ROUND symbols at a time
                waiting.append(text[at : at + ROUND])
                size += len(waiting[-1])
                if size >= ROUND:
                    seen += learn(waiting)
                    waiting, size = [], 0
        if waiting:
            seen += learn(waiting)
        if seen:
            yield seen, attention.pack(adam.p).astype(np.float32).tobytes()

    total, n = np.zeros(len(attention.pack(model))), 0
    models = materialize(map_rows(train.select("text"), run, "n long, p binary", binary=("text",)), "models")  # all partitions at once
    for r in models.toLocalIterator():
        total += r["n"] * np.frombuffer(r["p"], dtype=np.float32).astype(np.float64)
        n += r["n"]
    return attention.unpack(total / n) if n else model


def lm_scores(docs: DataFrame, path: str = TOKENIZER, mod: int = 7, held: int = 2, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities. Null text counts as empty: its one token is the end. A null id is
    neither learned from nor held out by its remainder; it counts as held out. Repeated rows are learned
    from and scored each; other columns are ignored. With no training document every word is unknown.
    """
    rest = crc_mod("doc_id", mod)
    train = docs.where((rest != held) & (rest >= 0))
    both = materialize(count_words(train, path), "counts")
    counts = both.where("not sub").select("key", "c")
    times = np.zeros(len(opening(path)), dtype=np.int64)
    for r in both.where("sub").toLocalIterator():  # one row a subword id
        times[r["key"]] = r["c"]
    symbol, share = symbols_of(times)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # by size class, so that only the head itself comes to the driver, not a head of every partition
    size_of = F.floor(F.log2("c") * 8)
    classes = sorted(((r["size"], r["n"]) for r in counts.groupBy(size_of.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = LARGEST, 0
    for size, many in classes:
        if total + many > head:
            break
        least, total = size, total + many
    rows = counts.where(size_of >= least).toPandas()  # at most head
    keys, values = rows["key"].to_numpy(dtype=np.int64), rows["c"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    model = go_on(train, fit(train, path, symbol), path, symbol)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((keys[order], values[order], model, symbol, share))  # bounded by head
    whole = len(values) == v
    floor = math.log10(n + v + 1)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        attention.keep_memory()
        keys, values, model, symbol, share = shared.value
        end = at_end(keys, values)
        words = Words(path)
        known, hashes = np.zeros(0), np.zeros(0, dtype=np.int64)
        for part in by_bytes(rows):
            if words.full():
                words.clear()
                known, hashes = known[:0], hashes[:0]
            numbers = [words.numbers(words_of(raw)) for *_, raw in part]
            new = word_keys(words.learn())
            hashes = np.append(hashes, new)
            known = np.append(known, head_counts(keys, values, new))
            tokens = np.array([len(z) + 1 for z in numbers])  # with the ends
            last = np.cumsum(tokens) - 1
            numbers = np.concatenate(numbers)
            ids, many = words.spelled(numbers)
            worded = np.ones(tokens.sum(), dtype=bool)
            worded[last] = False
            length = np.ones(len(worded), dtype=np.int64)
            length[worded] = many
            starts = np.cumsum(length) - length
            spelt = np.ones(length.sum(), dtype=bool)
            spelt[starts[last]] = False
            symbols, shares = np.full(len(spelt), attention.END), np.zeros(len(spelt))
            symbols[spelt], shares[spelt] = symbol[ids], share[ids]
            logs = np.concatenate(attention.symbol_scores(model, np.split(symbols, starts[last[:-1]] + 1))) + shares
            times = np.full(len(worded), float(end))  # count of a head word or of the end; not a number for others
            times[worded] = known[numbers]
            unknown = np.isnan(times)
            times[unknown] = 0
            spelled = np.add.reduceat(logs, starts)
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(spelled + math.log(1 - COUNTED), np.log(COUNTED * times / max(1, n)))
            first = last + 1 - tokens
            base, n_known, score = (np.add.reduceat(z, first).tolist() for z in (np.log10(times + 1), (times > 0).astype(np.int64), mixed))
            far = np.zeros(0, dtype=np.int64) if whole else np.flatnonzero(unknown)
            cuts = np.searchsorted(far, last).tolist()
            number = np.cumsum(worded) - 1
            far_keys, far_spelled = hashes[numbers[number[far]]], spelled[far].astype(np.float32)
            at = 0
            for (row, doc_id, _), t, k, z, stop, value in zip(part, tokens.tolist(), n_known, base, cuts, score, strict=True):
                yield row, doc_id, t, k, z, far_keys[at:stop], far_spelled[at:stop], value
                at = stop

    def at_end(keys: np.ndarray, values: np.ndarray) -> int:
        return int(values[0]) if len(keys) and keys[0] == END_KEY else ends

    ends = 0
    if not (len(keys) and keys[order][0] == END_KEY):
        found = counts.where(F.col("key") == END_KEY).first()
        ends = found["c"] if found else 0
    picked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, keys array<long>, spelled array<float>, score double"
    first = materialize(map_rows(picked, run, schema, binary=("text",)), "scored")
    far = first.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "spelled")).alias("f")).select("row", F.col("f.keys").alias("key"), F.col("f.spelled").cast("double").alias("s"))
    rare = counts.where(size_of < least)
    mixed = F.log((1 - COUNTED) * F.exp("s") + COUNTED * F.col("c") / F.lit(float(max(1, n)))) - F.col("s") - math.log(1 - COUNTED)
    more = far.join(rare, "key").groupBy("row").agg(F.count("*").alias("far_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("far_base"), F.sum(mixed).alias("far_score"))
    out = first.drop("keys", "spelled").join(more, "row", "left")
    base = F.col("base") + F.coalesce("far_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)
    return out.select(
        "doc_id",
        ((rest == held) | (rest < 0)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("score") + F.coalesce("far_score", F.lit(0.0))) / math.log(10)).alias("score"),
    )
