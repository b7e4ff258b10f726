"""Quality classifier by compression.

Two zstandard dictionaries are built from texts labelled good and bad. A text compresses better with the
dictionary of its own kind; the normalised difference of both sizes, with the size per byte and the
length beside it, is calibrated into a probability by a logistic fit on other labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, smallest_hashes

#: Bounds of what the classifier is fitted on: labelled documents of a class for its dictionary,
#: pieces of them and bytes of a piece, and documents for the calibration.
DICTIONARY_DOCS, PIECES, PIECE_BYTES, DICTIONARY_BYTES, CALIBRATION_DOCS = 4_000, 8_000, 2_048, 65_536, 20_000
LEVEL = 3


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too few pieces for that, their last ``size`` bytes as raw content."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-size:]


class Features:
    """What both dictionaries make of a text."""

    def __init__(self, good: bytes, bad: bytes):
        self.sizes = [self.compressor(x) for x in (good, bad)]

    @staticmethod
    def compressor(content: bytes):
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False}
        if len(content) >= 8:
            own = zstandard.ZstdCompressionDict(content)
            own.precompute_compress(level=LEVEL)
            options["dict_data"] = own
        return zstandard.ZstdCompressor(**options)

    def of(self, raw: bytes) -> list[float]:
        g, b = (len(c.compress(raw)) for c in self.sizes)
        n = len(raw) + 1
        d = (g - b) / (g + b)
        k, r, size = (g - b) / n, math.log((g + b) / (2 * n)), math.log(n)
        return [1.0, d, d * d, k, r, r * r, size, size * size, d * size, r * size, max(0.0, d + 0.04), max(0.0, d + 0.02), max(0.0, -1.0 - r), max(0.0, -1.3 - r)]


class Calibration:
    """Ridge logistic regression by Newton's method; a step that doesn't raise the penalised likelihood is halved."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.05):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.mean[0], self.scale[0] = 0, 1
        z = (x - self.mean) / self.scale
        self.w = np.zeros(z.shape[1])

        def value(w: np.ndarray) -> float:
            t = z @ w
            return float((y * t - np.logaddexp(0, t)).sum() - ridge / 2 * w @ w)

        now = value(self.w)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(self.w))
            step = np.linalg.solve(h, z.T @ (y - p) - ridge * self.w)
            for _ in range(30):
                new = value(self.w + step)
                if new > now:
                    break
                step = step / 2
            else:
                break
            self.w, gain, now = self.w + step, new - now, new
            if gain < 1e-9 * max(1.0, abs(now)):
                break

    def score(self, x: list[float]) -> float:
        z = (np.asarray(x) - self.mean) / self.scale @ self.w
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> tuple[bytes, bytes, Calibration | None]:
    """Dictionaries and calibration, from labelled documents outside the held-out part.

    One half of them (by a hash of the id) is for dictionaries, the other for the calibration; of each,
    those with the smallest hashes. A document labelled twice counts with its largest label.
    """
    rest = crc_mod("doc_id", mod)
    usable = labels.where((rest != held) & (rest >= 0)).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality is not null")
    usable = usable.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))).withColumn("order", F.xxhash64("doc_id", F.lit("fit")))
    picked = smallest_hashes(usable.where("half = 0 and quality = 1"), DICTIONARY_DOCS).unionByName(smallest_hashes(usable.where("half = 0 and quality <> 1"), DICTIONARY_DOCS))
    ids = picked.unionByName(smallest_hashes(usable.where("half = 1"), CALIBRATION_DOCS)).withColumnRenamed("doc_id", "own").select("own", "quality", "half")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("own"))  # bounded by the limits above

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, raw, quality in rows:
            for at in range(0, len(raw or b""), PIECE_BYTES):
                yield int(quality == 1), xxhash.xxh3_64_intdigest(b"%d %d" % (doc_id, at)) >> 1, raw[at : at + PIECE_BYTES]

    pieces = map_rows(chosen.where("half = 0").select("doc_id", "text", "quality"), cut, "good int, order long, piece binary", binary=("text",))
    made = []
    for good in (1, 0):
        own = pieces.where(F.col("good") == good).orderBy("order", "piece").limit(PIECES).select("piece").collect()  # at most 16 MB
        made.append(dictionary([bytes(r["piece"]) for r in own]))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(made))

    def features(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = Features(*shared.value)
        for doc_id, raw, quality in rows:
            yield doc_id, int(quality == 1), own.of(raw or b"")

    sample = map_rows(chosen.where("half = 1").select("doc_id", "text", "quality"), features, "doc_id long, good int, x array<double>", binary=("text",)).collect()
    sample = sorted((r["doc_id"], r["good"], r["x"]) for r in sample)
    if not sample:
        return made[0], made[1], None
    return made[0], made[1], Calibration(np.array([x for _, _, x in sample]), np.array([g for _, g, _ in sample], dtype=float))


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null text counts as empty. A null id is never learned from and counts as held out. Where nothing is
    labelled, every score is 0.5. Repeated rows give repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, held))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        good, bad, calibration = shared.value
        own = Features(good, bad)
        for doc_id, raw in rows:
            yield doc_id, calibration.score(own.of(raw or b"")) if calibration else 0.5

    scored = map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double", binary=("text",))
    rest = crc_mod("doc_id", mod)
    return scored.select("doc_id", ((rest == held) | (rest < 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
