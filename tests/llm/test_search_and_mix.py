"""Decontamination and mixing: brute force, SQL, and odd inputs."""

import hashlib
import random
import re

import pytest
from helpers import SF, compare

from pagewright.llm import decontaminate as D
from pagewright.llm import mixing as M
from pagewright.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            q = words(t)
            n = min(length, len(q))
            for k in range(len(q) - n + 1 if q else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == q[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = ["the", "of", "Über", "a", "b7", "rare", "x", "Ça"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + rng.choice(["", ".", "!\n", "\x00"])
    items = [(i, text(rng.choice([2, 3, 12, 15]))) for i in range(8)] + [(8, None), (9, ""), (10, "--"), (None, "b7 rare x x Ça the"), (3, "rare rare rare")]
    docs = [(i, text(rng.randint(0, 120))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, "x " * 3 + (items[3][1] or "") + " y"), (103, "x " * 3 + (items[3][1] or "") + " y"), (None, items[2][1])]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id long, text string, block long, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in D.contamination(d, b, **more).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=str)


def test_phrases_against_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, length=3) == brute(docs, items, 3)


def test_small_blocks_and_many_passes(spark, monkeypatch):
    docs, items = corpus(1)
    monkeypatch.setattr(D, "BLOCK_DOCS", 3)
    monkeypatch.setattr(D, "PASS_WORDS", 40)
    assert run(spark, docs, items) == brute(docs, items)


def test_proximity(spark):
    got = run(spark, [(1, "a b c d e"), (2, "a x b c d e"), (3, "a x y z b c d e")], [(1, "a b c d")], slop=1)
    assert [r[5] for r in got] == [True, True, False]


def test_nothing_to_find(spark):
    docs, _ = corpus()
    assert not any(r[5] for r in run(spark, docs, []))
    assert run(spark, [], [(1, "a b")]) == []


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_mix_sources"])
def test_sql(spark, name):
    assert compare(spark, Q.queries()[name], Q.oracle_sql()[name]) > 0


def test_slot_ranks_and_points(spark):
    from pyspark.sql import functions as F

    p = 7
    s = spark.createDataFrame([(0, 0, 30), (1, 30, 31), (2, 31, 31), (3, 31, 100)], "number long, low long, high long")
    got = sorted((r["slot"], r["number"], r["rank"]) for r in M.slots(s, p).select("slot", "number", F.col("rank").cast("long").alias("rank")).collect())
    point = lambda n: int(format(n, f"0{p}b")[::-1], 2)
    seen: dict[int, int] = {}
    want = []
    for n in range(1 << p):
        for number, lo, hi in ((0, 0, 30), (1, 30, 31), (3, 31, 100)):
            if lo <= point(n) < hi:
                want.append((n, number, seen.get(number, 0)))
                seen[number] = seen.get(number, 0) + 1
    assert got == want


def mixed(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, number long")
    return [r.asDict() for r in M.mixture(d)[1].collect()]


def test_shares_and_bounds(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "a", "b", "c", None]), "x", 1) for i in range(300)]
    rows += [(1000, None, "b", "x", 1), (1000, None, "b", "x", 1), (None, "\v w\x0bw ", "c", "x", 1), (5, "w " * 50, "d", "x", 1)]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by: dict[float, list] = {}
    for r in got:
        by.setdefault((r["target"], r["source_size"]), []).append(r)
    for (target, size), own in by.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r["taken"] for r in own) - target) <= 2 * M.BLOCK_WORDS
    assert got and sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [r["target"] for r in mixed(spark, [(1, "", "a", "x", 1), (2, None, None, "x", 1)])] == [0.0, 0.0]


def test_schedule_interleaves(spark):
    d = spark.createDataFrame([(i, "w " * 64, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    first = M.mixture(d)[0].orderBy("slot").limit(20).select("number").distinct().count()
    assert first == 2


def test_reads_the_whole_table(spark):
    assert Q.queries()["op2_mix_sources"](spark, SF).count() == 200


def test_two_passes_find_what_one_does(spark, tmp_path):
    words = [f"t{k}" for k in range(60)]
    docs = [(i, " ".join(words[i % 40 : i % 40 + 14] + ["gap"] * (i % 5) + words[:11])) for i in range(120)] + [(500, "w " * 20000 + " ".join(words))]
    items = [(1, " ".join(words[:20])), (2, " ".join(words[30:])), (3, "gap gap gap")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most in (10**6, 20):
        df = spark.read.parquet(f"{tmp_path}/d")
        found.append({r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in D.contamination(df, bench, pass_words=most).collect()})
    assert found[0] == found[1] and sum(x[1] > 0 for x in found[0].values()) == 121 and found[0][500][0] == 20060
