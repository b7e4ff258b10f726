"""SimHash, line dedup, language model and the pipeline, against brute force."""

import math
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import xxhash
from helpers import SF
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import attention as A
from pagewright.llm import decontaminate as D
from pagewright.llm import line_dedup as E
from pagewright.llm import lm_score as M
from pagewright.llm import simhash as S


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    v = sorted(parent)
    for i, a in enumerate(v):
        for b in v[i + 1 :]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {x: find(x) for x in v}


def test_fingerprints():
    rng = random.Random(0)
    for _ in range(50):
        t = " ".join(rng.choice(["Aé", "b", "C d", "e"]) for _ in range(rng.randint(0, 12)))
        assert S.fingerprint(t.encode()) & (2**64 - 1) == brute_fingerprint(t)
    assert S.fingerprint(None) == 0 and S.fingerprint(b" \n") == 0


def check_links(spark, values):
    from pagewright.operators.graph import connected_components
    from pagewright.llm.common import materialize

    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    stars = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in connected_components(S.links(df), materialize).collect()}
    got = {v: stars.get(v, v) for v in values}
    want = roots(values, lambda a, b: (a ^ b).bit_count() <= 4)
    same = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    assert same(got) == same(want)


def test_links_sparse_and_dense(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {flip(b, n) for b in base for n in (0, 2, 4, 5)} | {0, 2**64 - 1}
    check_links(spark, values)
    dense = {flip(base[0], rng.choice([1, 2, 3])) for _ in range(120)} | {flip(base[1], n) for n in (0, 4)}
    check_links(spark, dense)
    monkeypatch.setattr(S, "PAIRWISE", 2)
    check_links(spark, {flip(base[2], rng.choice([0, 1, 2, 4])) for _ in range(25)} | set(base[:5]))


def broadcast_joins(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    from pagewright.llm import common

    joins = Counter()

    def kept(df, name):
        joins[name] += broadcast_joins(df)
        return common.materialize(df, name)

    monkeypatch.setattr(S, "materialize", kept)
    df = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(40)], "doc_id long, text string")
    out = S.near_duplicates(df)
    assert out.count() == 40 and joins["met"] == joins["edges"] == joins["lowest"] == 0
    assert broadcast_joins(out) == joins["components"] == 2  # lists of frequent keys, on both sides


def test_gone_copies_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, f"a b c d e f {i // 2}", 1) for i in range(40)], "doc_id long, text string, n long")
    out = corpus_pipeline.near_copies(spark, df, SF)
    assert broadcast_joins(out) == 0 and out.count() <= 20


def test_near_duplicates_of_odd_rows(spark):
    rows = [(7, None, "x"), (3, "", "x"), (9, "a b c d e f", "x"), (9, "a b c d e f", "x"), (None, "a b c d e f", "x"), (12, "q r s t u v w", "x")]
    got = sorted(map(tuple, S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (9, 9), (9, 9), (None, 9), (12, 12)], key=str)
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def brute_lines(docs):
    occ = [((2**63 if i is None else i), n, k, tuple(line.encode().lower().split())) for n, (i, t) in enumerate(docs) for k, line in enumerate((t or "").split("\n"))]
    occ = sorted((o for o in occ if o[3]), key=lambda o: o[:3])
    drop, seen = set(), []
    first: dict = {}
    for o in occ:
        if o[3] in first or len(o[3]) >= E.SHORTEST and any(abs(len(w) - len(o[3])) <= 1 and distance(w, o[3]) <= 1 for w in seen):
            drop.add((o[1], o[2]))
        if o[3] not in first:
            first[o[3]] = 1
            if len(o[3]) >= E.SHORTEST:
                seen.append(o[3])
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in drop) if t is not None else None for n, (_, t) in enumerate(docs)]


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(4, 9))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + ["zz"] + w[k:], w[:k] + w[k + 1 :], w[:k] + ["yy"] + w[k + 1 :]])
        return " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)

    docs = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(100), 60)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (None, docs[0][1]), (203, docs[1][1]), (203, docs[1][1])]
    df = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(docs)], "doc_id long, text string, lines int").coalesce(1)
    for most in (E.FILTER_PLACES, 0):  # by the filter and by the join
        got = {r["lines"]: r["text"] for r in E.dedup_lines(df, most=most).collect()}
        assert [got[n] for n in range(len(docs))] == brute_lines(docs)


def test_lines_do_not_depend_on_how_files_are_split(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = f"{tmp_path}/documents"
    docs.repartition(6).write.parquet(path)
    want = None
    for n in ("8", "2"):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        try:
            out = E.dedup_lines(spark.read.parquet(path))
            spark.conf.set("spark.sql.files.minPartitionNum", "5")  # as if executors came or went between the passes
            got = {r["doc_id"]: r["text"] for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        want = want or got
        assert got == want
    assert want == dict(zip(*zip(*[(r["doc_id"], r["text"]) for r in E.dedup_lines(docs).collect()], strict=True), strict=True))


def test_very_long_and_frequent_lines(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    docs = [(1, long), (2, long.replace("w77 ", "x ") + "\nshort"), (3, long + " tail")] + [(10 + i, "short\nshort\nthe same line of words") for i in range(1500)]
    df = spark.createDataFrame([(*d, "a", 7) for d in docs], "doc_id long, text string, __row string, __lines int")
    got = {r["doc_id"]: (r["text"], r["__row"], r["__lines"]) for r in E.dedup_lines(df).collect()}
    assert got[1][0] == long and got[2][0] == "short" and got[3][0] == "" and got[10][0] == "the same line of words"
    assert all(got[10 + i][0] == "" for i in range(1, 1500)) and {x[1:] for x in got.values()} == {("a", 7)}


def test_many_lines_one_word_apart(spark):
    docs = [(i, f"this is page number {i} of the whole book") for i in range(400)]
    out = E.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).where("text <> ''").collect()
    assert [r["doc_id"] for r in out] == [0]


def test_one_edit():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert E.one_edit(a, b) == (distance(a, b) <= 1)


def test_attention_gradients_and_normalisation():
    p = {k: v.astype(np.float64) for k, v in A.fresh(1).items()}
    text = np.array([5, 9, 700, 3, 5, 9, 31, 32, A.END])
    x, y, w = A.windows(text)
    assert w.sum() == len(text)
    _, g = A.gradients(p, x, y, w.astype(float))
    for k in ("emb", "qkv", "mix", "up", "down", "group", "inner0", "pos"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        ends = []
        for s in (1e-5, -1e-5):
            q = {a: b.copy() for a, b in p.items()}
            q[k][i] += s
            ends.append(A.gradients(q, x, y, w.astype(float))[0])
        assert math.isclose(g[k][i], (ends[0] - ends[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-6), k
    h = A.states(A.fresh(1), x)[0, :1].repeat(A.SYMBOLS, axis=0)
    assert math.isclose(np.exp(A.log_probs(A.fresh(1), h, np.arange(A.SYMBOLS))).sum(), 1, rel_tol=1e-4)


def test_each_token_is_scored_once_and_causally():
    p = A.fresh(3)
    for n in (1, A.WINDOW - 1, A.WINDOW, A.WINDOW + 1, 3 * A.STRIDE + 5):
        _, y, w = A.windows(np.arange(n) % 1000 + 2)
        assert w.sum() == n and sorted(y[w].tolist()) == sorted((np.arange(n) % 1000 + 2).tolist())
    x = np.random.default_rng(0).integers(2, 1000, (1, A.WINDOW))
    z = x.copy()
    z[0, -1] = 7
    assert np.allclose(A.states(p, x)[0, :-1], A.states(p, z)[0, :-1])
    texts = [np.random.default_rng(i).integers(2, 1000, 5 + 31 * i) for i in range(6)]
    assert np.allclose(A.score(p, texts), [A.score(p, [t])[0] for t in texts], rtol=1e-4)


def brute_base(docs):
    c: Counter = Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        w = [*(t or "").encode().lower().split(), None]
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    return out


def test_base_scores_with_a_small_head(spark, monkeypatch):
    monkeypatch.setattr(A, "train", lambda texts: A.fresh())
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["The", "the", "é", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(900, None), (901, "")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double")
    for head in (1, 8, 1 << 18):
        want = brute_base(docs)
        for r in M.lm_scores(df, head=head).collect():
            n, known, total, base = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_lm_without_training_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "train", lambda texts: A.fresh())
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in M.lm_scores(df).collect())
    assert got == [(1, 0, 0, True), (3, 0, 0, True)]
    assert M.lm_scores(df.limit(0)).count() == 0


def test_training_lowers_the_loss():
    texts = [np.append(np.tile([5, 6, 7, 8], 30), A.END) for _ in range(20)]
    p = A.train(texts, steps=120, batch=32)
    assert -A.score(p, texts)[0] / len(texts[0]) < 0.5


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.toPandas()
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        kept = corpus_pipeline.materialize(kept, name)
        after = kept.toPandas()
        assert set(after["doc_id"]) <= set(before["doc_id"]) and after["doc_id"].is_unique
        if name == "near_copies":
            f = {i: brute_fingerprint(t) for i, t in zip(before["doc_id"], before["text"])}
            r = roots(set(f.values()), lambda a, b: (a ^ b).bit_count() <= 4)
            first: dict = {}
            for i in sorted(f):
                first.setdefault(r[f[i]], i)
            assert set(after["doc_id"]) == set(first.values())
        if name == "lines":
            text = dict(zip(after["doc_id"], after["text"]))
            want = dict(zip(before["doc_id"], brute_lines(list(zip(before["doc_id"], before["text"])))))
            assert all(text[i] == want[i] for i in text)
            gone = set(before["doc_id"]) - set(text)
            assert all(max((len(x.split()) for x in want[i].split("\n")), default=0) < E.SHORTEST for i in gone)
            assert (after["n_chars"] == after["text"].str.len()).all()
    clean = {r["doc_id"] for r in D.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated").collect()}
    assert clean and corpus_pipeline.mix(spark, kept, SF).count() == kept.count()


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (None, "some words that are here today", None, "b", 30), (None, "some words that are here today", None, "b", 30), (3, "x " * 5000, "en", "a", 10000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __x string").coalesce(1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns[-1] == "__x"
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
    assert corpus_pipeline.mix(spark, docs, SF).count() == docs.count()


def test_scoring_reads_the_whole_feed_forward_layer():
    p = A.fresh(3)
    assert p["up"].shape == (A.WIDTH, 32) and p["down"].shape == (32, A.WIDTH)
    texts = [np.random.default_rng(i).integers(2, 1000, n) for i, n in enumerate((1, 30, 24, 200))]
    want = []
    for t in texts:
        x, y, w = A.windows(t)
        want.append(A.log_probs(p, A.states(p, x)[w], y[w]))
    got = A.symbol_scores(p, texts)
    assert [len(z) for z in got] == [1, 30, 24, 200]
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(got, want, strict=True))


def test_subwords_without_a_symbol_differ_by_corpus_counts(spark, monkeypatch):
    monkeypatch.setattr(A, "SYMBOLS", 4)  # two ids have symbols of their own
    assert A.WINDOW - A.STRIDE >= A.WINDOW // 2
    docs = [(i, "the the the the of of of of cat" + (" cat dog" if i == 1 else " cat")) for i in range(60)]
    (a,), (b,) = M.spell(M.TOKENIZER, [b"cat"]), M.spell(M.TOKENIZER, [b"dog"])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    times = np.zeros(M.encoding(M.TOKENIZER).max_token_value + 1, dtype=np.int64)
    for r in M.count_words(df, M.TOKENIZER).where("sub").collect():
        times[r["key"]] = r["c"]
    want = Counter(int(k) for _, t in docs for k in M.spell(M.TOKENIZER, t.encode().split()))
    assert {int(k): int(times[k]) for k in np.flatnonzero(times)} == dict(want)
    symbol, share = M.symbols_of(times)
    assert symbol[a] == symbol[b] == A.OTHER and share[a] > share[b]
    assert math.isclose(np.exp(share[symbol == A.OTHER]).sum(), 1, rel_tol=1e-9)


def test_spelling_keeps_words_apart():
    for words in ([b"cat", "\xa0".encode(), "\xa0".encode(), b"dog"], [b"a-b", b"don't", "x\xa0".encode()], []):
        ids, starts = M.spell_each(M.TOKENIZER, words)
        got = [z.tolist() for z in np.split(ids, starts[1:])] if words else []
        assert got == [M.spell(M.TOKENIZER, [w]).tolist() for w in words]


def test_score_learns_from_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(A, "train", lambda texts: A.fresh())
    monkeypatch.setattr(M, "go_on", lambda train, model, path, symbol: model)
    docs = [(i, "alpha beta gamma") for i in range(40)] + [(900 + i, "qzxv kwyj") for i in range(20)] + [(2000 + i, t) for i in range(20) for t in ("qzxv kwyj",)]
    got = [{r["doc_id"]: r["score"] for r in M.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), head=h).collect()} for h in (1, 3, 1 << 18)]
    assert all(math.isclose(got[0][i], g[i], rel_tol=1e-5) for g in got for i in g)
    train = [t.split() for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*t, None])
    words = "qzxv kwyj".split()
    ids, starts = M.spell_each(M.TOKENIZER, [w.encode() for w in words])
    times = np.zeros(M.encoding(M.TOKENIZER).max_token_value + 1, dtype=np.int64)
    for t in train:
        np.add.at(times, M.spell(M.TOKENIZER, [w.encode() for w in t]), 1)
    symbol, share = M.symbols_of(times)
    lp = A.symbol_scores(A.fresh(), [np.append(symbol[ids], A.END)])[0]
    lp[:-1] += share[ids]
    spelled = np.add.reduceat(lp, np.append(starts, len(ids)))
    want = sum(math.log10(0.5 * math.exp(s) + 0.5 * c[w] / sum(c.values())) for s, w in zip(spelled, [*words, None], strict=True))
    assert math.isclose(got[0][900], want, rel_tol=1e-5)


def test_the_model_goes_on_over_all_documents(spark):
    symbol = np.arange(M.encoding(M.TOKENIZER).max_token_value + 1) % (A.SYMBOLS - 2) + 2
    rows = [(i, " ".join(["red green blue"] * 20)) for i in range(40)]
    run = lambda x: A.pack(M.go_on(spark.createDataFrame(x, "doc_id long, text string").coalesce(2), A.fresh(), M.TOKENIZER, symbol))
    a, b = run(rows), run([*rows[:-1], (39, "one other text")])
    assert not np.array_equal(a, b)
    text = np.append(symbol[M.spell(M.TOKENIZER, rows[0][1].encode().split())], A.END)
    assert A.score(A.unpack(a), [text])[0] > A.score(A.fresh(), [text])[0]
    assert np.array_equal(run([]), A.pack(A.fresh()))


def test_every_symbol_of_long_documents_is_learned(spark):
    symbol = np.arange(M.encoding(M.TOKENIZER).max_token_value + 1) % (A.SYMBOLS - 2) + 2
    rows = [(i, " ".join(["red green blue"] * 160)) for i in range(30)]  # 480 words each, 30 of A.WINDOW are less than one step
    got = A.pack(M.go_on(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A.fresh(), M.TOKENIZER, symbol))
    assert np.abs(got - A.pack(A.fresh())).max() > 1.5 * M.RATE  # one step moves no weight by more than RATE
    texts = [np.arange(n) % 900 + 2 for n in (1, A.WINDOW, A.WINDOW + 1, 5 * A.WINDOW - 3)]
    _, y, w, _ = A.all_windows(texts, True, A.WINDOW)
    assert sorted(y[w].tolist()) == sorted(np.concatenate(texts).tolist())


def test_a_step_by_parts_is_a_step(monkeypatch):
    x, y, w, _ = A.all_windows([np.random.default_rng(i).integers(2, 1000, 40 * i + 1) for i in range(9)], True)
    ends = []
    for part in (7, len(x)):
        monkeypatch.setattr(A, "PART", part)
        adam = A.Adam(A.fresh())
        adam.step(x, y, w, 0.01)
        ends.append(A.pack(adam.m))
    assert np.allclose(*ends, atol=1e-6)


def test_texts_that_lose_nothing_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"{i} own line {i * i}" if i % 50 else "one line") for i in range(1000)], "doc_id long, text string")
    known, (file, row) = E.identified(docs)
    drop = known.where("doc_id % 50 = 0").select(F.col(file).alias("file"), F.col(row).alias("row"))
    hit = {r["doc_id"] for r in known.where(E.losing(known, file, row, drop, 20)).collect()}
    assert hit >= set(range(0, 1000, 50)) and len(hit) < 40
    out = E.dedup_lines(docs)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 1000 and {r["doc_id"] for r in out.where("__n_dropped > 0").collect()} == set(range(50, 1000, 50))


def test_equal_short_lines_go_in_the_query(spark, tmp_path):
    from pagewright.llm.queries import op9_line_dedup

    docs = [(1, "Read more\nshare\n\nshare this"), (2, "read  more\n\nShare\nshare that"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, docs[0][1]), 2: (4, 2, "\nshare that"), 3: (0, 0, None)}


def test_a_word_of_many_texts_is_spelled_once(monkeypatch):
    asked = []
    monkeypatch.setattr(M, "spell_each", lambda path, words, f=M.spell_each: asked.extend(words) or f(path, words))
    words = M.Words(M.TOKENIZER)
    texts = [b"one two  two", b"", b"two caf\xc3\xa9 \xff\xfe", b"caf\xc3\xa9 one unseenword"]
    for part in (texts[:2], texts[2:]):
        numbers = [words.numbers(M.words_of(t)) for t in part]
        words.learn()
        for t, z in zip(part, numbers, strict=True):
            ids, many = words.spelled(z)
            assert ids.tolist() == M.spell(M.TOKENIZER, M.words_of(t)).tolist() and many.sum() == len(ids)
    assert sorted(asked) == sorted({w for t in texts for w in M.words_of(t)})
    assert not words.full()
    words.numbers([b"z" * (M.KEPT_BYTES + 1)])
    monkeypatch.setattr(M, "spell_each", lambda path, new: (np.zeros(len(new), dtype=np.int64), np.arange(len(new))))
    words.learn()
    assert words.full()  # long words count by their bytes
    rows = [(i, t) for i, t in enumerate([b"x" * 30, None, b"", b"y" * 5] * 7)]
    parts = list(M.by_bytes(iter(rows), 40, 3))
    assert sum(parts, []) == rows and all(p and len(p) <= 3 and sum(len(t or b"") for _, t in p[:-1]) <= 40 for p in parts)
    assert M.head_counts(np.array([-5, 2, 9]), np.array([1, 2, 3]), np.array([9, 3, -5, 10])).tolist()[::2] == [3, 1] and np.isnan(M.head_counts(np.array([]), np.array([]), np.array([1]))).all()


def test_steps_do_not_ask_for_new_memory():
    code = """
import resource
import numpy as np
from pagewright.llm import attention as A
texts = [np.random.default_rng(i).integers(2, 1000, 300) for i in range(20)]
A.train(texts, steps=5)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
A.train(texts, steps=45)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 45)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(A.__file__).parents[2])
    assert float(out.stdout) < 100


def test_products_by_blocks_are_products():
    rng = np.random.default_rng(2)
    for n in (0, 1, A.BLOCK - 1, A.BLOCK, A.BLOCK + 1, 5 * A.BLOCK + 7):
        a, b, c = rng.standard_normal((n, 16)), rng.standard_normal((32, 16)), rng.standard_normal((n, 48))
        assert np.allclose(A.product(a, b.T), a @ b.T)
        assert np.allclose(A.cross(a, c), a.T @ c) and A.cross(a, c).shape == (16, 48)
    p, x = A.fresh(4), rng.integers(0, A.SYMBOLS, (A.PART, A.WINDOW))
    y, w = rng.integers(0, A.SYMBOLS, x.shape), np.ones(x.shape)
    assert A.gradients(p, x, y, w)[0] > 0 == A.gradients(p, x, y, w, False)[0]
    exact = A.gradients({k: v.astype(np.float64) for k, v in p.items()}, x, y, w)[1]
    for k, v in A.gradients(p, x, y, w, False)[1].items():
        assert np.abs(v - exact[k]).max() < 1e-4 * np.abs(exact[k]).max(), k


def test_windows_of_all_lengths_are_scored_in_place():
    p = A.fresh(5)
    texts = [np.random.default_rng(n).integers(0, A.SYMBOLS, n) for n in (1, 12, 23, 24, 25, 36, 37, 48, 60, 500)] * 3
    for most in (1, 7, 192):
        for t, got in zip(texts, A.symbol_scores(p, texts, most), strict=True):
            x, y, w = A.windows(t)
            assert np.allclose(got, A.log_probs(p, A.states(p, x)[w], y[w]), rtol=1e-4)
