"""Quality rules, quality classifier, secret and license scans, HTML extraction."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from helpers import SF

from pagewright.llm import html_extract as H
from pagewright.llm import license_scan as L
from pagewright.llm import quality_classifier as C
from pagewright.llm import quality_rules as R
from pagewright.llm import queries as Q
from pagewright.llm import secret_scan as S

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    w = SPACE.findall(text)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if SPACE.search(line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), n_lines, sum("A" <= c <= "Z" for c in text)


def test_statistics_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice("ab Aé#|\n\t  x") for _ in range(rng.randint(0, 80)))
        assert R.text_stats(t) == brute_stats(t), repr(t)
    assert R.text_stats(None) == (0,) * 7
    long = "word " * 50_000
    assert R.text_stats(long) == brute_stats(long)


def test_binomial_bound():
    for k, n, p in ((0, 50, 0.1), (3, 40, 0.2), (7, 7, 0.5)):
        assert math.isclose(R.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    # 300 good documents, of which 1 falls to the loosest cutoff and 40 to the next: only the first can pass
    assert R.accepted_cutoff({0: 1, 1: 40, 9: 259}, 300, 5, 0.05, 0.01) == 0
    assert R.accepted_cutoff({9: 20}, 20, 5, 0.05, 0.01) == -1  # too few for any guarantee


def labelled(spark, rows):
    d = spark.createDataFrame([(i, t, s, "x") for i, t, s, _ in rows], "doc_id long, text string, lang string, kept string")
    return d, spark.createDataFrame([(i, q, 0) for i, _, _, q in rows if q is not None], "doc_id long, quality int, toxic int")


def test_rules_reject_only_what_the_holdout_allows(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80))
    bad = lambda: " ".join("#" + rng.choice("abcdef") * 2 for _ in range(80))
    rows = [(i, good(), "en", 1) for i in range(700)] + [(1000 + i, good(), None, None) for i in range(5)] + [(2000 + i, bad(), "en", None) for i in range(20)] + [(3000, None, "en", 1), (3001, "", "fr", 1)]
    got = {r["doc_id"]: r for r in R.quality_rules(*labelled(spark, rows), alpha=0.05).collect()}
    assert len(got) == len(rows) and not got[3000]["kept"] and got[3000]["base_failed"]
    assert sum(got[i]["kept"] for i in range(700)) >= 0.95 * 700
    assert not any(got[2000 + i]["kept"] for i in range(20))
    assert all(got[1000 + i]["kept"] for i in range(5))  # no label in its stratum: no rule


def test_rules_with_many_strata(spark):
    rows = [(i, "a b c " * 30, str(i), 1) for i in range(30)]
    args = labelled(spark, rows)
    few = sorted(map(str, R.quality_rules(*args).select("doc_id", "kept").collect()))
    assert few == sorted(map(str, R.quality_rules(*args, max_broadcast=1).select("doc_id", "kept").collect()))
    assert R.quality_rules(args[0].limit(0), args[1].limit(0)).count() == 0


def test_classifier_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = Q.queries()["op4_quality_classifier"](spark, sf).toPandas()
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(lab, on="doc_id")
    m = m[m["held_out"]]
    assert len(got) == 1000 and (m["predicted"] == m["quality"]).mean() > 0.93
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_calibration_settles_on_large_skewed_samples():
    """Features of very different sizes, nearly separable classes: an unchecked Newton step runs away on these."""
    rng = np.random.default_rng(0)
    n = 12_000
    y = (rng.random(n) < 0.86).astype(float)
    d = np.where(y == 1, -0.06, 0.01) + rng.normal(0, 0.012, n)
    r = np.where(rng.random(n) < 0.02, -4.0, -0.8) + rng.normal(0, 0.1, n)
    size = rng.uniform(3, 11, n)
    x = np.stack([np.ones(n), d, d * d, d / 2, r, r * r, size, size * size, d * size, r * size, np.maximum(0, d + 0.04), np.maximum(0, d + 0.02), np.maximum(0, -1 - r), np.maximum(0, -1.3 - r)], axis=1)
    c = C.Calibration(x, y)
    right = np.mean([(c.score(a) >= 0.5) == b for a, b in zip(x[:2000], y[:2000], strict=True)])
    assert right > 0.97 and np.abs(c.w).max() < 1000


def test_classifier_without_labels(spark):
    d = spark.createDataFrame([(1, "x"), (None, None), (2, "")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = C.quality_scores(d, lab).collect()
    assert len(got) == 3 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    one = C.quality_scores(d, spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert all(0 <= r["score"] <= 1 for r in one)


def brute_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_secrets_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["token = ", "API_KEY:'", "toKen=", "secret=secret=abcdefgh", "token=token:abcdefgh", "AKIA" + "A1" * 8, "AKIAshort", "0123456789abcdef" * 2, "é", " ", '"', "passwd : x", "abc123", "ſecret=abcdef", "toKen=abcdef"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "s") for i in range(200)] + [(500, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in S.secret_digest(S.scan_secrets(d)).collect()}
    for i, t, _ in docs:
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        kept = [x for x in got[i]["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(kept) == want


def test_ownership_separates_examples_from_live_keys(spark):
    example, live = "ghp_" + "a1B2" * 9, "ghp_" + "Z9y8" * 9
    docs = [(i, f"see {example} here", f"owner{i}") for i in range(6)] + [(10, f"use {live}", "me"), (11, f"use {live}", "me"), (12, "postgres://u:sekret99@h/db", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in S.secret_digest(S.scan_secrets(d)).collect()}
    assert all(got[i] == "" for i in range(6)) and got[10].startswith("vendor:4:") and got[11] == got[10] and got[12].startswith("url:")
    f = S.scan_secrets(d).where("doc_id = 0").first()["findings"][0]
    assert (f["n_owners"], f["n_repositories"], f["live"]) == (6, 6, False)
    assert S.scan_secrets(d.limit(0)).count() == 0


def test_license_places(spark):
    docs = [(1, "CC BY cc-by CC. BY"), (2, "All rights, reserved; GNU General Public License"), (3, None), (4, "ccby cc byx"), (5, "")]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, labels string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 4, "cc-by")
    assert got[2]["base_labels"] == "gpl,reserved" and got[2]["n_words"] == 7 and got[2]["first_word"] == 0 and got[2]["last_word"] == 4
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["score"] == 0
    assert got[4]["n_base"] == 0 and set(got[2]["labels"].split(",")) >= {"gpl", "reserved"}


def test_license_rules():
    assert len(L.rules()) > 200
    labels = lambda t: [d.label for d in L.detect(t)]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("GNU Lesser General Public License v3") == ["lgpl"]  # the longer name contains the other
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd"]
    assert labels("an ordinary sentence on permits") == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu item</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy, buy, buy now.</div>
<div class="cookie-notice">We use cookies.</div><aside>Side bar text.</aside>
<article><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> text&nbsp;and a <a href="#">link</a>.<p>Second paragraph; it is longer. Yes.</p>
<ul><li>one</li><li>two</li></ul><form><input>Sign up</form></article>
<section id="comments"><p>Nice article, thanks. I like it, really.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_html():
    assert H.extract(PAGE) == "Title & more\n\nFirst paragraph, with bold text and a link.\n\nSecond paragraph; it is longer. Yes.\n\none\n\ntwo"
    assert H.extract(None) == "" and H.extract("") == "" and H.extract("<nav>x</nav>") == ""
    plain = "<html><body><div class='menu'>Home</div><div id='main-text'><p>" + "Some words, many of them. " * 20 + "</p><p>Short end.</p></div><div>tiny</div></body></html>"
    assert H.extract(plain).startswith("Some words") and H.extract(plain).endswith("Short end.")
    assert H.extract("<article><p>cut off &amp here <b>and") == "cut off & here and"
    assert H.extract("just text, no tags") == "just text, no tags"


def test_html_query(spark):
    got = Q.queries()["op7_html_extract"](spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"][:1] for r in got) and all("©" not in r["text"] for r in got)


def test_ratios_decide_inside_articles():
    p = "<p>" + "A sentence of some length, with a comma. " * 6 + "</p>"
    two = f"<body><main><article class='a'>{p * 3}</article></main><div><article class='b'>{p.replace('sentence', 'phrase') * 2}</article></div></body>"
    assert H.extract(two).count("A sentence") == 18 and H.extract(two).count("A phrase") == 12
    inside = f"<article>{p * 4}<div class='zq7'><div>Buy</div><div>now</div><div>here</div><div>cheap</div><div>more</div><div>top</div></div>{p}</article>"
    assert H.extract(inside).count("A sentence") == 30 and "cheap" not in H.extract(inside)
    links = f"<article>{p * 3}<ul>{'<li><a href=x>Another page</a></li>' * 5}</ul></article>"
    assert "Another" not in H.extract(links)
    long = f"<article>{p * 4}<pre>{'x = f(a, b); ' * 2000}</pre></article>"
    assert H.extract(long).count("A sentence") == 24 and "x = f" in H.extract(long)


def test_license_phrases_across_white_space():
    for gap in ("\n", "  ", "\xa0"):
        assert [d.label for d in L.detect(f"This text is released into the public{gap}domain.")] == ["public-domain"]


def test_small_strata_share_the_cutoffs_of_their_pool(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80))
    bad = lambda: " ".join("#" + "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(2)) for _ in range(80))
    assert R.least_size(0.02 / 5, 0.1 / 20) == 1322
    rows = [(i, good(), ("en", "fr", "de")[i % 3], 1) for i in range(1500)] + [(2000 + i, bad(), ("en", "fr", "de")[i % 3], None) for i in range(6)]
    rows += [(3000 + i, bad(), "it", None) for i in range(3)]
    got = {r["doc_id"]: r["kept"] for r in R.quality_rules(*labelled(spark, rows)).collect()}
    assert len(got) == len(rows) and sum(got[i] for i in range(1500)) >= 0.98 * 1500
    assert not any(got[2000 + i] for i in range(6)) and all(got[3000 + i] for i in range(3))


def test_rules_act_at_the_production_risk(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)), "en", 1) for i in range(1400)] + [(2000, " ".join("#" + a + b for a in "abcdefgh" for b in "abcdefghij"), "en", None)]
    out = R.quality_rules(*labelled(spark, rows)).collect()
    got = {r["doc_id"]: r["kept"] for r in out}
    assert sum(got[i] for i in range(1400)) >= 0.98 * 1400 and not got[2000] and not any(r["base_failed"] for r in out)


def test_odd_markup_loses_no_text():
    a, b, c = ("A first sentence, with words enough. " * 6).strip(), ("Then it's the second one; more words. " * 6).strip(), ("A third, at the end. " * 6).strip()
    assert H.extract(f"<article><p title=it's>{a}</p><p>{b}</p></article>") == f"{a}\n\n{b}"
    assert H.extract(f'<article><p class="x>{a}</p><p class="y">{b}</p></article>') == f"{a}\n\n{b}"
    assert H.extract(f'<article><p class="x>{a}</p></article>') == a
    assert H.extract(f'<body><div class="legal-analysis"><p>{a}</p><p>{b}</p></div></body>') == f"{a}\n\n{b}"
    assert H.extract(f'<body><div id="sponsored"><p>{a}</p><p>{b}</p></div><div class="ad">Buy it.</div></body>') == f"{a}\n\n{b}"
    assert H.extract(f'<article><p>{a}</p><p data-id="sidebar" title="class=ad">{b}</p><p>{c}</p><div class="ad-box">Buy cheap things, now.</div></article>') == f"{a}\n\n{b}\n\n{c}"
    assert H.extract(f"<p a='<b>' b=\"1\"c=2 d>{a}</p>") == a


def test_deep_and_long_pages_take_linear_time():
    import time

    for page in ("<div>x " * 20_000, "<b>x" * 20_000 + "<p>y" * 20_000, "<article>" + "<p>Some words, here.</p></i>" * 40_000, '<p a="' * 20_000, "<p a='b\"=" * 20_000):
        began = time.time()
        H.extract(page)
        assert time.time() - began < 8


def test_ratios_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        texts = [("word, " * rng.randint(1, 30)).strip() for _ in range(rng.randint(1, 25))]
        tags = [rng.choice(["p", "div", "li", "h2"]) for _ in texts]
        found, paths = H.blocks("<main>" + "".join(f"<{t} class=c{k % 3}>{x}</{t}>" for k, (t, x) in enumerate(zip(tags, texts))) + "</main>")
        assert [b.text for b in found] == texts
        ratio, level, count = H.ratios(found, len(paths.parent))
        name = [(t, k % 3) for k, t in enumerate(tags)]
        want = {n: sum(len(x) for x, m in zip(texts, name) if m == n) / name.count(n) * (1 + sum(x.count(",") for x, m in zip(texts, name) if m == n) / name.count(n)) for n in set(name)}
        for b, n in zip(found, name):
            assert abs(ratio[b.path] - want[n]) < 1e-6 and count[b.path] == name.count(n)
            near = [[(3 - abs(d)) * want[name[k + d]] for d in range(-2, 3) if 0 <= k + d < len(name)] for k, m in enumerate(name) if m == n]
            weights = [[3 - abs(d) for d in range(-2, 3) if 0 <= k + d < len(name)] for k, m in enumerate(name) if m == n]
            assert abs(level[b.path] - sum(sum(x) / sum(w) for x, w in zip(near, weights)) / name.count(n)) < 1e-6


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, 5), (None, None, "<article><p>Some words, here.</p></article>", 6), (None, None, "<article><p>Some words, here.</p></article>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in H.extract_pages(df).collect()) == [("", 0), ("Some words, here.", 17), ("Some words, here.", 17)]
    assert H.extract_pages(df.limit(0)).count() == 0


def test_license_of_odd_rows(spark):
    text = "Released into the public\ndomain. " + "x " * 50_000 + "cc by " * 5_000
    rows = [(None, text, "a"), (None, text, "a"), (1, None, "b"), (2, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((r["doc_id"] or 0, r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in L.scan_licenses(df).collect())
    assert got == [(0, 5000, 50005, 60003, "cc-by,public-domain")] * 2 + [(1, 0, None, None, ""), (2, 0, None, None, "")]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_suppression_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        made = {}
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 12)
            d = L.Detection(a, a + rng.randint(1, 8), rng.choice("xyz"), rng.choice([5, 10, 40]), 0.5)
            made[d[:3]] = d
        found = list(made.values())
        order = lambda d: (d.priority, d.label)
        covers = lambda k, d: k.start <= d.start and d.end <= k.end and k.priority <= d.priority and (k[:2] != d[:2] or order(k) < order(d))
        assert L.suppress(found) == sorted(d for d in found if not any(covers(k, d) for k in found if k is not d))


def test_secret_ownership_shows(spark):
    shared, own = "ghp_" + "wx" * 18, "ghp_" + "yz" * 18
    rows = [(i, f"key {shared}", f"s{i % 5}") for i in range(30)] + [(100, f"key {own} and {shared}", "s1"), (None, None, None)]
    got = {r["doc_id"]: r for r in S.secret_digest(S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert (got[100]["n_live"], got[100]["n_examples"], got[100]["spans"], got[100]["live_spans"]) == (1, 1, "vendor:4:44", "vendor:4:44")
    assert got[0]["spans"] == "" and got[0]["n_examples"] == 1 and got[None]["n_live"] == 0
