"""Secret scan with corpus-wide ownership frequency.

Every candidate's value is hashed; a hash seen under many owners or in many repositories is a widely
copied example, one that stays with a few is live-looking. Only the latter add spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_rows, materialize

#: In the order in which kinds are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "key", "jwt", "vendor", "url")
BASE = 3
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the method adds: (kind, literals of which one must occur, pattern, group that holds the value).
ADDED = (
    (3, ("PRIVATE KEY",), re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"), 0),
    (4, ("eyJ",), re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    (
        5,
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "rk_live_", "AIza", "glpat-", "npm_"),
        re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36})"),
        0,
    ),
    (6, ("://",), re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s/@]{6,128})@"), 1),
)


def find_secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; offsets are code points. Null counts as empty."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, literals, pattern, group in ADDED:
        if any(x in text for x in literals):
            found += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def spans_of(found: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in found)


FINDING = "struct<kind:int,start:long,end:long,hash:long>"


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_sha256 and ``findings``.

    A finding has kind (index into KINDS), start, end, hash of the value, n_owners, n_repositories
    (distinct owner and repository pairs) and ``live``: false where more than ``max_owners`` owners or
    ``max_repositories`` repositories hold the same value. Null owners and repositories count as one
    value each. Findings are ordered by start, then kind, then end. Null text is empty; very long texts are scanned
    whole; extra columns are ignored; repeated rows give repeated results, and a repeated repository counts once;
    null ids are kept as they are; an empty table gives an empty result.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, doc_id, own, repo, text in rows:
            found = find_secrets(text)
            n = [0] * len(KINDS)
            for x in found:
                n[x[0]] += 1
            sha = hashlib.sha256(spans_of([x for x in found if x[0] < BASE]).encode()).hexdigest()
            hashed = [(k, a, b, xxhash.xxh3_64_intdigest(v.encode()) - 2**63) for k, a, b, v in found]
            yield row, doc_id, own, repo, n[0], n[1], n[2], sha, [dict(zip(("kind", "start", "end", "hash"), x, strict=True)) for x in hashed]

    picked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repo"), "text")
    schema = f"row long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{FINDING}>"
    scan = materialize(map_rows(picked, run, schema), "secrets")
    each = scan.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f"))
    pairs = each.select(F.col("f.hash").alias("hash"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo")).distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    freq = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    of = each.select("row", "f", F.col("f.hash").alias("hash"))
    freq = freq.join(of.groupBy("hash").agg(F.count("*").alias("n_rows")), "hash").withColumn("live", live)
    total = scan.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    known = join_hot(of, materialize(freq, "owners"), "hash", "n_rows", total)
    finding = F.struct(*[F.col(f"f.{x}").alias(x) for x in ("start", "kind", "end", "hash")], "n_owners", "n_repositories", "live")
    by_row = known.groupBy("row").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    return scan.drop("found", "owner", "repo").join(by_row, "row", "left").drop("row")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: base spans stay, live-looking additions join them; and what the method says of all findings.

    n_live, n_examples: findings of any kind that look live or are widely copied; live_spans: the former's spans.
    """
    kinds = F.array(*map(F.lit, KINDS))
    shown = lambda xs: F.coalesce(F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))), F.lit(""))
    size = lambda xs: F.coalesce(F.size(xs), F.lit(0)).cast("long")
    some = F.coalesce("findings", F.array().cast(scanned.schema["findings"].dataType))
    live = F.filter(some, lambda x: x["live"])
    spans = shown(F.filter(some, lambda x: (x["kind"] < BASE) | x["live"]))
    counts = (size(live).alias("n_live"), size(F.filter(some, lambda x: ~x["live"])).alias("n_examples"))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), *counts, shown(live).alias("live_spans"))
