"""Inputs of the registered queries, as DataFrames and as the same relations in DuckDB SQL.

``chats``: a greyscale image of 32 columns for each turn of a conversation. ``pages``: one of 64 columns
for each document. ``glyph vectors``: the embeddings with their labels. Rectangles and a graph come from
the order tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.raster import ink, text_raster
from .scratch import keep

__all__ = ["QUERIES", "SQL", "add", "add_pixel_sql", "add_pixels", "chats", "chats2", "docs", "dots", "edges", "glyphs", "keep", "pages", "rects", "rgb", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters, so pixels, of a task.
TASK_PIXELS = 1 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A file of one row group is one task; texts are dealt out before they unfold into pixels.

    Their number of parts grows with their characters: parts chosen by the size of the texts would unfold into as many
    times that size, and a task's windows hold its part.
    """
    n = df.agg(F.sum(F.length("text"))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_PIXELS)), key)


def whole_rows(text: str, width: int):
    """The text with spaces up to a full last row."""
    return F.concat(F.col(text), F.repeat(F.lit(" "), F.pmod(-F.length(text), F.lit(width))))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("image_id"), whole_rows("text", 32).alias("text"))
    return text_raster(spread(c, "image_id"), "image_id", "text", 32)


def chats2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).withColumn("v", ((F.col("v") * 31 + 17) % 256).cast("int"))


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-bit chats."""
    return ink(chats(spark, sf_dir))


def rgb(px: DataFrame) -> DataFrame:
    v = F.col("v")
    return px.withColumn("v", F.struct(v.alias("r"), (v * 7 % 256).alias("g"), (v * 13 % 256).alias("b")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), whole_rows("text", 64).alias("text"))
    return text_raster(spread(d, "image_id"), "image_id", "text", 64)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-bit pages."""
    return ink(pages(spark, sf_dir))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class"), F.col("embedding").cast("array<double>").alias("features"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each supplier's part line: image_id = l_suppkey, id, ulx, uly, lrx, lry."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 1000, F.col("l_orderkey") % 1000
    return li.select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.cast("int").alias("ulx"), y.cast("int").alias("uly"), (x + F.col("l_quantity").cast("int")).cast("int").alias("lrx"), (y + F.col("l_linenumber") * 3).cast("int").alias("lry"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation, numbered by key, linked to those 1, 3 and 10 further on: src, dst, cost, label."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("r"))
    a = c.select("c_nationkey", F.col("c_custkey").alias("src"), F.col("c_acctbal").alias("p"), F.explode(F.array(F.col("r") + 1, F.col("r") + 3, F.col("r") + 10)).alias("r"))
    b = c.select("c_nationkey", F.col("c_custkey").alias("dst"), F.col("c_acctbal").alias("q"), "r")
    return a.join(b, ["c_nationkey", "r"]).select("src", "dst", F.abs(F.round(F.col("p") - F.col("q"), 2)).alias("cost"), F.lit("").alias("label"))


CHATS = """chats AS (SELECT image_id, (k // 32)::INT AS y, (k % 32)::INT AS x, (unicode(ch) % 256)::INT AS v FROM (
  SELECT conv_id * 1000 + turn AS image_id, unnest(string_split(text, '')) AS ch, unnest(range(len(text))) AS k FROM (SELECT * REPLACE (text || repeat(' ', (32 - len(text) % 32) % 32) AS text) FROM conversations WHERE text <> '')))"""
PAGES = """pages_ AS (SELECT image_id, (k // 64)::INT AS y, (k % 64)::INT AS x, (unicode(ch) % 256)::INT AS v FROM (
  SELECT doc_id AS image_id, unnest(string_split(text, '')) AS ch, unnest(range(len(text))) AS k FROM (SELECT * REPLACE (text || repeat(' ', (64 - len(text) % 64) % 64) AS text) FROM documents WHERE text <> '')))"""
WITH = {
    "chats": CHATS,
    "chats2": "chats2 AS (SELECT image_id, y, x, (v * 31 + 17) % 256 AS v FROM chats)",
    "dots": "dots AS (SELECT image_id, y, x, (v > 32)::INT AS v FROM chats)",
    "rgb": "rgb AS (SELECT image_id, y, x, v AS r, v * 7 % 256 AS g, v * 13 % 256 AS b FROM chats)",
    "size": "size AS (SELECT image_id, max(y) + 1 AS nrows, max(x) + 1 AS ncols FROM chats GROUP BY image_id)",
    "pages_": PAGES,
    "docs_": "docs_ AS (SELECT image_id, y, x, (v > 32)::INT AS v FROM pages_)",
    "dsize": "dsize AS (SELECT image_id, max(y) + 1 AS nrows, max(x) + 1 AS ncols FROM pages_ GROUP BY image_id)",
    "glyphs": "glyphs AS (SELECT vec_id AS id, label::VARCHAR AS class, embedding::DOUBLE[] AS f FROM embeddings)",
    "rects": "rects AS (SELECT l_suppkey AS image_id, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 1000)::INT AS ulx, (l_orderkey % 1000)::INT AS uly, (l_partkey % 1000 + l_quantity::INT)::INT AS lrx, (l_orderkey % 1000 + l_linenumber * 3)::INT AS lry FROM lineitem)",
    "edges": "ranked AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), edges AS (SELECT a.c_custkey AS src, b.c_custkey AS dst, abs(round(a.c_acctbal - b.c_acctbal, 2)) AS cost FROM ranked a JOIN ranked b ON a.c_nationkey = b.c_nationkey AND b.r - a.r IN (1, 3, 10))",
}
NEEDS = {"chats2": ["chats"], "dots": ["chats"], "rgb": ["chats"], "size": ["chats"], "docs_": ["pages_"], "dsize": ["pages_"]}


def with_clause(names: str) -> str:
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH RECURSIVE " + ",\n".join(WITH[n] for n in order)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, using: str = "") -> None:
    """Registers a query and, if SQL can express it, its equivalent over the relations ``using`` names; extra CTEs may lead the SQL after a comma."""
    QUERIES[name] = run
    if sql:
        SQL[name] = (with_clause(using) if using else "") + ("" if sql.lstrip().startswith(",") else "\n") + sql


#: Modulus of the digests, below 2^31 so that products of two residues fit a long.
PRIME = 2**31 - 1


def pixel_digest(px: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """One row an image: its number of pixels, the sum of its places' weights and, for each value, the weighted sum in millionths.

    Sums of integers by place: partial aggregates combine before the shuffle, and the order of rows doesn't matter.
    """
    place = (F.col("y").cast("long") * 1000003 + F.col("x") * 7919 + 12345) % PRIME
    own = px.select("image_id", place.alias("__w"), *[(F.floor(F.col(c).cast("double") * 1000000 + 0.5).cast("long") % PRIME).alias(c) for c in values])
    return own.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("__w").alias("places"), *[F.sum(F.col(c) * F.col("__w") % PRIME).alias(f"{c}_digest") for c in values])


def digest_sql(sql: str, values: tuple[str, ...]) -> str:
    own = ", ".join(f'floor("{c}"::DOUBLE * 1000000 + 0.5)::BIGINT % {PRIME} AS "{c}"' for c in values)
    sums = ", ".join(f'sum("{c}" * __w % {PRIME})::BIGINT AS "{c}_digest"' for c in values)
    return f"SELECT image_id, count(*) AS n, sum(__w)::BIGINT AS places, {sums} FROM (SELECT image_id, (y::BIGINT * 1000003 + x * 7919 + 12345) % {PRIME} AS __w, {own} FROM ({sql})) GROUP BY image_id"


def add_pixels(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, using: str = "", values: tuple[str, ...] = ("v",)) -> None:
    """Registers a query on pixels by the digests of its images; its whole tables are still read and every pixel enters."""
    add(name, lambda s, d: pixel_digest(run(s, d), values))
    if sql:
        add_pixel_sql(name, sql, using, values)


def add_pixel_sql(name: str, sql: str, using: str = "", values: tuple[str, ...] = ("v",)) -> None:
    """The equivalent of a query that ``add_pixels`` has registered."""
    lead = with_clause(using) if using else ""
    SQL[name] = digest_sql(lead + ("" if sql.lstrip().startswith(",") else "\n") + sql, values)
