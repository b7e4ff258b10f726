"""From raw documents to a training mixture: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import filter_rows, materialize, table
from pagewright.llm.decontaminate import contamination
from pagewright.llm.line_dedup import SHORTEST, dedup_lines
from pagewright.llm.mixing import mixture
from pagewright.llm.quality_classifier import Features, fit
from pagewright.llm.simhash import near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.5 or more. Null text counts as empty; repeated rows are judged alike; an empty table stays empty."""
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))

    def make():
        good, bad, calibration = shared.value
        own = Features(good, bad)
        return lambda raw: calibration is None or calibration.score(own.of(raw or b"")) >= 0.5

    return filter_rows(docs, make, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that near-repeat an earlier one; n_chars follows the text.

    A document that lost lines goes if no line of at least SHORTEST words is left of it. Repeated rows lose what
    their first copy holds; an empty table stays empty.
    """
    out = dedup_lines(docs)
    dropped = F.col(out.columns[-1])
    left = F.exists(F.split(F.col("text"), "\n", -1), lambda line: F.size(F.split(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), " ")) >= SHORTEST)
    out = out.where((dropped == 0) | left)
    if "n_chars" in docs.columns:
        changed = F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one of the smallest id. Documents of null id stay.

    Of rows that repeat the id that stays, one does.
    """
    found = materialize(near_duplicates(docs), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    repeated = materialize(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    repeated = repeated.hint("merge")
    return out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Documents of null id go together if any is hit."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words, first slot and number of slots of every document of the mixture; repeated rows are documents of their own, an empty table gives none."""
    return mixture(docs)[1]


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix)]
#: The classifier, the line and the fingerprint stages aren't expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
