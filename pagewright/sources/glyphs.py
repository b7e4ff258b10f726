"""Glyph databases: (label, ulx, uly, nrows, ncols, state, ids, features, rle) as XML 2.0 files and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("UNCLASSIFIED", "AUTOMATIC", "HEURISTIC", "MANUAL")
SCHEMA = (
    "_uly int, _ulx int, _nrows int, _ncols int, "
    "ids struct<_state: string, id: array<struct<_name: string, _confidence: double>>>, data string, "
    "features struct<_scaling: double, feature: array<struct<_name: string, _VALUE: string>>>"
)


def load_xml(spark: SparkSession, path: str) -> DataFrame:
    """glyph relation of the <glyph> elements of files; a glyph without its box is an error."""
    g = spark.read.format("xml").option("rowTag", "glyph").schema(SCHEMA).load(path)
    box = {c: F.coalesce(F.col(f"_{c}"), F.raise_error(F.lit(f"glyph without {c}")).cast("int")) for c in ("ulx", "uly", "nrows", "ncols")}
    ids = F.transform(F.coalesce(F.col("ids.id"), F.array().cast("array<struct<_name:string,_confidence:double>>")), lambda i: F.struct(i["_confidence"].alias("confidence"), i["_name"].alias("name")))
    values = F.transform(F.col("features.feature"), lambda f: F.struct(f["_name"].alias("name"), F.transform(F.split(F.trim(f["_VALUE"]), r"\s+"), lambda x: x.cast("double")).alias("values")))
    return g.select(*[c.alias(n) for n, c in box.items()], F.coalesce("ids._state", F.lit("UNCLASSIFIED")).alias("state"), ids.alias("ids"), values.alias("features"), F.trim("data").alias("rle"))


def save_xml(glyphs: DataFrame, path: str, compressed: bool = False) -> None:
    """Writes glyphs as XML 2.0 under <glyphs>; features must be arrays of (name, values)."""
    out = glyphs.select(
        F.col("uly").alias("_uly"), F.col("ulx").alias("_ulx"), F.col("nrows").alias("_nrows"), F.col("ncols").alias("_ncols"),
        F.struct(F.col("state").alias("_state"), F.transform("ids", lambda i: F.struct(i["name"].alias("_name"), i["confidence"].alias("_confidence"))).alias("id")).alias("ids"),
        F.col("rle").alias("data"),
        F.struct(F.lit(1.0).alias("_scaling"), F.transform("features", lambda f: F.struct(f["name"].alias("_name"), F.array_join(F.transform(f["values"], lambda x: x.cast("string")), " ").alias("_VALUE"))).alias("feature")).alias("features"),
    )
    w = out.write.mode("overwrite").format("xml").option("rootTag", 'glyphs version="2.0"').option("rowTag", "glyph")
    (w.option("compression", "gzip") if compressed else w).save(path)


def strip_features(glyphs: DataFrame) -> DataFrame:
    return glyphs.drop("features")


# --- classification state --------------------------------------------------------------------------


def one_id(name, confidence: float) -> Column:
    name = name if isinstance(name, Column) else F.lit(name)
    return F.array(F.struct(F.lit(float(confidence)).alias("confidence"), name.alias("name")))


def unclassify(glyphs: DataFrame) -> DataFrame:
    return glyphs.withColumn("state", F.lit("UNCLASSIFIED")).withColumn("ids", F.array().cast("array<struct<confidence:double,name:string>>"))


def classify_manual(glyphs: DataFrame, name, where: Column | None = None) -> DataFrame:
    return set_state(glyphs, "MANUAL", one_id(name, 1.0), where)


def classify_automatic(glyphs: DataFrame, ids: Column, where: Column | None = None) -> DataFrame:
    """Glyphs that were classified by hand stay as they are."""
    free = F.col("state") != "MANUAL"
    return set_state(glyphs, "AUTOMATIC", ids, free if where is None else free & where)


def classify_heuristic(glyphs: DataFrame, name, confidence: float = 0.75, where: Column | None = None) -> DataFrame:
    free = F.col("state") != "MANUAL"
    return set_state(glyphs, "HEURISTIC", one_id(name, confidence), free if where is None else free & where)


def set_state(glyphs: DataFrame, state: str, ids: Column, where: Column | None) -> DataFrame:
    cond = F.lit(True) if where is None else where
    return glyphs.withColumns({"state": F.when(cond, state).otherwise(F.col("state")), "ids": F.when(cond, ids).otherwise(F.col("ids"))})


def main_id() -> Column:
    return F.coalesce(F.get(F.col("ids"), F.lit(0))["name"], F.lit("UNCLASSIFIED"))


def has_id_name(name: str) -> Column:
    return F.exists("ids", lambda i: i["name"] == name)


# --- glyphs of several labels ----------------------------------------------------------------------


def add_label(labels: str, label: int) -> Column:
    return F.array_union(labels, F.array(F.lit(label)))


def remove_label(labels: str, label: int) -> Column:
    return F.array_remove(labels, label)


def merge_labels(px: DataFrame, groups: DataFrame) -> DataFrame:
    """px with each label replaced by its group's smallest; groups(image_id, labels array)."""
    m = groups.select("image_id", F.array_min("labels").alias("to"), F.explode("labels").alias("v"))
    return px.join(m, ["image_id", "v"], "left").select("image_id", "y", "x", F.coalesce("to", "v").alias("v"))


def split_labels(groups: DataFrame) -> DataFrame:
    return groups.select("image_id", F.explode("labels").alias("label"))
