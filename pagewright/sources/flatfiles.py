"""Flat text and fixed-record binary files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """(cells): each line's cells as doubles where they are numbers, else null; empty lines are left out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.transform(F.split(F.trim("value"), separator), lambda x: x.try_cast("double")).alias("cells"))


def getstrings(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), separator).alias("cells"))


def getcsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def put(df: DataFrame, path: str, delimiter: str = " ") -> None:
    """Writes all columns as delimited text."""
    df.select(F.concat_ws(delimiter, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def writedelimited(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, header=header)


def writecc(df: DataFrame, path: str, extra: int = 2) -> None:
    """Columns padded to their widest value."""
    text = {c: F.col(c).cast("string") for c in df.columns}
    widths = df.agg(*[F.max(F.length(x)).alias(c) for c, x in text.items()]).first()
    df.select(F.concat(*[F.lpad(F.coalesce(x, F.lit("")), int(widths[c] or 0) + extra, " ") for c, x in text.items()]).alias("value")).write.mode("overwrite").text(path)


def binget(spark: SparkSession, path: str, code: str = "<d", offset: int = 0) -> DataFrame:
    """(path, k, value): numbers of a struct code, after a header of ``offset`` bytes."""
    size = struct.calcsize(code)

    def run(batches):
        for pdf in batches:
            for p, d in zip(pdf["path"], pdf["content"], strict=True):
                body = bytes(d)[offset:]
                values = [float(x[0]) for x in struct.iter_unpack(code, body[: len(body) // size * size])]
                yield pd.DataFrame({"path": p, "k": range(len(values)), "value": values})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, k long, value double")


def braw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def binput(df: DataFrame, column: str, order: list[str], code: str = "<d") -> bytes:
    """Numbers of a column as bytes; for small results."""
    return b"".join(struct.pack(code, r[0]) for r in df.orderBy(*order).select(column).toLocalIterator())
