"""Helpers on tables: positional joins, filters by value, recoding, collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def abut(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Puts tables side by side by position; the shorter one repeats from its start."""
    n, m = a.count(), b.count()
    size = max(n, m)
    left = repeated(numbered(a, order_a), n, size)
    right = repeated(numbered(b, order_b), m, size)
    return left.join(right, "__at").drop("__at")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __at from 0: ranges of the order are numbered by themselves, then offset."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inner = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    offsets = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = offsets.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inner.join(offsets, "__part").withColumn("__at", F.col("__in") + F.col("__off")).drop("__part", "__in", "__off")


def repeated(df: DataFrame, n: int, size: int) -> DataFrame:
    if n >= size or not n:
        return df
    turns = -(-size // n)
    return df.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("__at", F.col("__at") + F.col("__turn") * n).where(F.col("__at") < size).drop("__turn")


def simpleabut(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    return numbered(a, order_a).join(numbered(b, order_b), "__at").drop("__at")


def colex(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def collapse(df: DataFrame, keep: list[str], column: str, f=F.avg, sterr: bool = False, count: bool = False) -> DataFrame:
    """One row per combination of ``keep`` with f of the column, and its standard error and number if asked."""
    out = [f(column).alias(column)]
    if sterr:
        out.append((F.stddev_samp(column) / F.sqrt(F.count(column))).alias("sterr"))
    if count:
        out.append(F.count(column).alias("n"))
    return df.groupBy(*keep).agg(*out)


def dm(df: DataFrame, criterion: str) -> DataFrame:
    return df.where(criterion)


def flat(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.explode(column))


def linexand(df: DataFrame, **values) -> DataFrame:
    """Rows where all columns have their value."""
    for c, x in values.items():
        df = df.where(F.col(c) == x)
    return df


def linexor(df: DataFrame, **values) -> DataFrame:
    """Rows where some column has one of its values."""
    cond = F.lit(False)
    for c, x in values.items():
        cond = cond | F.col(c).isin(x if isinstance(x, list | tuple) else [x])
    return df.where(cond)


def linedelimited(columns: list[str], delimiter: str = " ") -> Column:
    return F.concat_ws(delimiter, *[F.col(c).cast("string") for c in columns])


def lineincols(columns: list[str], width: int) -> Column:
    return F.concat(*[F.lpad(F.substring(F.col(c).cast("string"), 1, width), width, " ") for c in columns])


def lineincustcols(columns: list[str], widths: list[int]) -> Column:
    return F.concat(*[F.lpad(F.substring(F.col(c).cast("string"), 1, w), w, " ") for c, w in zip(columns, widths, strict=True)])


def makestr(column: str) -> Column:
    return F.col(column).cast("string")


def makelol(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.array(*[F.struct(*columns)]).alias("rows"))


def replace(df: DataFrame, old, new, columns: list[str] | None = None) -> DataFrame:
    return df.replace(old, new, columns)


def recode(column: str, mapping: dict) -> Column:
    """Values by the mapping; others stay."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[F.col(column)], F.col(column))


def remap(df: DataFrame, column: str, expression: str) -> DataFrame:
    return df.withColumn(column, F.expr(expression))


def roundlist(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sortby(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(*columns)


def nonrepeats(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n = 1").select(*columns)
