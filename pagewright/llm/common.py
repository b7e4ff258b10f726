"""Shared helpers: reading tables, Arrow row mapping, durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space, so that
#: ``translate(...).split()`` yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of UTF-8 text.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII; null has none."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` cuts at exactly these six bytes."""
    return text.split() if text else []


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, binary: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``fn`` over each partition's rows (tuples in column order) and gathers the tuples it yields.

    Columns named in ``binary`` arrive as UTF-8 bytes. Rows go in and out as Arrow batches of at
    most about 8 MB of text, so memory does not grow with the partition.
    """
    spark = df.sparkSession
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = []
                for name, col in zip(names, part.columns, strict=True):
                    if name in binary:
                        col = as_bytes(col)
                    cols.append(col.to_pylist())
                yield from zip(*cols, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in fn(rows(batches)):
            out.append(row)
            size += 64 + sum(len(x) if isinstance(x, str | bytes) else 40 * len(x) if isinstance(x, list) else getattr(x, "nbytes", 0) for x in row)
            if size > 8_000_000 or len(out) >= 8192:
                yield batch_of(out, arrow)
                out, size = [], 0
        if out:
            yield batch_of(out, arrow)

    assert spark is not None
    return df.mapInArrow(run, schema)


def as_bytes(col: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes, without a copy."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())


def batch_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; one of our own only where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pagewright-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only unread files' readers, never the work before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two more columns that identify a row for good, and their names.

    Rows of Parquet files are named by a hash of their file and their place in it, which stay the same however the
    files are split into tasks. Any other input is numbered once and written, so that later scans see the same numbers.
    """
    names = tuple(free_name(docs, x) for x in ("__file", "__row"))
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        try:
            meta = docs.metadataColumn("_metadata")
            return docs.withColumns({names[0]: F.xxhash64(meta["file_path"]), names[1]: meta["row_index"]}), names
        except AnalysisException:  # a source without places of rows
            pass
    numbered = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.monotonically_increasing_id()})
    return materialize(numbered, "numbered"), names


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key of more rows than this, and than one in HOT_KEYS of all rows, is dealt to several tasks.
HOT_ROWS, HOT_KEYS = 512, 10_000


def join_hot(big: DataFrame, small: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, whose rows are unique by ``key`` and hold in ``n`` how many rows of ``big`` have it.

    Frequent keys are salted: their rows of ``big`` are dealt over as many parts as they need, each of which gets a
    copy of the key's row of ``small``. At most HOT_KEYS keys can be frequent, so their list may be broadcast; ``small`` never is.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(small.where(F.col(n) > least).select(key, F.ceil(F.col(n) / least).cast("int").alias("__parts")))
    spread = big.join(hot, key, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns), F.col("__parts"))).cast("int")).drop("__parts")
    copies = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return spread.join(copies.hint("merge"), [key, "__salt"]).drop("__salt")


def smallest_hashes(df: DataFrame, n: int, order: str = "order") -> DataFrame:
    """The n rows of smallest 64-bit hash ``order``.

    A bound on the hash, set by the number of rows, first leaves about 2 n of them, so that no task
    sends n rows of its own to be merged.
    """
    total = df.count()
    if total > 4 * n:
        bound = -(2**63) + int(2**64 * (2 * n / total))
        few = df.where(F.col(order) < bound)
        if few.count() >= n:
            df = few
    return df.orderBy(order, *[c for c in df.columns if c != order]).limit(n)


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id's text modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod, F.lit(-1))


def filter_rows(df: DataFrame, make: Callable[[], Callable], *columns: str) -> DataFrame:
    """Keeps the rows for which the test that ``make`` builds, once a task, is true; nothing is shuffled.

    The test gets the columns' values, strings as UTF-8 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = []
                for name in columns:
                    col = part.column(name)
                    cols.append((as_bytes(col) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col).to_pylist())
                yield part.filter(pa.array([bool(test(*x)) for x in zip(*cols, strict=True)], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
