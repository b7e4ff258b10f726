"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The schedule has 2^p slots. Slot n's van der Corput point is n with its p bits reversed, over 2^p; the
points are mapped through the sources' cumulative targets, each source owning an interval of the grid.
A slot's rank among its source's slots has a closed form, one term per bit, so ranking needs no sort
and no shuffle. Each source's documents, in shuffled order, form a stream of words cut into blocks of
``block_words``; slot and block meet in a join on (source, rank). A source whose target exceeds its
size starts its stream again, at most three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MOST = 3  # times a document may be taken
BLOCK_WORDS = 32
#: Grid cells that one row stands for before they are expanded, and documents of a bucket of the shuffled order.
CHUNK, BUCKET = 1 << 12, 2_000
#: Slots that one task unfolds, and the most tasks that do.
TASK_SLOTS, MOST_TASKS = 1 << 17, 1 << 15


def word_count(text: str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ of a text; null has none.

    Every run of the six spaces becomes one space; a text then has one word more than inner spaces.
    """
    flat = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    spaces = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(flat == "", 0).otherwise(spaces + 1), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, number, source_size, target) of each source: all words shared out by weight, no target above MOST sizes.

    The excess of capped sources is reshared by weight until none is above. Sources are capped in the
    order of size over weight, so the fixed point is the first prefix after which none exceeds its cap.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # a row per source
    cycle = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    by = by.withColumn("number", (F.row_number().over(w) - 1).cast("long")).withColumn("weight", cycle)
    order = Window.partitionBy(F.lit(0)).orderBy((MOST * F.col("source_size") / F.col("weight")), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    by = (
        by.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("taken_size", F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("taken_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    left, rest = F.col("total") - F.col("taken_size"), F.col("weights") - F.col("taken_weight")
    by = by.withColumn("capped", F.col("weight") * left > MOST * F.col("source_size") * rest)
    free = F.min(F.when(~F.col("capped"), F.struct("taken_size", "taken_weight"))).over(everything)
    by = by.withColumn("free", free)
    share = (F.col("weight") * (F.col("total") - F.col("free.taken_size"))).cast("double") / (F.col("weights") - F.col("free.taken_weight"))
    cap = (MOST * F.col("source_size")).cast("double")
    target = F.when(F.col("capped") | F.col("free").isNull(), cap).otherwise(share)
    return by.select("source", "number", "source_size", target.alias("target"))


def intervals(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds the source's interval [low, high) of grid cells: cumulative targets in blocks, rounded."""
    w = Window.partitionBy(F.lit(0)).orderBy("number")
    upto = F.sum("target").over(w)
    cut = lambda x: F.floor(x / block_words + 0.5).cast("long")
    return targets.withColumn("high", cut(upto)).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0)))


def bit_reversed(cell: Column, p: int) -> Column:
    out = F.lit(0).cast("long")
    for k in range(p):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, k).bitwiseAND(F.lit(1)), p - 1 - k))
    return out


def rank_of_slot(cell: Column, low: Column, high: Column, p: int) -> Column:
    """How many slots before this one have their point in [low, high).

    A slot before n shares n's leading bits, has 0 where n has a 1 (bit p-1-m), and is free below; its
    point then is r + f 2^(m+1) with r the lowest m bits of n's point and f free.
    """
    out = F.lit(0).cast("long")
    for m in range(p):
        r = cell.bitwiseAND(F.lit((1 << m) - 1))
        under = lambda x, r=r, m=m: F.shiftright(x - r - 1, m + 1)
        out = out + F.when(F.shiftright(cell, m).bitwiseAND(F.lit(1)) == 1, under(high) - under(low)).otherwise(F.lit(0).cast("long"))
    return out


def slots(sources: DataFrame, p: int) -> DataFrame:
    """(slot, number, rank) of every slot of the schedule; sources as from ``intervals``.

    The chunks are few bytes, which adaptive execution would put into one task, so their partitions are counted here.
    """
    tasks = min(MOST_TASKS, max(1, (1 << p) // TASK_SLOTS))
    chunks = sources.where("high > low").select(
        "number", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor((F.col("high") - 1) / CHUNK))).alias("chunk")
    )
    cells = chunks.repartition(tasks, "number", "chunk").select(
        "number", "low", "high", F.explode(F.sequence(F.greatest("low", F.col("chunk") * CHUNK), F.least("high", (F.col("chunk") + 1) * CHUNK) - 1)).alias("cell")
    )
    return cells.select(bit_reversed(F.col("cell"), p).alias("slot"), "number", rank_of_slot(F.col("cell"), F.col("low"), F.col("high"), p).alias("rank"))


def shuffled_streams(sized: DataFrame, targets: DataFrame, documents: int) -> DataFrame:
    """Adds ``start``, the place of a document's first word in its source's shuffled stream.

    The order is that of md5(doc_id); ties go by doc_id and size. Prefix sums run in two levels (hash
    buckets, then documents of a bucket), so no task has to hold a source.
    """
    digits, n = 0, documents
    while n > BUCKET:
        digits, n = digits + 1, n / 16
    named = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    named = named.withColumn("bucket", F.substring("shuffle", 1, digits))
    inner = Window.partitionBy("number", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = named.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    outer = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = named.groupBy("number", "bucket").agg(F.sum("size").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(outer), F.lit(0))).drop("held")
    return within.join(ahead, ["number", "bucket"]).withColumn("start", F.col("within") + F.col("ahead")).drop("within", "ahead", "bucket", "shuffle")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mixture's schedule and its totals.

    Totals: one row per row of ``docs`` with doc_id, size, source_size, target and taken, and of its slots the
    first and their number. Schedule: a row per piece of a document in a slot (slot, number, rank, doc_id, start,
    size, words). Very long texts are cut into many blocks; ties of the shuffled order go by doc_id, then size; null texts have no words; null is a source, the last; null ids sort first in a stream; repeated
    rows are documents of their own; other columns are ignored; an empty table gives empty results.
    """
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("shuffle")), "sized")
    targets = materialize(intervals(source_targets(sized, weights), block_words), "targets")
    last = targets.agg(F.max("high").alias("cells"), F.max("number").alias("n")).first()
    p = max(1, int(last["cells"] or 0).bit_length())
    streams = materialize(shuffled_streams(sized, targets, sized.count()), "streams")
    turns = F.least(F.lit(MOST), F.ceil((F.col("high") - F.col("low")) * block_words / F.greatest("source_size", F.lit(1)))).cast("int")
    turned = streams.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.greatest(turns, F.lit(1)) - 1)))
    turned = turned.withColumn("from", F.col("turn") * F.col("source_size") + F.col("start"))
    pieces = turned.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words))))
    words = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * block_words) - F.greatest("from", F.col("rank") * block_words)
    pieces = pieces.select("number", "rank", "doc_id", "start", "size", words.alias("words"))
    # both sides unfold from few rows, which misleads size estimates: neither may be broadcast
    schedule = slots(targets, p).hint("merge").join(pieces, ["number", "rank"])
    taken = schedule.groupBy("number", "start", "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    totals = streams.join(taken.hint("merge"), ["number", "start", "size"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))
    return schedule, totals


#: DuckDB equivalent of the totals: the same shares and streams; the schedule's slots are sorted and counted, not ranked in closed form.
TOTALS_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS shuffle FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM by_source),
weighted AS (SELECT *, (CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM numbered),
summed AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
    coalesce(3 * sum(source_size) OVER o, 0)::BIGINT AS taken_size, coalesce(sum(weight) OVER o, 0)::BIGINT AS taken_weight
  FROM weighted WINDOW o AS (ORDER BY 3 * source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capping AS (SELECT *, weight * (total - taken_size) > 3 * source_size * (weights - taken_weight) AS capped FROM summed),
free AS (SELECT min(taken_size) AS fs, min(taken_weight) AS fw FROM capping WHERE NOT capped),
targets AS (
  SELECT source, number, source_size,
    CASE WHEN capped OR fs IS NULL THEN (3 * source_size)::DOUBLE ELSE (weight * (total - fs))::DOUBLE / (weights - fw) END AS target
  FROM capping, free),
cuts AS (SELECT *, floor(sum(target) OVER (ORDER BY number) / {BLOCK_WORDS} + 0.5)::BIGINT AS high FROM targets),
cells AS (SELECT *, coalesce(lag(high) OVER (ORDER BY number), 0) AS low, greatest(1, len(CASE WHEN max(high) OVER () > 0 THEN bin(max(high) OVER ()) ELSE '0' END)) AS p FROM cuts),
points AS (SELECT number, list_sum([((cell >> k) & 1) << (p - 1 - k) FOR k IN range(p)])::BIGINT AS slot FROM (SELECT number, p, unnest(range(low::BIGINT, high::BIGINT)) AS cell FROM cells)),
slots AS (SELECT number, slot, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM points),
streams AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.number,
    coalesce(sum(d.size) OVER (PARTITION BY c.number ORDER BY d.shuffle, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN cells c ON d.source IS NOT DISTINCT FROM c.source),
numbered_streams AS (SELECT *, row_number() OVER () AS k FROM streams),
turns AS (SELECT k, number, start + turn * source_size AS a, start + turn * source_size + size AS b FROM numbered_streams, (SELECT unnest(range({MOST})) AS turn) WHERE size > 0),
pieces AS (SELECT k, number, a, b, unnest(range((a // {BLOCK_WORDS})::BIGINT, ((b - 1) // {BLOCK_WORDS} + 1)::BIGINT)) AS rank FROM turns),
taken AS (
  SELECT k, sum(least(b, (rank + 1) * {BLOCK_WORDS}) - greatest(a, rank * {BLOCK_WORDS}))::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_slots
  FROM pieces JOIN slots USING (number, rank) GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM numbered_streams LEFT JOIN taken USING (k)
"""
