"""Registered queries on file formats and streams: round trips through the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features
from ..sources import codecs, flatfiles
from ..sources import glyphs as X
from ..streaming import classify as C
from .base import add, add_pixels, chats, dots, glyphs, rgb, table
from .scratch import root

KEY = ["image_id", "y", "x"]


def folder(s) -> str:
    return f"{root(s)}/files-{uuid.uuid4().hex}"


def round_trip(s, px, kind: str, form: str):
    """Encodes every image, writes the files' bytes as a table, and decodes them again."""
    import numpy as np
    import pandas as pd

    f = folder(s)
    codecs.encoded(px, kind, form).write.parquet(f)

    def run(batches):
        for pdf in batches:
            for i, d in zip(pdf["image_id"], pdf["data"], strict=True):
                a = codecs.decode_png(bytes(d)) if form == "png" else codecs.decode_tiff(bytes(d))
                a = a if a.ndim == 2 else a[..., 0] * 65536 + a[..., 1] * 256 + a[..., 2]
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"image_id": i, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": a.ravel().astype("int32")})

    return s.read.parquet(f).mapInPandas(run, "image_id long, y int, x int, v int")


for form in ("png", "tiff"):
    add_pixels(f"{form}_greyscale_round_trip", lambda s, d, form=form: round_trip(s, chats(s, d), "greyscale", form), "SELECT image_id, y, x, v FROM chats", "chats")
    add_pixels(f"{form}_onebit_round_trip", lambda s, d, form=form: round_trip(s, dots(s, d), "onebit", form), "SELECT image_id, y, x, v FROM dots", "dots")
    add_pixels(f"{form}_grey16_round_trip", lambda s, d, form=form: round_trip(s, chats(s, d).withColumn("v", F.col("v") * 200), "grey16", form), "SELECT image_id, y, x, v * 200 AS v FROM chats", "chats")
    add_pixels(f"{form}_rgb_round_trip", lambda s, d, form=form: round_trip(s, rgb(chats(s, d)), "rgb", form), "SELECT image_id, y, x, r * 65536 + g * 256 + b AS v FROM rgb", "rgb")


def xml_round_trip(s, d):
    f = folder(s)
    g = features.to_rle(dots(s, d)).join(features.page_features(dots(s, d)), "image_id")
    g = g.select(F.lit(0).alias("uly"), F.col("image_id").cast("int").alias("ulx"), "nrows", "ncols", F.lit("MANUAL").alias("state"), X.one_id("latin.small", 1.0).alias("ids"), F.array(F.struct(F.lit("volume").alias("name"), F.array("volume").alias("values"))).alias("features"), "rle")
    X.save_xml(g, f)
    return X.load_xml(s, f).select("ulx", "nrows", "ncols", "state", F.col("ids")[0]["name"].alias("name"), F.round(F.col("features")[0]["values"][0], 9).alias("volume"), "rle")


add(
    "glyph_xml_round_trip",
    xml_round_trip,
    """, r AS (SELECT image_id, v > 0 AS b, y * 32 + x AS k, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - row_number() OVER (PARTITION BY image_id, v > 0 ORDER BY y, x) AS g FROM dots),
u AS (SELECT image_id, b, min(k) AS k, count(*) AS n FROM r GROUP BY image_id, b, g)
SELECT image_id::INT AS ulx, nrows, ncols, 'MANUAL' AS state, 'latin.small' AS name, round((sum(n) FILTER (b))::DOUBLE / (nrows * ncols), 9) AS volume,
  (CASE WHEN arg_min(b, k) THEN '0 ' ELSE '' END) || string_agg(n::VARCHAR, ' ' ORDER BY k) || (CASE WHEN arg_max(b, k) THEN '' ELSE ' 0' END) AS rle FROM u JOIN size USING (image_id) GROUP BY image_id, nrows, ncols""",
    "dots size",
)


def text_round_trip(s, d):
    f = folder(s)
    flatfiles.put(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), f)
    return flatfiles.get(s, f).select(F.col("cells")[0].cast("long").alias("p_partkey"), F.col("cells")[1].cast("int").alias("p_size"), F.col("cells")[2].alias("p_retailprice"))


add("flatfile_round_trip", text_round_trip, "SELECT p_partkey, p_size, p_retailprice FROM part")


def csv_round_trip(s, d):
    f = folder(s)
    flatfiles.writedelimited(table(s, d, "nation"), f)
    return flatfiles.getcsv(s, f, "n_nationkey int, n_name string, n_regionkey int", header=True)


add("csv_round_trip", csv_round_trip, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
add("windowed_counts", lambda s, d: C.windowed_counts(table(s, d, "events"), "ts", "event_type").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("at"), "event_type", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS \"at\", event_type, count(*) AS n FROM events GROUP BY ALL")
add("classification_states", lambda s, d: X.classify_heuristic(X.classify_manual(X.unclassify(glyphs(s, d)), F.col("class"), F.col("id") % 2 == 0), "guess", where=F.col("id") % 3 == 0).select("id", "state", X.main_id().alias("name"), X.has_id_name("guess").alias("guessed")), "SELECT id, CASE WHEN id % 2 = 0 THEN 'MANUAL' WHEN id % 3 = 0 THEN 'HEURISTIC' ELSE 'UNCLASSIFIED' END AS state, CASE WHEN id % 2 = 0 THEN class WHEN id % 3 = 0 THEN 'guess' ELSE 'UNCLASSIFIED' END AS name, id % 2 <> 0 AND id % 3 = 0 AS guessed FROM glyphs", "glyphs")


def stream(s, d):
    """Embeddings arrive as a stream of files and are classified against all of them."""
    f = folder(s)
    src = f"{f}/in"
    glyphs(s, d).select("id", "features").write.parquet(src)
    q = C.classify_stream(s.readStream.schema("id long, features array<double>").parquet(src), glyphs(s, d), f"{f}/out", f"{f}/check", 1)
    q.processAllAvailable()
    q.stop()
    return s.read.parquet(f"{f}/out").select("q", "class")


add("streaming_classification", stream, "SELECT id AS q, class FROM glyphs", "glyphs")
