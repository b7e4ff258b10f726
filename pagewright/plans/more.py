"""Registered queries on labels, regions, feature vectors, file round trips and graph restrictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import graph as H
from ..operators import knn, workflow
from ..operators import labels as M
from ..operators import segment as S
from ..sources import codecs
from ..sources import raster as R
from .base import add, add_pixels, chats, docs, dots, edges, glyphs, keep, rects, table
from .learning import PAIRS, VOTE

# --- pixels, points and images ---------------------------------------------------------------------

add("image_get_point", lambda s, d: M.get_point(chats(s, d), 3, 0), "SELECT image_id, v FROM chats WHERE x = 3 AND y = 0", "chats")
add_pixels("image_set_point", lambda s, d: M.set_point(chats(s, d), 3, 0, 7), "SELECT image_id, y, x, CASE WHEN x = 3 AND y = 0 THEN 7 ELSE v END AS v FROM chats", "chats")
add("image_get_item", lambda s, d: M.get_item(chats(s, d), 37), "SELECT image_id, v FROM chats JOIN size USING (image_id) WHERE y * ncols + x = 37", "chats size")
add("image_length", lambda s, d: M.length(chats(s, d)), "SELECT image_id, (nrows * ncols)::BIGINT AS n FROM size", "size")
add_pixels("image_white", lambda s, d: chats(s, d).withColumn("v", F.lit(M.white("greyscale"))), "SELECT image_id, y, x, 255 AS v FROM chats", "chats")
add_pixels("image_black", lambda s, d: dots(s, d).withColumn("v", F.lit(M.black_value("onebit"))), "SELECT image_id, y, x, 1 AS v FROM dots", "dots")
add("is_homogeneous_image_list", lambda s, d: s.createDataFrame([(M.is_homogeneous(chats(s, d).select(F.lit("greyscale").alias("pixel_type"))), M.is_homogeneous(table(s, d, "nation").select(F.col("n_regionkey").alias("pixel_type"))))], "one boolean, many boolean"), "SELECT true AS one, (SELECT count(DISTINCT n_regionkey) < 2 FROM nation) AS many")
add("point_move", lambda s, d: rects(s, d).select("image_id", "id", *[c.alias(n) for c, n in zip(M.move("ulx", "uly", 5, -3), ("x", "y"), strict=True)]), "SELECT image_id, id, ulx + 5 AS x, uly - 3 AS y FROM rects", "rects")
add("point_distance", lambda s, d: rects(s, d).select("image_id", "id", F.round(M.point_distance(F.col("ulx"), F.col("uly"), F.col("lrx"), F.col("lry")), 6).alias("d")), "SELECT image_id, id, round(sqrt(((ulx - lrx) ** 2 + (uly - lry) ** 2)::DOUBLE), 6) AS d FROM rects", "rects")
add(
    "rect_accessors",
    lambda s, d: rects(s, d).select("image_id", "id", (F.col("lry") - F.col("uly") + 1).alias("nrows"), (F.col("lrx") - F.col("ulx") + 1).alias("ncols"), S.center("", "x").cast("int").alias("center_x"), S.center("", "y").cast("int").alias("center_y"), F.col("lrx").alias("ur_x"), F.col("uly").alias("ur_y"), F.col("ulx").alias("ll_x"), F.col("lry").alias("ll_y")),
    "SELECT image_id, id, lry - uly + 1 AS nrows, lrx - ulx + 1 AS ncols, (ulx + lrx) // 2 AS center_x, (uly + lry) // 2 AS center_y, lrx AS ur_x, uly AS ur_y, ulx AS ll_x, lry AS ll_y FROM rects",
    "rects",
)
add("rect_contains_point", lambda s, d: rects(s, d).select("image_id", "id", F.lit(500).between(F.col("ulx"), F.col("lrx")).alias("contains_x"), F.lit(400).between(F.col("uly"), F.col("lry")).alias("contains_y"), (F.lit(500).between(F.col("ulx"), F.col("lrx")) & F.lit(400).between(F.col("uly"), F.col("lry"))).alias("contains_point")), "SELECT image_id, id, 500 BETWEEN ulx AND lrx AS contains_x, 400 BETWEEN uly AND lry AS contains_y, 500 BETWEEN ulx AND lrx AND 400 BETWEEN uly AND lry AS contains_point FROM rects", "rects")

# --- multi-label components and regions ------------------------------------------------------------


def mlcc(s, d):
    """Components of eight grey values each."""
    from ..operators import pixel as P

    return M.to_mlcc(P.ccs_from_labeled_image(chats(s, d))).withColumn("comp", F.col("label") % 8)


MLCC = ", l AS (SELECT image_id, v % 8 AS comp, v AS label, min(x) AS ulx, min(y) AS uly, max(x) AS lrx, max(y) AS lry FROM chats WHERE v > 0 GROUP BY image_id, v) "
add("mlcc_convert_to_mlcc", lambda s, d: mlcc(s, d), MLCC + "SELECT * FROM l", "chats")
add("mlcc_get_labels", lambda s, d: M.mlcc_boxes(mlcc(s, d)).withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")), MLCC + "SELECT image_id, comp, string_agg(label::VARCHAR, ',' ORDER BY label) AS labels, min(ulx) AS ulx, min(uly) AS uly, max(lrx) AS lrx, max(lry) AS lry FROM l GROUP BY image_id, comp", "chats")
add("mlcc_has_label", lambda s, d: M.has_label(mlcc(s, d), 101), MLCC + "SELECT image_id, comp, bool_or(label = 101) AS has FROM l GROUP BY image_id, comp", "chats")
add("mlcc_relabel", lambda s, d: M.mlcc_boxes(M.relabel(mlcc(s, d), mlcc(s, d).where("label >= 97").select("image_id", "label", (F.col("label") % 3).alias("comp")))).select("image_id", "comp", *M.BOX), MLCC + "SELECT image_id, label % 3 AS comp, min(ulx) AS ulx, min(uly) AS uly, max(lrx) AS lrx, max(lry) AS lry FROM l WHERE label >= 97 GROUP BY image_id, label % 3", "chats")
add("mlcc_convert_to_cc", lambda s, d: M.convert_to_cc(mlcc(s, d)), MLCC + "SELECT image_id, min(label) AS label, min(ulx) AS ulx, min(uly) AS uly, max(lrx) AS lrx, max(lry) AS lry FROM l GROUP BY image_id, comp", "chats")
add("mlcc_convert_to_cc_list", lambda s, d: M.convert_to_cc_list(mlcc(s, d)), MLCC + "SELECT * FROM l", "chats")
add(
    "mlcc_neighbors",
    lambda s, d: M.get_neighbors(mlcc(s, d), M.add_neighbors(mlcc(s, d).select("image_id", F.col("label").alias("a"), (F.col("label") + 8).alias("b")))),
    MLCC + "SELECT a.image_id, a.comp, a.label, b.label AS neighbor FROM l a JOIN l b ON a.image_id = b.image_id AND a.comp = b.comp AND abs(a.label - b.label) = 8",
    "chats",
)


def single(s, d):
    """Boxes whose id no other has."""
    return rects(s, d).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n = 1").drop("n")


SINGLE = ", one AS (SELECT * FROM rects QUALIFY count(*) OVER (PARTITION BY id) = 1)"


def regions(s, d):
    return single(s, d).where("lrx - ulx >= 30").select("image_id", "id", *M.BOX, F.create_map(F.lit("width"), (F.col("lrx") - F.col("ulx")).cast("double")).alias("values"))


add(
    "region_lookup",
    lambda s, d: M.region_lookup(regions(s, d), single(s, d).where("lrx - ulx < 30")).select("image_id", "id", "region", F.col("values")["width"].alias("width")),
    SINGLE + " SELECT b.image_id, b.id, a.id AS region, (a.lrx - a.ulx)::DOUBLE AS width FROM one a JOIN one b ON a.image_id = b.image_id AND a.lrx - a.ulx >= 30 AND b.lrx - b.ulx < 30 AND a.ulx <= b.ulx AND b.lrx <= a.lrx AND a.uly <= b.uly AND b.lry <= a.lry QUALIFY row_number() OVER (PARTITION BY b.image_id, b.id ORDER BY (a.lrx - a.ulx + 1)::BIGINT * (a.lry - a.uly + 1), a.id) = 1",
    "rects",
)

# --- features and classifier -----------------------------------------------------------------------

NAMED = ("nrows", "area", "black_area", "ncols", "volume")
VECTORS = "SELECT image_id AS {id}, k, round([(nr * nc)::DOUBLE, b::DOUBLE, nc::DOUBLE, nr::DOUBLE, b::DOUBLE / (nr * nc)][k + 1], 9) AS f FROM (SELECT image_id, max(y) + 1 AS nr, max(x) + 1 AS nc, sum(v) AS b FROM docs_ GROUP BY image_id), (SELECT unnest(range(5))::INT AS k)"
add("generate_features", lambda s, d: registry.feature_vectors(docs(s, d), NAMED).select("image_id", F.posexplode("features").alias("k", "f")).withColumn("f", F.round("f", 9)), VECTORS.format(id="image_id"), "docs_")
add("generate_features_on_glyphs", lambda s, d: workflow.generate_features_on_glyphs(docs(s, d), NAMED).select("id", F.posexplode("features").alias("k", "f")).withColumn("f", F.round("f", 9)), VECTORS.format(id="id"), "docs_")
add("get_feature_functions", lambda s, d: s.createDataFrame([(i, n, registry.get_feature_functions(NAMED)[1]) for i, (n, _) in enumerate(registry.get_feature_functions(NAMED)[0])], "place int, name string, length int"), "SELECT (k - 1)::INT AS place, list_sort(['nrows', 'area', 'black_area', 'ncols', 'volume'])[k] AS name, 5 AS length FROM (SELECT unnest(range(1, 6)) AS k)")
add("get_confidence", lambda s, d: knn.get_confidence(knn.confidences(near := knn.nearest(glyphs(s, d), glyphs(s, d), 3, skip_self=True), knn.majority(near), 3), "knnfraction").withColumn("confidence", F.round("confidence", 6)), PAIRS + VOTE + "SELECT q, class, round(n / 3.0::DOUBLE, 6) AS confidence FROM w", "glyphs")
add("classify_and_update_list_automatic", lambda s, d: workflow.classify_and_update_list_automatic(glyphs(s, d).withColumn("state", F.lit("UNCLASSIFIED")).withColumn("ids", F.array().cast("array<struct<confidence:double,name:string>>")), glyphs(s, d)).select("id", "state", F.col("ids")[0]["name"].alias("name")), "SELECT id, 'AUTOMATIC' AS state, class AS name FROM glyphs", "glyphs")
add(
    "group_and_update_list_automatic",
    lambda s, d: workflow.group_and_update_list_automatic(single(s, d).withColumn("name", F.lit("dot")), single(s, d).groupBy(F.floor(F.col("id") / 10).alias("root")).agg(F.array_sort(F.collect_list("id")).alias("members")), 10**9),
    SINGLE + ", g AS (SELECT *, id // 10 AS root, count(*) OVER (PARTITION BY id // 10) AS n FROM one) SELECT id, CASE WHEN n > 1 THEN '_group._part.dot' ELSE 'dot' END AS name, ulx, uly, lrx, lry FROM g UNION ALL SELECT min(id) + 1000000000, 'dot', min(ulx), min(uly), max(lrx), max(lry) FROM g WHERE n > 1 GROUP BY root",
    "rects",
)
add("merge_from_xml", lambda s, d: workflow.merge_from_xml(glyphs(s, d), glyphs(s, d).withColumn("class", F.when(F.col("class") == "3", None).when(F.col("class") == "4", F.lit("_group._part.4")).otherwise(F.col("class")))).select("id", "class"), "SELECT id, class FROM glyphs UNION ALL SELECT id + (SELECT max(id) FROM glyphs) + 1, class FROM glyphs WHERE class NOT IN ('3', '4')", "glyphs")
add("cc_and_cluster", lambda s, d: workflow.cc_and_cluster(R.ink(chats(s, d), 120), keep).select("image_id", "label", "cluster"))
add("name_lookup_unicode", lambda s, d: table(s, d, "nation").select("n_nationkey", F.concat(F.lit("latin.small.letter."), F.lower(F.substring("n_name", 1, 1))).alias("name")).withColumn("char", workflow.name_lookup_unicode(F.col("name"))), "SELECT n_nationkey, 'latin.small.letter.' || lower(n_name[1]) AS name, lower(n_name[1]) AS char FROM nation")

# --- files -----------------------------------------------------------------------------------------


def image_files(s, d, form):
    from .files import folder

    f = folder(s)
    px = chats(s, d)
    codecs.encoded(px, "greyscale", form).select("image_id", "data").write.parquet(f)
    return s.read.parquet(f)


def file_info(s, d, form):
    """Headers of the written files."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [codecs.info(bytes(b)) for b in pdf["data"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "nrows": [int(x["nrows"]) for x in found], "ncols": [int(x["ncols"]) for x in found], "depth": [int(x["depth"]) for x in found]})

    return image_files(s, d, form).mapInPandas(run, "image_id long, nrows int, ncols int, depth int")


for form in ("png", "tiff"):
    add(f"{form}_info", lambda s, d, form=form: file_info(s, d, form), "SELECT image_id, nrows, ncols, 8 AS depth FROM size", "size")

# --- graphs ----------------------------------------------------------------------------------------

add("graph_make_acyclic", lambda s, d: H.make_acyclic(H.make_directed(edges(s, d))).select("src", "dst", "cost"), "SELECT src, dst, cost FROM edges WHERE src < dst UNION ALL SELECT dst, src, cost FROM edges WHERE dst < src", "edges")
add("graph_make_tree", lambda s, d: H.make_tree(edges(s, d), keep).agg(F.count("*").alias("n")), ", both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT a AS id, a AS root FROM both_ UNION SELECT b.b, r.root FROM reach r JOIN both_ b ON b.a = r.id), c AS (SELECT id, min(root) AS root FROM reach GROUP BY id) SELECT count(*) - count(DISTINCT root) AS n FROM c", "edges")
add("graph_make_blob", lambda s, d: H.make_blob(H.nodes_of(edges(s, d)), edges(s, d)), "SELECT src AS id FROM edges UNION SELECT dst FROM edges", "edges")
add("graph_counts", lambda s, d: H.counts(H.nodes_of(edges(s, d)), edges(s, d)), "SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nnodes, (SELECT count(*) FROM edges) AS nedges", "edges")
add("graph_restrictions", lambda s, d: s.createDataFrame([(kind, H.conforms_restrictions(H.nodes_of(edges(s, d)), edges(s, d), kind, keep)) for kind in H.KINDS], "kind string, conforms boolean"), "SELECT kind, kind IN ('free', 'dag', 'undirected') AS conforms FROM (SELECT unnest(['free', 'dag', 'tree', 'undirected', 'undirected_tree']) AS kind)")
add("graph_dfs", lambda s, d: H.depth_first(edges(s, d), edges(s, d).agg(F.min("src")).first()[0]).select("id"), ", walk AS (SELECT min(src) AS id FROM edges UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.id) SELECT id FROM walk", "edges")
add("graph_colorize_six", lambda s, d: H.colorize(H.nodes_of(grid(s, d)), grid(s, d), keep, 6).agg(F.count("*").alias("n"), (F.max("color") < 6).alias("six")), "SELECT count(*) AS n, true AS six FROM customer")


def grid(s, d):
    """A planar graph: customers in rows of 40, each linked to the next and to the one below."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("src"))
    last = c.agg(F.max("src")).first()[0]
    right = c.where(F.col("src") % 40 != 0).withColumn("dst", F.col("src") + 1)
    return right.unionByName(c.withColumn("dst", F.col("src") + 40)).where(F.col("dst") <= last).withColumns({"cost": F.lit(1.0), "label": F.lit("")})
