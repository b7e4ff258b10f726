"""Registered queries on nearest neighbours, workflow, graphs and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists as L
from ..operators import genetic, knn, workflow
from ..operators import geometry as G
from ..operators import graph as H
from .base import add, edges, glyphs, keep, rects, table

CITY = "list_sum([abs(a.f[i] - b.f[i]) FOR i IN range(1, len(a.f) + 1)])"
PAIRS = f", p AS (SELECT a.id AS q, b.id AS t, a.class AS truth, b.class, {CITY} AS d FROM glyphs a JOIN glyphs b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rank FROM p) "
VOTE = ", v AS (SELECT q, class, count(*) AS n, sum(d) AS total FROM n WHERE rank <= 3 GROUP BY q, class), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, round(total, 9), class) = 1) "
add("knn_nearest", lambda s, d: knn.nearest(glyphs(s, d), glyphs(s, d), 3, skip_self=True).withColumn("d", F.round("d", 6)), PAIRS + "SELECT q, t, class, round(d, 6) AS d, rank FROM n WHERE rank <= 3", "glyphs")
add("knn_classify", lambda s, d: knn.classify(glyphs(s, d), glyphs(s, d), 3, skip_self=True).withColumn("total", F.round("total", 5)), PAIRS + VOTE + "SELECT q, class, n, round(total, 5) AS total FROM w", "glyphs")
add("knn_leave_one_out", lambda s, d: knn.accuracy(glyphs(s, d), 3), PAIRS + VOTE + "SELECT sum((w.class = g.class)::INT)::BIGINT AS correct, count(*) AS total FROM w JOIN glyphs g ON g.id = w.q", "glyphs")
add("confusion_matrix", lambda s, d: knn.confusion_matrix(glyphs(s, d), 3).withColumn("percent", F.col("percent").cast("long")), PAIRS + VOTE + "SELECT g.class AS truth, w.class, count(*) AS n, floor(100 * count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g.class))::BIGINT AS percent FROM w JOIN glyphs g ON g.id = w.q GROUP BY g.class, w.class", "glyphs")
add("knn_confidences", lambda s, d: knn.confidences(near := knn.nearest(glyphs(s, d), glyphs(s, d), 3, skip_self=True), knn.majority(near), 3).select("q", "class", *[F.round(c, 6).alias(c) for c in knn.CONFIDENCES]))
add("knndistance_statistics", lambda s, d: knn.knndistance_statistics(glyphs(s, d), 3).withColumn("avg_d", F.round("avg_d", 6)), PAIRS + "SELECT q AS t, round(avg(d), 6) AS avg_d FROM n WHERE rank <= 3 GROUP BY q", "glyphs")
for kind, e in (("fast_euclidean", "list_sum([(a.f[i] - b.f[i]) ** 2 FOR i IN range(1, len(a.f) + 1)])"), ("l2", "sqrt(list_sum([(a.f[i] - b.f[i]) ** 2 FOR i IN range(1, len(a.f) + 1)]))"), ("euclidean", CITY)):
    add(f"unique_distances_{kind}", lambda s, d, kind=kind: knn.unique_distances(glyphs(s, d), kind).withColumn("d", F.round("d", 6)), f"SELECT a.id AS i, b.id AS j, round({e}, 6) AS d FROM glyphs a JOIN glyphs b ON a.id < b.id", "glyphs")
add("distance_matrix", lambda s, d: knn.distance_matrix(glyphs(s, d)).withColumn("d", F.round("d", 6)), f"SELECT a.id AS i, b.id AS j, round({CITY}, 6) AS d FROM glyphs a, glyphs b", "glyphs")
add("distance_from_images", lambda s, d: knn.distances_from(glyphs(s, d).where("id % 50 = 0"), glyphs(s, d), 8.0).withColumn("d", F.round("d", 6)), f"SELECT a.id AS q, b.id AS t, round({CITY}, 6) AS d FROM glyphs a, glyphs b WHERE a.id % 50 = 0 AND {CITY} < 8.0", "glyphs")
add("normalization", lambda s, d: knn.normalization(glyphs(s, d)).select(F.posexplode(F.arrays_zip("means", "sds")).alias("k", "z")).select("k", F.round("z.means", 6).alias("m"), F.round("z.sds", 6).alias("sd")), "SELECT (k - 1)::INT AS k, round(avg(f[k]), 6) AS m, round(greatest(coalesce(stddev_samp(f[k]), 0), 1e-5), 6) AS sd FROM glyphs, (SELECT unnest(range(1, 65)) AS k) GROUP BY k", "glyphs")
add("normalize", lambda s, d: knn.normalize(glyphs(s, d), knn.normalization(glyphs(s, d))).select("id", F.posexplode("features").alias("k", "x")).withColumn("x", F.round("x", 6)), ", s AS (SELECT k, avg(f[k]) AS m, greatest(coalesce(stddev_samp(f[k]), 0), 1e-5) AS sd FROM glyphs, (SELECT unnest(range(1, 65)) AS k) GROUP BY k) SELECT id, (k - 1)::INT AS k, round((f[k] - m) / sd, 6) AS x FROM glyphs, s", "glyphs")
add("glyphs_by_category", lambda s, d: knn.glyphs_by_category(glyphs(s, d)).select("class", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "n"), "SELECT class, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS n FROM glyphs GROUP BY class", "glyphs")
add("class_name_histogram", lambda s, d: knn.class_name_histogram(glyphs(s, d)), "SELECT class, count(*) AS n FROM glyphs GROUP BY class", "glyphs")
add("strip_small_categories", lambda s, d: knn.strip_small_categories(glyphs(s, d), 45).select("id", "class"), "SELECT id, class FROM glyphs QUALIFY count(*) OVER (PARTITION BY class) > 45", "glyphs")
add("get_glyphs_stats", lambda s, d: knn.get_glyphs_stats(glyphs(s, d), keep=keep).select("class", "n", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "median")]), f", p AS (SELECT a.class, {CITY} AS d FROM glyphs a JOIN glyphs b ON a.id < b.id AND a.class = b.class) SELECT g.class, g.n, round(coalesce(avg(d), 1), 6) AS mean, round(CASE WHEN count(d) = 0 THEN 1 ELSE coalesce(stddev_samp(d), 0) END, 6) AS stdev, round(coalesce(quantile_cont(d, 0.5), 1), 6) AS median FROM (SELECT class, count(*) AS n FROM glyphs GROUP BY class) g LEFT JOIN p USING (class) GROUP BY g.class, g.n", "glyphs")
add("edit_mnn", lambda s, d: knn.edit_mnn(glyphs(s, d), 3).select("id", "class"), PAIRS + VOTE + "SELECT g.id, g.class FROM w JOIN glyphs g ON g.id = w.q WHERE w.class = g.class", "glyphs")
add("edit_cnn", lambda s, d: knn.edit_cnn(glyphs(s, d), 1, keep=keep).select("id", "class"))
add("edit_mnn_cnn", lambda s, d: knn.edit_mnn_cnn(glyphs(s, d), 3, keep=keep).select("id", "class"))
add("simple_feature_selector", lambda s, d: knn.simple_feature_selector(glyphs(s, d), [1], 64), ", v AS (SELECT id, class, k, f[k] AS x FROM glyphs, (SELECT unnest(range(1, 65)) AS k)), p AS (SELECT a.k, a.id, a.class AS truth, arg_min(b.class, (abs(a.x - b.x), b.id)) AS class FROM v a JOIN v b ON a.k = b.k AND a.id <> b.id GROUP BY a.k, a.id, a.class) SELECT repeat('0', (k - 1)::INT) || '1' || repeat('0', (64 - k)::INT) AS mask, sum((class = truth)::INT)::BIGINT AS correct, count(*) AS total FROM p GROUP BY k", "glyphs")
add("classify_list_automatic", lambda s, d: workflow.classify_list_automatic(glyphs(s, d).withColumn("state", F.lit("UNCLASSIFIED")).withColumn("ids", F.array().cast("array<struct<confidence:double,name:string>>")), glyphs(s, d)).select("id", "state", F.col("ids")[0]["name"].alias("name")))
add("genetic_feature_selection", lambda s, d: s.createDataFrame([(float(x), i) for i, x in enumerate(genetic.Optimization(glyphs(s, d), genetic.Settings(population=12, max_generations=5)).run())], "w double, k int"))
add("cluster", lambda s, d: workflow.cluster(glyphs(s, d), keep, 0.6))
add("get_graph_stats", lambda s, d: workflow.get_graph_stats(glyphs(s, d), keep).withColumn("mean", F.round("mean", 6)))
add("max_distance", lambda s, d: workflow.max_distance(glyphs(s, d)).withColumn("d", F.round("d", 6)), f"SELECT round(max({CITY}), 6) AS d FROM glyphs a JOIN glyphs b ON a.id < b.id", "glyphs")


def named(s, d):
    return rects(s, d).withColumn("name", F.when(F.col("id") % 3 == 0, "note.head").when(F.col("id") % 3 == 1, "note.stem").otherwise("rest"))


def rules(s, d):
    e = workflow.RuleEngine()
    e.add_rule("stem_right_of_head", "note.head", "note.s*", lambda: (F.col("b_ulx") >= F.col("a_lrx")) & (F.col("b_ulx") <= F.col("a_lrx") + 4) & (F.abs(F.col("a_uly") - F.col("b_uly")) <= 20))
    return e.perform_rules(named(s, d))


add(
    "rule_engine",
    rules,
    "SELECT 'stem_right_of_head' AS rule, a.image_id, a.id AS a_id, b.id AS b_id FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.id % 3 = 0 AND b.id % 3 = 1 AND b.ulx >= a.lrx AND b.ulx <= a.lrx + 4 AND abs(a.uly - b.uly) <= 20 AND abs((a.ulx + a.lrx) // 2 // 100 - (b.ulx + b.lrx) // 2 // 100) <= 1 AND abs((a.uly + a.lry) // 2 // 100 - (b.uly + b.lry) // 2 // 100) <= 1",
    "rects",
)
add("pregroup", lambda s, d: workflow.pregroup(rects(s, d), 2, keep))
add("average_bb_distance", lambda s, d: workflow.average_bb_distance(rects(s, d), 20).withColumn("d", F.round("d", 6)))
add("page_sections_and_lines", lambda s, d: workflow.find_lines(rects(s, d).withColumn("section", F.lit(1))).select("image_id", "id", "line"), ", a AS (SELECT *, max(lry) OVER (PARTITION BY image_id ORDER BY uly, ulx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM rects) SELECT image_id, id, (sum((uly > coalesce(above, uly - 1))::INT) OVER (PARTITION BY image_id ORDER BY uly, ulx, id))::BIGINT AS line FROM a", "rects")
add("find_sections", lambda s, d: workflow.find_sections(rects(s, d), keep))
add("make_string", lambda s, d: workflow.make_string(workflow.find_lines(rects(s, d).withColumn("section", F.lit(1)).withColumn("char", F.chr(F.lit(97) + F.col("id") % 26)))).withColumn("text", F.md5("text")))

# --- graphs ----------------------------------------------------------------------------------------

add("graph_directed_edges", lambda s, d: H.make_directed(edges(s, d)).select("src", "dst", "cost"), "SELECT src, dst, cost FROM edges UNION ALL SELECT dst, src, cost FROM edges", "edges")
add("graph_degrees", lambda s, d: H.degrees(edges(s, d)), "SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id", "edges")
add("graph_remove_node", lambda s, d: H.remove_node(edges(s, d), 10).select("src", "dst", F.round("cost", 2).alias("cost")), "SELECT src, dst, cost FROM edges WHERE src <> 10 AND dst <> 10 UNION ALL SELECT a.src, b.dst, round(a.cost + b.cost, 2) FROM edges a JOIN edges b ON a.dst = 10 AND b.src = 10", "edges")
add("graph_remove_node_and_edges", lambda s, d: H.remove_node_and_edges(edges(s, d), 10).select("src", "dst", "cost"), "SELECT src, dst, cost FROM edges WHERE src <> 10 AND dst <> 10", "edges")
add("graph_singly_connected", lambda s, d: H.make_singly_connected(edges(s, d).unionByName(edges(s, d).withColumn("cost", F.col("cost") + 1)), 4000.0).select("src", "dst", "cost"), "SELECT src, dst, cost FROM edges WHERE cost <= 4000", "edges")
REACH = ", both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT a AS id, a AS root FROM both_ UNION SELECT b.b, r.root FROM reach r JOIN both_ b ON b.a = r.id) "
add("graph_components", lambda s, d: H.subgraph_roots(H.nodes_of(edges(s, d)), edges(s, d), keep), REACH + "SELECT id, min(root) AS root FROM reach GROUP BY id", "edges")
add("graph_sizes", lambda s, d: H.subgraph_roots(H.nodes_of(edges(s, d)), edges(s, d), keep).groupBy("root").agg(F.count("*").alias("n")), REACH + ", c AS (SELECT id, min(root) AS root FROM reach GROUP BY id) SELECT root, count(*) AS n FROM c GROUP BY root", "edges")
BFS = ", starts AS (SELECT min(src) AS start FROM edges), arcs AS (SELECT src, dst FROM edges), walk AS (SELECT start, start AS id, 0 AS depth FROM starts UNION SELECT w.start, a.dst, w.depth + 1 FROM walk w JOIN arcs a ON a.src = w.id WHERE w.depth < 60) SELECT start, id, min(depth)::INT AS depth FROM walk GROUP BY start, id"
add("graph_bfs", lambda s, d: H.breadth_first(edges(s, d), edges(s, d).agg(F.min("src").alias("id")), keep), BFS, "edges")
add("graph_shortest_path", lambda s, d: H.shortest_paths(edges(s, d), edges(s, d).agg(F.min("src").alias("id")), keep).select("start", "id", F.round("cost", 2).alias("cost")))
add("graph_all_pairs_shortest_path", lambda s, d: H.all_pairs_shortest_paths(edges(s, d), keep).select("start", "id", F.round("cost", 2).alias("cost")))
add("graph_spanning_tree", lambda s, d: H.spanning_tree(edges(s, d), edges(s, d).agg(F.min("src")).first()[0], keep))
add("graph_minimum_spanning_tree", lambda s, d: H.minimum_spanning_tree(edges(s, d), keep))
add("graph_colorize", lambda s, d: H.colorize(H.nodes_of(edges(s, d)), edges(s, d), keep, 12))
add("graphviz_output", lambda s, d: H.graphviz(edges(s, d)))
add(
    "kdtree_k_nearest_neighbors",
    lambda s, d: G.k_nearest_points(
        table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") % 97).cast("double"), F.floor("s_acctbal").cast("double")).alias("p")),
        table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_custkey") % 97).cast("double"), F.floor("c_acctbal").cast("double")).alias("p")),
        3,
    ),
    "SELECT q, t, d, rank FROM (SELECT s.s_suppkey AS q, c.c_custkey AS t, ((s.s_suppkey % 97 - c.c_custkey % 97) ** 2 + (floor(s.s_acctbal) - floor(c.c_acctbal)) ** 2)::DOUBLE AS d, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY (s.s_suppkey % 97 - c.c_custkey % 97) ** 2 + (floor(s.s_acctbal) - floor(c.c_acctbal)) ** 2, c.c_custkey) AS rank FROM supplier s, customer c) WHERE rank <= 3",
)

# --- strings and lists -----------------------------------------------------------------------------

add("edit_distance", lambda s, d: table(s, d, "part").select("p_partkey", G.edit_distance("p_name", "p_type").alias("d")), "SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d FROM part")
add("match_id_name", lambda s, d: table(s, d, "part").select("p_partkey", F.regexp_replace("p_type", " ", ".").alias("name")).select("p_partkey", L.match_id_name("name", "S*.(*N*|P*)").alias("hit")), "SELECT p_partkey, regexp_matches(replace(p_type, ' ', '.'), '^(?:S[^.]*\\.([^.]*N[^.]*|P[^.]*))') AS hit FROM part")
add("string2identifier", lambda s, d: table(s, d, "part").select("p_partkey", L.string2identifier("p_brand").alias("name")), "SELECT p_partkey, CASE WHEN n SIMILAR TO '[0-9].*' THEN '_' || n ELSE n END AS name FROM (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9_]', '_', 'g') AS n FROM part)")
add("replace_prefix", lambda s, d: table(s, d, "customer").select("c_custkey", L.replace_prefix("c_name", "Customer", "Client").alias("name")), "SELECT c_custkey, regexp_replace(c_name, '^Customer', 'Client') AS name FROM customer")
add("list_medians", lambda s, d: glyphs(s, d).select("id", F.round(L.median("features"), 9).alias("median"), F.round(L.median("features", True), 9).alias("upper"), L.argmax("features").alias("argmax"), L.argmin("features").alias("argmin")), "SELECT id, round((list_sort(f)[32] + list_sort(f)[33]) / 2, 9) AS median, round(list_sort(f)[33], 9) AS upper, (list_position(f, list_max(f)) - 1)::INT AS argmax, (list_position(f, list_min(f)) - 1)::INT AS argmin FROM glyphs", "glyphs")
add("all_subsets", lambda s, d: s.range(1).select(F.array(*[F.lit(x) for x in (5, 3, 8, 1)]).alias("a")).select(F.explode(L.all_subsets("a", 2)).alias("b")).select(F.col("b")[0].alias("p"), F.col("b")[1].alias("q")), "SELECT p, q FROM (VALUES (5, 3), (5, 8), (5, 1), (3, 8), (3, 1), (8, 1)) t(p, q)")
add("kernel_density", lambda s, d: L.kernel_density(table(s, d, "supplier"), "s_acctbal", [0.0, 2500.0, 5000.0], 800.0).withColumn("density", F.round("density", 12)), "SELECT x AS at, round(sum(exp(-0.5 * power((x - s_acctbal) / 800, 2)) / sqrt(2 * pi())) / (count(*) * 800), 12) AS density FROM supplier, (SELECT unnest([0.0, 2500.0, 5000.0])::DOUBLE AS x) GROUP BY x".replace(" AS at", ' AS "at"'))
add("group_list", lambda s, d: glyphs(s, d).select("id", F.posexplode(L.group_list("features", 10)).alias("k", "part")).select("id", "k", F.size("part").alias("n")), "SELECT id, k::INT AS k, (CASE WHEN k = 6 THEN 4 ELSE 10 END)::INT AS n FROM glyphs, (SELECT unnest(range(7)) AS k)", "glyphs")
add("rangeeq", lambda s, d: rects(s, d).select("id", L.rangeeq(F.col("ulx"), F.col("uly"), 10.0, 360.0).alias("near")), "SELECT id, least(abs(ulx - uly) % 360, 360 - abs(ulx - uly) % 360) <= 10 AS near FROM rects", "rects")
add("byte_size", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.byte_size("l_partkey").alias("size")))


def knn_round_trip(s, d):
    from .files import folder

    f = folder(s)
    knn.serialize(glyphs(s, d), f, {"k": 3, "distance": "city_block"})
    train, settings = knn.unserialize(s, f)
    return train.select("id", "class", F.lit(settings["k"]).cast("int").alias("k"))


add("knn_serialize_round_trip", knn_round_trip, "SELECT id, class, 3 AS k FROM glyphs", "glyphs")
