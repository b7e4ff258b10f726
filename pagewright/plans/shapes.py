"""Registered queries on features, runs, projections, contours and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as Q
from ..operators import geometry as G
from ..operators import kernels as K
from ..operators import segment as S
from ..sources import raster as R
from .base import add, add_pixels, chats2, docs, dots, keep, rects

KEY = ["image_id", "y", "x"]

add(
    "page_features",
    lambda s, d: Q.page_features(docs(s, d)).select("image_id", "nrows", "ncols", "black_area", "area", F.round("volume", 9).alias("volume"), F.round("aspect_ratio", 9).alias("aspect_ratio")),
    "SELECT image_id, max(y) + 1 AS nrows, max(x) + 1 AS ncols, sum(v)::BIGINT AS black_area, ((max(y) + 1) * (max(x) + 1))::BIGINT AS area, round(sum(v)::DOUBLE / ((max(y) + 1) * (max(x) + 1)), 9) AS volume, round((max(x) + 1)::DOUBLE / (max(y) + 1), 9) AS aspect_ratio FROM docs_ GROUP BY image_id",
    "docs_",
)
MOM = ("cx", "cy", "mu20", "mu02", "mu11", "mu30", "mu12", "mu21", "mu03")
add(
    "moments",
    lambda s, d: Q.moments(docs(s, d)).select("image_id", *[(F.round(c, 6) + 0.0).alias(c) for c in MOM]),
    """, m AS (SELECT image_id, max(y) + 1 AS nr, max(x) + 1 AS nc, greatest(sum(v), 1)::DOUBLE AS n, sum(v * x)::DOUBLE AS m10, sum(v * y)::DOUBLE AS m01, sum(v * x * x)::DOUBLE AS m20, sum(v * y * y)::DOUBLE AS m02, sum(v * x * y)::DOUBLE AS m11,
  sum(v * x::BIGINT * x * x)::DOUBLE AS m30, sum(v * x::BIGINT * y * y)::DOUBLE AS m12, sum(v * x::BIGINT * x * y)::DOUBLE AS m21, sum(v * y::BIGINT * y * y)::DOUBLE AS m03 FROM docs_ GROUP BY image_id),
c AS (SELECT *, m10 / n AS a, m01 / n AS b FROM m)
SELECT image_id, round(CASE WHEN nc > 1 THEN a / (nc - 1) ELSE 0.5 END, 6) + 0.0::DOUBLE AS cx, round(CASE WHEN nr > 1 THEN b / (nr - 1) ELSE 0.5 END, 6) + 0.0::DOUBLE AS cy,
  round((m20 - a * m10) / n ** 2, 6) + 0.0::DOUBLE AS mu20, round((m02 - b * m01) / n ** 2, 6) + 0.0::DOUBLE AS mu02, round((m11 - b * m10) / n ** 2, 6) + 0.0::DOUBLE AS mu11,
  round((m30 - 3 * a * m20 + 2 * a * a * m10) / n ** 2.5, 6) + 0.0::DOUBLE AS mu30, round((m12 - 2 * b * m11 - a * m02 + 2 * b * b * m10) / n ** 2.5, 6) + 0.0::DOUBLE AS mu12,
  round((m21 - 2 * a * m11 - b * m20 + 2 * a * a * m01) / n ** 2.5, 6) + 0.0::DOUBLE AS mu21, round((m03 - 3 * b * m02 + 2 * b * b * m01) / n ** 2.5, 6) + 0.0::DOUBLE AS mu03 FROM c""",
    "docs_",
)
add("projection_rows", lambda s, d: Q.projection_rows(docs(s, d)), "SELECT image_id, y, sum(v)::BIGINT AS n FROM docs_ GROUP BY image_id, y", "docs_")
add("projection_cols", lambda s, d: Q.projection_cols(docs(s, d)), "SELECT image_id, x, sum(v)::BIGINT AS n FROM docs_ GROUP BY image_id, x", "docs_")
add(
    "projections",
    lambda s, d: Q.projections(dots(s, d)),
    "SELECT image_id, 'row' AS axis, y AS at, sum(v)::BIGINT AS n FROM dots GROUP BY image_id, y UNION ALL SELECT image_id, 'col', x, sum(v)::BIGINT FROM dots GROUP BY image_id, x",
    "dots",
)
SKEW = 'SELECT image_id, angle, "at"::INT AS "at", count(*) AS n FROM (SELECT image_id, angle, nrows, ncols, floor({} + 0.5) AS "at" FROM dots JOIN size USING (image_id), (SELECT unnest([-2.0, 0.0, 1.5])::DOUBLE AS angle) WHERE v > 0) WHERE "at" > 0 AND "at" < {} GROUP BY image_id, angle, "at"'
add("projection_skewed_cols", lambda s, d: Q.projection_skewed_cols(dots(s, d), [-2.0, 0.0, 1.5]), SKEW.format("x * cos(radians(angle)) - y * sin(radians(angle))", "ncols"), "dots size")
add("projection_skewed_rows", lambda s, d: Q.projection_skewed_rows(dots(s, d), [-2.0, 0.0, 1.5]), SKEW.format("x * sin(radians(angle)) + y * cos(radians(angle))", "nrows"), "dots size")
add(
    "rotation_angle_projections",
    lambda s, d: Q.rotation_angle_projections(dots(s, d)),
    """, p AS (SELECT image_id, angle, "at", count(*) AS n FROM (SELECT image_id, angle, nrows, floor(x * sin(radians(angle)) + y * cos(radians(angle)) + 0.5) AS "at" FROM dots JOIN size USING (image_id), (SELECT unnest(range(11)) * 0.5::DOUBLE - 2.5::DOUBLE AS angle) WHERE v > 0) WHERE "at" > 0 AND "at" < nrows GROUP BY ALL),
q AS (SELECT image_id, angle, sum((n - before) ** 2) AS score FROM (SELECT *, CASE WHEN lag("at") OVER w = "at" - 1 THEN lag(n) OVER w ELSE 0 END AS before FROM p WINDOW w AS (PARTITION BY image_id, angle ORDER BY "at")) GROUP BY image_id, angle)
SELECT image_id, angle FROM q QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, abs(angle), angle DESC) = 1""",
    "dots size",
)
ISLANDS = ", r AS (SELECT image_id, {0} AS line, v > 0 AS black, {1} - row_number() OVER (PARTITION BY image_id, {0}, v > 0 ORDER BY {1}) AS g, {1} AS pos FROM {2}), runs AS (SELECT image_id, line, black, min(pos) AS start, max(pos) AS \"end\" FROM r GROUP BY image_id, line, black, g) "
H, V = ISLANDS.format("y", "x", "docs_"), ISLANDS.format("x", "y", "docs_")
DH, DV = ISLANDS.format("y", "x", "dots"), ISLANDS.format("x", "y", "dots")
add("iterate_runs", lambda s, d: Q.runs(docs(s, d)), H + 'SELECT image_id, line, black, start, "end" FROM runs', "docs_")
add("run_histogram", lambda s, d: Q.run_histogram(docs(s, d)), H + 'SELECT image_id, ("end" - start + 1)::INT AS length, count(*) AS n FROM runs WHERE black GROUP BY ALL', "docs_")
add("run_histogram_white_vertical", lambda s, d: Q.run_histogram(docs(s, d), "white", "vertical"), V + 'SELECT image_id, ("end" - start + 1)::INT AS length, count(*) AS n FROM runs JOIN dsize USING (image_id) WHERE NOT black AND "end" < nrows - 1 GROUP BY ALL', "docs_ dsize")
FREQ = DH + ', h AS (SELECT image_id, ("end" - start + 1)::INT AS length, count(*) AS n FROM runs WHERE black GROUP BY ALL) '
add("most_frequent_run", lambda s, d: Q.most_frequent_run(dots(s, d)), FREQ + "SELECT image_id, length FROM h QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, length) = 1", "dots")
add("most_frequent_runs", lambda s, d: Q.most_frequent_runs(dots(s, d), 3), FREQ + "SELECT image_id, length, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, length) AS rank FROM h QUALIFY rank <= 3", "dots")
GONE = ' , g AS (SELECT image_id, line, unnest(range(start, "end" + 1)) AS pos FROM runs WHERE black AND "end" - start + 1 {} {}) SELECT d.image_id, d.y, d.x, CASE WHEN g.pos IS NULL THEN d.v ELSE 0 END AS v FROM dots d LEFT JOIN g ON g.image_id = d.image_id AND g.line = d.{} AND g.pos = d.{}'
add_pixels("filter_narrow_runs", lambda s, d: Q.filter_runs(dots(s, d), 4, "long"), DH + GONE.format("<", 4, "y", "x"), "dots")
add_pixels("filter_wide_runs", lambda s, d: Q.filter_runs(dots(s, d), 4, "short"), DH + GONE.format(">", 4, "y", "x"), "dots")
add_pixels("filter_short_runs", lambda s, d: Q.filter_runs(dots(s, d), 4, "long", direction="vertical"), DV + GONE.format("<", 4, "x", "y"), "dots")
add_pixels("filter_tall_runs", lambda s, d: Q.filter_runs(dots(s, d), 4, "short", direction="vertical"), DV + GONE.format(">", 4, "x", "y"), "dots")
add(
    "to_rle",
    lambda s, d: Q.to_rle(dots(s, d)),
    """, r AS (SELECT image_id, v > 0 AS b, y * 32 + x AS k, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - row_number() OVER (PARTITION BY image_id, v > 0 ORDER BY y, x) AS g FROM dots),
u AS (SELECT image_id, b, min(k) AS k, count(*) AS n FROM r GROUP BY image_id, b, g)
SELECT image_id, (CASE WHEN arg_min(b, k) THEN '0 ' ELSE '' END) || string_agg(n::VARCHAR, ' ' ORDER BY k) || (CASE WHEN arg_max(b, k) THEN '' ELSE ' 0' END) AS rle FROM u GROUP BY image_id""",
    "dots",
)
add_pixels("rle_round_trip", lambda s, d: Q.from_rle(Q.to_rle(dots(s, d)).join(R.sizes(dots(s, d)), "image_id")), "SELECT image_id, y, x, v FROM dots JOIN size USING (image_id) WHERE ncols = 32 OR nrows = 1", "dots size")
add(
    "runlength_from_point",
    lambda s, d: Q.runlength_from_point(dots(s, d), 2, 0, "black", "right"),
    "SELECT image_id, coalesce(min(x - 2) FILTER (v = 0), max(x - 2) + 1)::INT AS n FROM dots WHERE y = 0 AND x >= 2 GROUP BY image_id",
    "dots",
)
for side, line, e in (("top", "x", "min(y) FILTER (v > 0)"), ("bottom", "x", "(nrows - max(y) FILTER (v > 0))"), ("left", "y", "min(x) FILTER (v > 0)"), ("right", "y", "(ncols - max(x) FILTER (v > 0))")):
    add(f"contour_{side}", lambda s, d, side=side: Q.contour(docs(s, d), side), f"SELECT image_id, {line} AS at, coalesce({e}::DOUBLE, 'inf'::DOUBLE) AS d FROM docs_ JOIN dsize USING (image_id) GROUP BY image_id, {line}, nrows, ncols", "docs_ dsize")
add(
    "top_bottom",
    lambda s, d: Q.top_bottom(docs(s, d)).select("image_id", F.round("top", 9).alias("top"), F.round("bottom", 9).alias("bottom")),
    "SELECT image_id, round(coalesce(min(y) FILTER (v > 0) / nrows::DOUBLE, 1.0), 9) AS top, round(CASE WHEN sum(v) = 0 THEN 0.0 ELSE coalesce(max(y) FILTER (v > 0 AND y > 0), -1) / nrows::DOUBLE END, 9) AS bottom FROM docs_ JOIN dsize USING (image_id) GROUP BY image_id, nrows",
    "docs_ dsize",
)
for k in (4, 8):
    add(
        f"volume{k * k}regions",
        lambda s, d, k=k: Q.region_volumes(docs(s, d), k).withColumn("volume", F.round("volume", 9)),
        f"SELECT image_id, (least(x * {k} // ncols, {k - 1}) * {k} + least(y * {k} // nrows, {k - 1}))::INT AS region, round(avg(v), 9) AS volume FROM docs_ JOIN dsize USING (image_id) GROUP BY ALL",
        "docs_ dsize",
    )
add(
    "compactness",
    lambda s, d: Q.compactness(dots(s, d)).withColumn("compactness", F.round("compactness", 9)),
    ", b AS (SELECT image_id, y, x FROM dots WHERE v > 0), g AS (SELECT image_id, count(*) AS grown FROM (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM b, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) GROUP BY image_id) SELECT image_id, round(CASE WHEN sum(v) = 0 THEN 1.7976931348623157e308 ELSE (max(grown) - sum(v))::DOUBLE / sum(v) END, 9) AS compactness FROM dots LEFT JOIN g USING (image_id) GROUP BY image_id",
    "dots",
)
add("nholes", lambda s, d: Q.nholes(dots(s, d)).select("image_id", F.round("vertical", 9).alias("vertical"), F.round("horizontal", 9).alias("horizontal")))
add("zernike_moments", lambda s, d: Q.zernike_moments(dots(s, d)).select("image_id", F.posexplode("z").alias("k", "z")).withColumn("z", F.round("z", 6)))
add("skeleton_features", lambda s, d: R.from_image(dots(s, d), K.skeleton_features, "x_joints double, t_joints double, bends double, ends double, x_crossings double, y_crossings double"))
add("diagonal_projection", lambda s, d: R.from_image(dots(s, d), K.diagonal_projection, "ratio double").withColumn("ratio", F.round("ratio", 6)))
add("fourier_broken", lambda s, d: R.from_image(dots(s, d), K.fourier_broken, "f array<double>").select("image_id", F.posexplode("f").alias("k", "f")).withColumn("f", F.round("f", 6)))
add("contour_pavlidis", lambda s, d: G.contour_points(dots(s, d)))
add("contour_samplepoints", lambda s, d: R.from_image(dots(s, d), lambda a: [(i, *p) for i, p in enumerate(K.contour_samplepoints(a))], "place int, y int, x int"))

# --- components ------------------------------------------------------------------------------------

add(
    "cc_analysis",
    lambda s, d: S.boxes(S.cc_analysis(R.ink(chats2(s, d), 200), keep)).drop("label"),
    """, b AS (SELECT image_id, y, x, y * 32 + x AS id FROM chats2 WHERE v > 200),
e AS (SELECT p.image_id, p.id AS a, q.id AS b FROM b p JOIN b q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1),
reach AS (SELECT image_id, id, id AS root FROM b UNION SELECT r.image_id, e.b, r.root FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.id WHERE e.b > r.root),
cc AS (SELECT b.*, (SELECT min(root) FROM reach r WHERE r.image_id = b.image_id AND r.id = b.id) AS root FROM b)
SELECT image_id, min(x) AS ulx, min(y) AS uly, max(x) AS lrx, max(y) AS lry, count(*) AS n FROM cc GROUP BY image_id, root""",
    "chats2",
)
add_pixels("despeckle", lambda s, d: S.despeckle(R.ink(chats2(s, d), 200), 3, keep))
for axis, name, c in (("x", "splitx", 0.5), ("y", "splity", 0.5), ("x", "splitx_left", 0.25), ("x", "splitx_right", 0.75), ("y", "splity_top", 0.25), ("y", "splity_bottom", 0.75)):
    add(name, lambda s, d, axis=axis, c=c: S.split(dots(s, d), axis, (c,)))
add("splitx_max", lambda s, d: S.split(dots(s, d), "x", (0.5,), True))
add("projection_cutting", lambda s, d: S.projection_cutting(R.ink(chats2(s, d), 200), 2, 1))
add_pixels(
    "runlength_smearing",
    lambda s, d: S.runlength_smearing(R.ink(chats2(s, d), 200), 6, 3, 2),
    """, o AS (SELECT image_id, y, x, (v > 200)::INT AS v FROM chats2),
h AS (SELECT image_id, y, x, (v > 0 OR min(CASE WHEN v > 0 THEN x END) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - max(CASE WHEN v > 0 THEN x END) OVER (PARTITION BY image_id, y ORDER BY x) - 1 <= 6) AS v FROM o),
w AS (SELECT image_id, y, x, (v > 0 OR min(CASE WHEN v > 0 THEN y END) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - max(CASE WHEN v > 0 THEN y END) OVER (PARTITION BY image_id, x ORDER BY y) - 1 <= 3) AS v FROM o),
b AS (SELECT image_id, y, x, (coalesce(h.v, false) AND coalesce(w.v, false))::INT AS v FROM h JOIN w USING (image_id, y, x))
SELECT image_id, y, x, coalesce(v > 0 OR min(CASE WHEN v > 0 THEN x END) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - max(CASE WHEN v > 0 THEN x END) OVER (PARTITION BY image_id, y ORDER BY x) - 1 <= 2, false)::INT AS v FROM b""",
    "chats2",
)
add(
    "labeled_region_neighbors",
    lambda s, d: S.labeled_region_neighbors(chats2(s, d)),
    "SELECT DISTINCT image_id, least(p.v, q.v) AS a, greatest(p.v, q.v) AS b FROM chats2 p JOIN chats2 q USING (image_id) WHERE ((q.y = p.y AND q.x = p.x + 1) OR (q.y = p.y + 1 AND q.x IN (p.x, p.x + 1))) AND p.v <> q.v AND p.v > 0 AND q.v > 0",
    "chats2",
)
add("sub_cc_analysis", lambda s, d: S.sub_cc_analysis(chats2(s, d).withColumn("v", F.when(F.col("v") > 200, 1 + F.col("v") % 2).otherwise(0)), keep).drop("label"))
add("segmentation_error", lambda s, d: S.segmentation_error(S.cc_analysis(R.ink(chats2(s, d), 200), keep), S.cc_analysis(R.ink(chats2(s, d), 190), keep), keep))

# --- rectangles ------------------------------------------------------------------------------------

PAIR = "FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.id < b.id AND a.ulx <= b.lrx AND b.ulx <= a.lrx AND a.uly <= b.lry AND b.uly <= a.lry"


def pairs(s, d):
    r = rects(s, d)
    return S.rect_join(r, r, (F.col("a_id") < F.col("b_id")) & S.intersects())


add("rect_intersects_join", lambda s, d: pairs(s, d).select("image_id", "a_id", "b_id"), f"SELECT a.image_id, a.id AS a_id, b.id AS b_id {PAIR}", "rects")
add("rect_intersection", lambda s, d: pairs(s, d).select("image_id", "a_id", "b_id", *S.intersection()), f"SELECT a.image_id, a.id AS a_id, b.id AS b_id, greatest(a.ulx, b.ulx) AS ulx, greatest(a.uly, b.uly) AS uly, least(a.lrx, b.lrx) AS lrx, least(a.lry, b.lry) AS lry {PAIR}", "rects")
add(
    "rect_contains_join",
    lambda s, d: S.rect_join(rects(s, d), rects(s, d), (F.col("a_id") != F.col("b_id")) & S.contains()).select("image_id", "a_id", "b_id"),
    "SELECT a.image_id, a.id AS a_id, b.id AS b_id FROM rects a JOIN rects b ON a.image_id = b.image_id AND a.id <> b.id AND a.ulx <= b.ulx AND b.lrx <= a.lrx AND a.uly <= b.uly AND b.lry <= a.lry",
    "rects",
)
add("rect_expand", lambda s, d: S.expanded(rects(s, d), 5), "SELECT image_id, id, greatest(ulx - 5, 0) AS ulx, greatest(uly - 5, 0) AS uly, lrx + 6 AS lrx, lry + 6 AS lry FROM rects", "rects")
add("rect_union", lambda s, d: S.union_rects(rects(s, d), "image_id"), "SELECT image_id, min(ulx) AS ulx, min(uly) AS uly, max(lrx) AS lrx, max(lry) AS lry FROM rects GROUP BY image_id", "rects")
add("rect_move", lambda s, d: rects(s, d).withColumns({"ulx": F.col("ulx") + 3, "lrx": F.col("lrx") + 3, "uly": F.col("uly") + 4, "lry": F.col("lry") + 4}), "SELECT image_id, id, ulx + 3 AS ulx, uly + 4 AS uly, lrx + 3 AS lrx, lry + 4 AS lry FROM rects", "rects")
GAP = "least(abs(a.ul{0} - b.ul{0}), abs(a.ul{0} - b.lr{0}), abs(a.lr{0} - b.ul{0}), abs(a.lr{0} - b.lr{0}))"
add(
    "rect_distances",
    lambda s, d: pairs(s, d).select("image_id", "a_id", "b_id", F.round(S.distance_euclid(), 6).alias("euclid"), S.distance_cx().cast("int").alias("cx"), S.distance_cy().cast("int").alias("cy"), F.round(S.distance_bb(), 6).alias("bb")),
    f"""SELECT a.image_id, a.id AS a_id, b.id AS b_id, round(sqrt(((a.ulx + a.lrx) // 2 - (b.ulx + b.lrx) // 2) ** 2 + ((a.uly + a.lry) // 2 - (b.uly + b.lry) // 2) ** 2), 6) AS euclid,
  abs((a.ulx + a.lrx) // 2 - (b.ulx + b.lrx) // 2)::INT AS cx, abs((a.uly + a.lry) // 2 - (b.uly + b.lry) // 2)::INT AS cy, round(sqrt({GAP.format("x")} ** 2 + {GAP.format("y")} ** 2), 6) AS bb {PAIR}""",
    "rects",
)
add(
    "polar_distance",
    lambda s, d: pairs(s, d).select("image_id", "a_id", "b_id", *[F.round(c, 6).alias(n) for c, n in zip(G.polar_distance(), ("share", "angle", "r"), strict=True)]),
    f"""SELECT image_id, a_id, b_id, round(sqrt(x * x + y * y) / ((d1 + d2) / 2), 6) AS share, round((CASE WHEN x = 0 THEN pi() / 2 ELSE atan(y / x) END) + (CASE WHEN y > 0 THEN pi() ELSE 0 END), 6) AS angle, round(sqrt(x * x + y * y), 6) AS r
FROM (SELECT a.image_id, a.id AS a_id, b.id AS b_id, (b.ulx + b.lrx) / 2.0::DOUBLE - (a.ulx + a.lrx) / 2.0::DOUBLE AS x, (b.uly + b.lry) / 2.0::DOUBLE - (a.uly + a.lry) / 2.0::DOUBLE AS y, sqrt((a.lrx - a.ulx + 1) ** 2 + (a.lry - a.uly + 1) ** 2) AS d1, sqrt((b.lrx - b.ulx + 1) ** 2 + (b.lry - b.uly + 1) ** 2) AS d2 {PAIR})""",
    "rects",
)
add("bbox_merging", lambda s, d: S.bbox_merging(rects(s, d), 2, 2, keep, 1))
add("kise_block_extraction", lambda s, d: S.kise_block_extraction(rects(s, d), keep))
add("textline_reading_order", lambda s, d: S.textline_reading_order(S.union_rects(rects(s, d).withColumn("line", F.floor(F.col("uly") / 100)), "image_id", "line").withColumn("id", F.col("line"))))

# --- points ----------------------------------------------------------------------------------------


def points(s, d):
    """Corners of the rectangles as points."""
    return rects(s, d).select("image_id", F.col("id").alias("label"), F.col("ulx").alias("x"), F.col("uly").alias("y"))


add("convex_hull_from_points", lambda s, d: G.convex_hulls(points(s, d)))
add("convex_hull_as_points", lambda s, d: R.from_image(dots(s, d), lambda a: [(i, float(x), float(y)) for i, (x, y) in enumerate(K.hull_of_image(a))], "place int, x double, y double"))
add("convex_hull_as_image", lambda s, d: G.convex_hull_as_image(R.ink(chats2(s, d), 240), True))
add("max_empty_rect", lambda s, d: G.max_empty_rect(R.ink(chats2(s, d), 200)))
add(
    "least_squares_fit",
    lambda s, d: G.least_squares_fit(points(s, d)).select("image_id", F.round("b", 6).alias("b"), F.round("a", 4).alias("a")),
    "SELECT image_id, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE regr_slope(uly, ulx) END, 6) AS b, round(CASE WHEN count(*) = 1 THEN max(ulx) ELSE regr_intercept(uly, ulx) END, 4) AS a FROM rects GROUP BY image_id",
    "rects",
)
add("least_squares_fit_xy", lambda s, d: G.least_squares_fit_xy(points(s, d)).select("image_id", F.round("b", 6).alias("b"), F.round("a", 4).alias("a"), "x_of_y"), "SELECT image_id, round(CASE WHEN t THEN regr_slope(ulx, uly) ELSE regr_slope(uly, ulx) END, 6) AS b, round(CASE WHEN t THEN regr_intercept(ulx, uly) ELSE regr_intercept(uly, ulx) END, 4) AS a, t::INT AS x_of_y FROM rects JOIN (SELECT image_id, max(uly) - min(uly) >= max(ulx) - min(ulx) AS t FROM rects GROUP BY image_id) USING (image_id) GROUP BY image_id, t", "rects")
add("hough_lines", lambda s, d: G.hough_lines(R.ink(chats2(s, d), 200).where("v > 0"), 0.0, 15.0, 12))
add("delaunay_from_points", lambda s, d: G.delaunay_pairs(S.union_rects(rects(s, d).withColumn("c", F.floor(F.col("ulx") / 250) * 4 + F.floor(F.col("uly") / 250)), "image_id", "c").select("image_id", F.col("c").cast("long").alias("label"), F.col("ulx").cast("double").alias("x"), F.col("uly").cast("double").alias("y"))))
add_pixels("voronoi_from_labeled_image", lambda s, d: R.by_image(chats2(s, d).withColumn("v", F.when(F.col("v") > 240, F.col("v") % 7 + 1).otherwise(0)), K.voronoi_from_labeled_image))
add_pixels(
    "voronoi_from_points",
    lambda s, d: G.voronoi_from_points(R.ink(chats2(s, d), 200), R.sizes(chats2(s, d)).select("image_id", F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.lit(y).alias("y"), F.lit(x).alias("x")) for i, (y, x) in enumerate(((1, 2), (3, 20), (6, 9)), 2)])).alias("p")).select("image_id", "p.*")),
    """, o AS (SELECT image_id, y, x, (v > 200)::INT AS v FROM chats2), p AS (SELECT * FROM (VALUES (2, 1, 2), (3, 3, 20), (4, 6, 9)) t(label, py, px))
SELECT image_id, y, x, CASE WHEN v > 0 THEN v ELSE arg_min(label, ((x - px) ** 2 + (y - py) ** 2) * 10 + label) END::INT AS v FROM o, p GROUP BY image_id, y, x, v""",
    "chats2",
)
T = [[1, 0, 1], [0, 1, 0]]
CELLS = "(VALUES (0, 0, 1), (0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 1, 1), (1, 2, 0)) t(ty, tx, t)"
add(
    "corelation_weighted",
    lambda s, d: G.corelation_weighted(dots(s, d), T, 0, 2, 1.0, -1.0, -0.5, 0.25).withColumn("score", F.round("score", 9)),
    f"SELECT image_id, round(sum(CASE WHEN t = 1 THEN CASE WHEN v > 0 THEN 1.0 ELSE -1.0 END ELSE CASE WHEN v > 0 THEN -0.5 ELSE 0.25 END END)::DOUBLE / 3, 9) AS score FROM dots JOIN {CELLS} ON y = ty AND x = tx + 2 GROUP BY image_id",
    "dots",
)
add("corelation_sum", lambda s, d: G.corelation_sum(dots(s, d), T, 0, 2).withColumn("score", F.round("score", 9)), f"SELECT image_id, round(sum(abs(v - t))::DOUBLE / 3, 9) AS score FROM dots JOIN {CELLS} ON y = ty AND x = tx GROUP BY image_id", "dots")
add("corelation_sum_squares", lambda s, d: G.corelation_sum(dots(s, d), T, 0, 2, True).withColumn("score", F.round("score", 9)), f"SELECT image_id, round(sum((v - t) ** 2)::DOUBLE / 3, 9) AS score FROM dots JOIN {CELLS} ON y = ty AND x = tx + 2 GROUP BY image_id", "dots")
add("shaped_grouping", lambda s, d: G.shaped_grouping(S.cc_analysis(R.ink(chats2(s, d), 225), keep), 3.0).select("image_id", "a", "b"))
add("graph_color_ccs", lambda s, d: S.graph_color_ccs(S.cc_analysis(R.ink(chats2(s, d), 225), keep), keep, 12))
add(
    "section_stats",
    lambda s, d: S.section_stats(rects(s, d).withColumn("section", F.col("id") % 3)).select("image_id", "section", "n", *[F.round(c, 6).alias(c) for c in ("width", "width_sd", "height", "height_sd")]),
    "SELECT image_id, id % 3 AS section, count(*) AS n, round(avg(lrx - ulx + 1), 6) AS width, round(stddev_samp(lrx - ulx + 1), 6) AS width_sd, round(avg(lry - uly + 1), 6) AS height, round(stddev_samp(lry - uly + 1), 6) AS height_sd FROM rects GROUP BY ALL",
    "rects",
)
