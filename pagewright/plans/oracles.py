"""DuckDB equivalents of registered queries whose SQL is built from kernels, or longer than their plan."""

from __future__ import annotations

from ..operators import neighborhood as N
from .base import SQL, add_pixel_sql, with_clause
from .filters import CONV, GP, LOCAL, OTSU, m, near_sql, taps
from .learning import PAIRS, VOTE

# --- convolutions ----------------------------------------------------------------------------------

EXACT = CONV.replace("round(sum(p.w * coalesce(q.v, 0)), 6)", "sum(p.w * coalesce(q.v, 0))")


def two_passes(name: str, kx: list[float], ky: list[float]) -> str:
    """CTEs <name>x and <name>: rows, then columns, borders reflected."""
    rows = EXACT.format(rel="chats", taps=taps(kx, "x"), sy="a.y", sx=m("a.x - dx", "ncols"))
    cols = EXACT.format(rel=f"{name}x", taps=taps(ky, "y"), sy=m("a.y - dy", "nrows"), sx="a.x")
    return f", {name}x AS ({rows}), {name} AS ({cols})"


def rounded(value: str, of: str) -> str:
    return f" SELECT image_id, y, x, round({value}, 6) AS v FROM {of}"


AVERAGE = N.averaging_kernel(1)
add_pixel_sql("convolve_xy", two_passes("a_", AVERAGE, AVERAGE) + rounded("v", "a_"), "chats size")
G0, G1, G2 = (N.gaussian_kernel(0.5, k) for k in range(3))
add_pixel_sql("laplacian_of_gaussian", two_passes("a_", G2, G0) + two_passes("b_", G0, G2) + rounded("a_.v + b_.v", "a_ JOIN b_ USING (image_id, y, x)"), "chats size")
add_pixel_sql("hessian_matrix_of_gaussian", two_passes("a_", G1, G1) + rounded("v", "a_"), "chats size")
add_pixel_sql("gaussian_gradient", two_passes("a_", G1, G0) + two_passes("b_", G0, G1) + " SELECT image_id, y, x, round(a_.v, 6) AS v, round(b_.v, 6) AS w FROM a_ JOIN b_ USING (image_id, y, x)", "chats size", ("v", "w"))
SMOOTH, STEP = [0.25, 0.5, 0.25], N.symmetric_gradient_kernel()
add_pixel_sql("sobel_edge_detection", two_passes("a_", STEP, SMOOTH) + two_passes("b_", SMOOTH, STEP) + rounded("sqrt(a_.v * a_.v + b_.v * b_.v)", "a_ JOIN b_ USING (image_id, y, x)"), "chats size")
GRID = "(VALUES " + ", ".join(f"({i - 1}, {j - 1}, {k!r}::DOUBLE)" for i, row in enumerate([[0.1, 0.2, 0.1], [0.0, 0.4, 0.0], [0.1, 0.0, 0.1]]) for j, k in enumerate(row)) + ") t(dy, dx, w)"
add_pixel_sql(
    "convolve_clip",
    f", c AS (SELECT p.image_id, p.y, p.x, sum(p.w * coalesce(q.v, 0)) AS s, sum(CASE WHEN q.v IS NULL THEN 0 ELSE p.w END) AS kept FROM (SELECT * FROM chats, {GRID}) p LEFT JOIN chats q ON q.image_id = p.image_id AND q.y = p.y - p.dy AND q.x = p.x - p.dx GROUP BY p.image_id, p.y, p.x) SELECT image_id, y, x, round(CASE WHEN kept <> 0 THEN s * {0.1 + 0.2 + 0.1 + 0.4 + 0.1 + 0.1!r}::DOUBLE / kept ELSE s END, 6) AS v FROM c",
    "chats",
)
add_pixel_sql("convolve_avoid", "SELECT p.image_id, p.y, p.x, round(CASE WHEN p.x = 0 OR p.x = s.ncols - 1 THEN p.v ELSE 0.25::DOUBLE * l.v + 0.5::DOUBLE * p.v + 0.25::DOUBLE * r.v END, 6) AS v FROM chats p JOIN size s USING (image_id) LEFT JOIN chats l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN chats r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x + 1", "chats size")

# --- thresholds and denoising ----------------------------------------------------------------------

GREY = ", grey AS (SELECT image_id, y, x, floor(0.3::DOUBLE * r + 0.59::DOUBLE * g + 0.11::DOUBLE * b + 0.5)::INT AS v FROM rgb)"
add_pixel_sql("to_onebit", GREY + OTSU.replace("FROM chats ", "FROM grey ") + "SELECT image_id, y, x, (v <= t)::INT AS v FROM grey JOIN t USING (image_id)", "rgb")
SHADE = f", d AS (SELECT p.image_id, p.y, p.x, max(q.v) - p.v AS v {near_sql('chats', 2)} {GP}), grey AS (SELECT image_id, y, x, (255 - floor(255.0::DOUBLE * (v - min(v) OVER i) / greatest(max(v) OVER i - min(v) OVER i, 1)))::INT AS v FROM d WINDOW i AS (PARTITION BY image_id))"
add_pixel_sql("shading_subtraction_auto", SHADE + OTSU.replace("FROM chats ", "FROM grey ") + "SELECT image_id, y, x, (v <= t)::INT AS v FROM grey JOIN t USING (image_id)", "chats")
add_pixel_sql(
    "wiener_filter_auto",
    f", l AS ({LOCAL} {near_sql('chats', 2)} {GP}), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY var, y, x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS area FROM l), n AS (SELECT image_id, var AS noise FROM r WHERE k = (area - 1) // 2) SELECT image_id, y, x, round(CASE WHEN var < noise OR var = 0 THEN m ELSE m + (var - noise) * (v - m) / var END, 6) AS v FROM l JOIN n USING (image_id)",
    "chats",
)

# --- drawing ---------------------------------------------------------------------------------------


def line_sql(y0: float, x0: float, y1: float, x1: float) -> str:
    """Places of a thin line: twice as many steps as its longer side."""
    n = int(max(abs(y1 - y0), abs(x1 - x0)) + 1) * 2
    return f"SELECT floor({y0} + ({y1 - y0}) * k / {n}::DOUBLE + 0.5)::INT AS y, floor({x0} + ({x1 - x0}) * k / {n}::DOUBLE + 0.5)::INT AS x FROM (SELECT unnest(range({n + 1})) AS k)"


def drawn(value: int, *lines: tuple) -> str:
    return f"SELECT d.image_id, d.y, d.x, CASE WHEN p.y IS NULL THEN d.v ELSE {value} END AS v FROM dots d LEFT JOIN (SELECT DISTINCT y, x FROM ({' UNION ALL '.join(line_sql(*one) for one in lines)})) p ON p.y = d.y AND p.x = d.x"


add_pixel_sql("draw_line", drawn(1, (0, 0, 5, 12)), "dots")
add_pixel_sql("draw_hollow_rect", drawn(1, (1, 1, 1, 9), (4, 1, 4, 9), (1, 1, 4, 1), (1, 9, 4, 9)), "dots")
add_pixel_sql("draw_marker", drawn(1, (1.5, 1.5, 6.5, 6.5), (6.5, 1.5, 1.5, 6.5)), "dots")
add_pixel_sql("draw_filled_rect", "SELECT image_id, y, x, CASE WHEN y BETWEEN 1 AND 4 AND x BETWEEN 1 AND 9 THEN 1 ELSE v END AS v FROM dots", "dots")

# --- distances and components ----------------------------------------------------------------------

FAR = {"chessboard": "greatest(abs(p.y - q.y), abs(p.x - q.x))", "manhattan": "abs(p.y - q.y) + abs(p.x - q.x)", "euclidean": "(p.y - q.y) ** 2 + (p.x - q.x) ** 2"}
for norm, e in FAR.items():
    value = "sqrt(min(e))" if norm == "euclidean" else "min(e)::DOUBLE"
    add_pixel_sql(
        f"distance_transform_{norm}",
        f", o AS (SELECT image_id, y, x, v > 60 AS b FROM chats2), w AS (SELECT image_id, y, x FROM o WHERE NOT b), e AS (SELECT p.image_id, p.y, p.x, {e} AS e FROM o p JOIN w q ON q.image_id = p.image_id WHERE p.b) SELECT image_id, y, x, round({value}, 6) AS v FROM e GROUP BY image_id, y, x UNION ALL SELECT image_id, y, x, 0.0::DOUBLE FROM w",
        "chats2",
    )
REACHED = """, b AS (SELECT image_id, y, x, y * 32 + x AS id FROM chats2 WHERE v > 200),
e AS (SELECT p.image_id, p.id AS a, q.id AS b FROM b p JOIN b q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1),
reach AS (SELECT image_id, id, id AS root FROM b UNION SELECT r.image_id, e.b, r.root FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.id WHERE e.b > r.root),
cc AS (SELECT image_id, id, min(root) AS root FROM reach GROUP BY image_id, id), big AS (SELECT image_id, root FROM cc GROUP BY image_id, root HAVING count(*) >= 3)
"""
add_pixel_sql("despeckle", REACHED + "SELECT c.image_id, c.y, c.x, (big.root IS NOT NULL)::INT AS v FROM chats2 c LEFT JOIN cc ON cc.image_id = c.image_id AND cc.id = c.y * 32 + c.x AND c.v > 200 LEFT JOIN big ON big.image_id = cc.image_id AND big.root = cc.root", "chats2")

# --- nearest neighbours, graphs, texts -------------------------------------------------------------

SQL["knn_confidences"] = (
    with_clause("glyphs")
    + PAIRS
    + VOTE
    + """, k AS (SELECT n.q, n.class, n.d, w.class AS win, min(n.d) OVER g AS d1, max(n.d) OVER g AS dk FROM n JOIN w ON w.q = n.q WHERE n.rank <= 3 WINDOW g AS (PARTITION BY n.q)),
c AS (SELECT *, class = win AS own, 1 / greatest(d, 1e-10) AS inv, CASE WHEN dk > d1 THEN (dk - d) / (dk - d1) ELSE 1.0::DOUBLE END AS lin FROM k)
SELECT q, win AS class, round(CASE WHEN max(dk) > 0 THEN (1 - min(d) / max(dk)) ** 10 ELSE 1 END, 6) AS "default", round(sum(own::INT) / 3.0::DOUBLE, 6) AS knnfraction,
  round(sum(CASE WHEN own THEN inv ELSE 0 END) / sum(inv), 6) AS inverseweight, round(sum(CASE WHEN own THEN lin ELSE 0 END) / greatest(sum(lin), 1e-10), 6) AS linearweight,
  round(coalesce(1 - min(d) / greatest(min(d) FILTER (NOT own), 1e-10), 1.0), 6) AS nun, round(CASE WHEN max(dk) > 0 THEN 1 - min(d) / max(dk) ELSE 1 END, 6) AS nndistance,
  round(CASE WHEN max(dk) > 0 THEN 1 - avg(d) FILTER (own) / max(dk) ELSE 1 END, 6) AS avgdistance FROM c GROUP BY q, win"""
)
SQL["graphviz_output"] = with_clause("edges") + """ SELECT '"' || src || '" -> "' || dst || '" [label="' || cost || '"];' AS line FROM edges"""
SQL["graph_spanning_tree"] = (
    with_clause("edges")
    + """, both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT min(src) AS id, 0 AS depth FROM edges UNION SELECT b.b, w.depth + 1 FROM walk w JOIN both_ b ON b.a = w.id WHERE w.depth < 60),
l AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT l.id, min(u.id) AS parent, l.depth FROM l LEFT JOIN both_ ON both_.b = l.id LEFT JOIN l u ON u.id = both_.a AND u.depth = l.depth - 1 GROUP BY l.id, l.depth"""
)
SQL["byte_size"] = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < 1024 THEN l_partkey || ' bytes' WHEN l_partkey < 1048576 THEN format('{:,.1f}', l_partkey / 1024.0::DOUBLE) || ' kb' ELSE format('{:,.1f}', l_partkey / 1048576.0::DOUBLE) || ' Mb' END AS size FROM lineitem"
SQL["to_nested_list"] = with_clause("chats") + " SELECT image_id, '[' || string_agg(r, ',' ORDER BY y) || ']' AS rows FROM (SELECT image_id, y, '[' || string_agg(v::VARCHAR, ',' ORDER BY x) || ']' AS r FROM chats GROUP BY image_id, y) GROUP BY image_id"

# --- statistics ------------------------------------------------------------------------------------

BINS = "WITH e AS (SELECT min({x}) AS lo, (max({x}) - min({x}) + (max({x}) - min({x})) / 10 + 1e-6::DOUBLE) / 10 AS width, count({x}) AS n FROM lineitem), h AS (SELECT b.bin, coalesce(h.n, 0) AS n, lo - width / 2 + b.bin * width AS low, width, e.n AS total FROM (SELECT unnest(range(10))::INT AS bin) b CROSS JOIN e LEFT JOIN (SELECT floor(({x} - (lo - width / 2)) / width)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) h ON h.bin = b.bin), c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto FROM h)"
SQL["stats_percentiles"] = BINS.format(x="l_extendedprice") + " SELECT (SELECT round(low + (total * 0.25::DOUBLE - (upto - n)) / greatest(n, 1) * width, 6) FROM c WHERE upto >= total * 0.25 ORDER BY bin LIMIT 1) AS score, (SELECT round(((upto - n) + (30000 - low) / width * n) / total * 100, 6) FROM c WHERE bin = (SELECT least(greatest(floor((30000 - min(low)) / min(width)), 0), 9) FROM c)) AS percent"

