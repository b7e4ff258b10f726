"""Registered queries on images: casts, colour, pixel algebra, utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixel as P
from ..sources import raster as R
from .base import add, add_pixels, chats, chats2, dots, rgb

KEY = ["image_id", "y", "x"]
RGB = ("r", "g", "b")


def flat(df):
    return df.select(*KEY, "v.r", "v.g", "v.b")


add_pixels("to_rgb", lambda s, d: flat(P.to_rgb(dots(s, d), "onebit")), "SELECT image_id, y, x, c AS r, c AS g, c AS b FROM (SELECT *, CASE WHEN v > 0 THEN 0 ELSE 255 END AS c FROM dots)", "dots", values=RGB)
add_pixels("rgb_to_greyscale", lambda s, d: P.rgb_to_greyscale(rgb(chats(s, d))), "SELECT image_id, y, x, floor(0.3::DOUBLE * r + 0.59::DOUBLE * g + 0.11::DOUBLE * b + 0.5)::INT AS v FROM rgb", "rgb")
add_pixels("onebit_to_greyscale", lambda s, d: P.onebit_to_greyscale(dots(s, d)), "SELECT image_id, y, x, CASE WHEN v > 0 THEN 0 ELSE 255 END AS v FROM dots", "dots")
add_pixels(
    "float_to_greyscale",
    lambda s, d: P.float_to_greyscale(P.to_float(chats(s, d))),
    "SELECT image_id, y, x, CASE WHEN hi > lo THEN floor((v::DOUBLE - lo) * 255.0::DOUBLE / (hi - lo))::INT ELSE 0 END AS v FROM chats JOIN (SELECT image_id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM chats GROUP BY image_id) USING (image_id)",
    "chats",
)
add_pixels("to_grey16", lambda s, d: P.to_grey16(chats(s, d)), "SELECT image_id, y, x, floor(v * 65535.0::DOUBLE / greatest(max(v) OVER (PARTITION BY image_id), 1))::INT AS v FROM chats", "chats")
add_pixels("grey16_to_greyscale", lambda s, d: P.grey16_to_greyscale(chats(s, d).withColumn("v", F.col("v") * 100)), "SELECT image_id, y, x, floor(v * 100 * 255.0::DOUBLE / greatest(max(v * 100) OVER (PARTITION BY image_id), 1))::INT AS v FROM chats", "chats")
add_pixels("to_float", lambda s, d: P.to_float(chats(s, d)), "SELECT image_id, y, x, v::DOUBLE AS v FROM chats", "chats")
add_pixels(
    "complex_parts",
    lambda s, d: P.to_complex(chats(s, d)).select(*KEY, F.col("v.re").alias("re"), F.col("v.im").alias("im")),
    "SELECT image_id, y, x, v::DOUBLE AS re, 0.0::DOUBLE AS im FROM chats",
    "chats",
    values=("re", "im"),
)
add_pixels("extract_real", lambda s, d: P.extract_real(P.to_complex(chats(s, d))), "SELECT image_id, y, x, v::DOUBLE AS v FROM chats", "chats")
add_pixels("extract_imaginary", lambda s, d: P.extract_imaginary(P.to_complex(chats(s, d))), "SELECT image_id, y, x, 0.0::DOUBLE AS v FROM chats", "chats")

CHANNELS = ("red", "green", "blue", "cyan", "magenta", "yellow", "hue", "saturation", "value", "cie_x", "cie_y", "cie_z", "cie_Lab_L", "cie_Lab_a", "cie_Lab_b")
XYZ_SQL = {k: f"(({m[0]}::DOUBLE * r + {m[1]}::DOUBLE * g + {m[2]}::DOUBLE * b) / 255.0::DOUBLE)" for k, m in P.XYZ.items()}
LAB_SQL = {k: f"(CASE WHEN {XYZ_SQL[k]} / {w}::DOUBLE > 0.008856::DOUBLE THEN cbrt({XYZ_SQL[k]} / {w}::DOUBLE) ELSE 7.787::DOUBLE * {XYZ_SQL[k]} / {w}::DOUBLE + 16.0::DOUBLE / 116 END)" for k, w in zip("xyz", P.D65, strict=True)}
add_pixels(
    "color_channels",
    lambda s, d: rgb(chats(s, d)).select(*KEY, *[(F.round(P.channel(c), 6) + 0.0).alias(c) for c in CHANNELS]),
    f"""SELECT image_id, y, x, r::DOUBLE AS red, g::DOUBLE AS green, b::DOUBLE AS blue, (255 - r)::DOUBLE AS cyan, (255 - g)::DOUBLE AS magenta, (255 - b)::DOUBLE AS yellow,
  round(CASE WHEN hi = lo THEN 0 WHEN h < 0 THEN h + 1 ELSE h END, 6) AS hue, round(CASE WHEN hi > 0 THEN (hi - lo)::DOUBLE / hi ELSE 0 END, 6) AS saturation, round(hi / 255.0::DOUBLE, 6) AS value,
  round({XYZ_SQL["x"]}, 6) AS cie_x, round({XYZ_SQL["y"]}, 6) AS cie_y, round({XYZ_SQL["z"]}, 6) AS cie_z,
  round(116 * {LAB_SQL["y"]} - 16, 6) AS "cie_Lab_L", round(500 * ({LAB_SQL["x"]} - {LAB_SQL["y"]}), 6) + 0.0::DOUBLE AS "cie_Lab_a", round(200 * ({LAB_SQL["y"]} - {LAB_SQL["z"]}), 6) + 0.0::DOUBLE AS "cie_Lab_b"
FROM (SELECT *, (CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b)::DOUBLE / (hi - lo) WHEN hi = g THEN 2 + (b - r)::DOUBLE / (hi - lo) ELSE 4 + (r - g)::DOUBLE / (hi - lo) END) / 6.0::DOUBLE AS h
  FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb))""",
    "rgb",
    values=CHANNELS,
)
add_pixels(
    "false_color",
    lambda s, d: flat(P.false_color(chats(s, d))),
    """SELECT image_id, y, x, floor(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.5::DOUBLE - abs(4 * t - 3))) + 0.5::DOUBLE)::INT AS r, floor(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.5::DOUBLE - abs(4 * t - 2))) + 0.5::DOUBLE)::INT AS g,
  floor(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.5::DOUBLE - abs(4 * t - 1))) + 0.5::DOUBLE)::INT AS b
FROM (SELECT image_id, y, x, CASE WHEN hi > lo THEN (v - lo)::DOUBLE / (hi - lo) ELSE 0.0::DOUBLE END AS t FROM chats JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM chats GROUP BY image_id) USING (image_id))""",
    "chats",
    values=RGB,
)
add_pixels(
    "colors_to_labels",
    lambda s, d: P.colors_to_labels(rgb(chats(s, d))),
    "SELECT image_id, y, x, coalesce(n, 0)::INT AS v FROM rgb LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) AS n FROM (SELECT DISTINCT image_id, r, g, b FROM rgb WHERE NOT (r = 255 AND g = 255 AND b = 255))) USING (image_id, r, g, b)",
    "rgb",
)
add_pixels("colors_to_labels_map", lambda s, d: P.colors_to_labels(rgb(chats(s, d)), {(32, 224, 160): 5, (101, 195, 33): 9}), "SELECT image_id, y, x, CASE WHEN r = 32 THEN 5 WHEN r = 101 THEN 9 ELSE 0 END AS v FROM rgb", "rgb")
for op, sql in (("add", "least(255, a.v + b.v)"), ("subtract", "greatest(0, a.v - b.v)"), ("multiply", "least(255, a.v * b.v)"), ("divide", "CASE WHEN b.v = 0 THEN 0 ELSE a.v // b.v END")):
    add_pixels(f"{op}_images", lambda s, d, op=op: P.arithmetic(chats(s, d), chats2(s, d), op), f"SELECT image_id, y, x, ({sql})::INT AS v FROM chats a JOIN chats2 b USING (image_id, y, x)", "chats chats2")
for op, sql in (("add", "a.v > 0 OR b.v > 127"), ("subtract", "a.v > 0 AND NOT b.v > 127"), ("multiply", "a.v > 0 AND b.v > 127")):
    add_pixels(f"{op}_images_onebit", lambda s, d, op=op: P.arithmetic(dots(s, d), R.ink(chats2(s, d), 127), op, "onebit"), f"SELECT image_id, y, x, ({sql})::INT AS v FROM dots a JOIN chats2 b USING (image_id, y, x)", "dots chats2")
for op, sql in (("and", "a.v > 0 AND b.v > 127"), ("or", "a.v > 0 OR b.v > 127"), ("xor", "(a.v > 0) <> (b.v > 127)")):
    add_pixels(f"{op}_image", lambda s, d, op=op: P.logical(dots(s, d), R.ink(chats2(s, d), 127), op), f"SELECT image_id, y, x, ({sql})::INT AS v FROM dots a JOIN chats2 b USING (image_id, y, x)", "dots chats2")
add_pixels("mask", lambda s, d: P.mask(chats2(s, d), dots(s, d)), "SELECT image_id, y, x, CASE WHEN b.v > 0 THEN a.v ELSE 255 END AS v FROM chats2 a JOIN dots b USING (image_id, y, x)", "dots chats2")
add_pixels("union_images", lambda s, d: P.union_images(dots(s, d)), "SELECT 0::BIGINT AS image_id, y, x, max(v) AS v FROM dots GROUP BY y, x", "dots")
add_pixels(
    "diff_images",
    lambda s, d: flat(P.diff_images(dots(s, d), R.ink(chats2(s, d), 127))),
    "SELECT image_id, y, x, CASE WHEN p AND q THEN 0 WHEN p THEN 255 WHEN q THEN 0 ELSE 255 END AS r, CASE WHEN p AND q THEN 0 WHEN p THEN 0 WHEN q THEN 255 ELSE 255 END AS g, CASE WHEN p OR q THEN 0 ELSE 255 END AS b FROM (SELECT image_id, y, x, a.v > 0 AS p, b.v > 127 AS q FROM dots a JOIN chats2 b USING (image_id, y, x))",
    "dots chats2",
    values=RGB,
)
add(
    "mse",
    lambda s, d: P.mse(rgb(chats(s, d)), rgb(chats2(s, d))).withColumn("mse", F.round("mse", 6)),
    "SELECT image_id, round(avg((a.v - b.v) ** 2 + (a.v * 7 % 256 - b.v * 7 % 256) ** 2 + (a.v * 13 % 256 - b.v * 13 % 256) ** 2) / 3, 6) AS mse FROM chats a JOIN chats2 b USING (image_id, y, x) GROUP BY image_id",
    "chats chats2",
)
add_pixels("highlight", lambda s, d: P.highlight(chats(s, d), R.ink(chats2(s, d), 127), 200), "SELECT image_id, y, x, CASE WHEN b.v > 127 THEN 200 ELSE a.v END AS v FROM chats a JOIN chats2 b USING (image_id, y, x)", "chats chats2")
add("invert", lambda s, d: P.invert(chats(s, d)), "SELECT image_id, y, x, 255 - v AS v FROM chats", "chats")
add_pixels("invert_onebit", lambda s, d: P.invert(dots(s, d), "onebit"), "SELECT image_id, y, x, (v = 0)::INT AS v FROM dots", "dots")
add_pixels("fill", lambda s, d: P.fill(chats(s, d), 7), "SELECT image_id, y, x, 7 AS v FROM chats", "chats")
add_pixels("fill_white", lambda s, d: P.fill(chats(s, d), 255), "SELECT image_id, y, x, 255 AS v FROM chats", "chats")
add_pixels("grey_convert", lambda s, d: P.grey_convert(chats(s, d), [(k * k) % 256 for k in range(256)]), "SELECT image_id, y, x, v * v % 256 AS v FROM chats", "chats")
add_pixels("reset_onebit_image", lambda s, d: P.reset_onebit(chats(s, d)), "SELECT image_id, y, x, (v > 0)::INT AS v FROM chats", "chats")
add_pixels("subimage", lambda s, d: P.subimage(chats(s, d), 4, 1, 20, 5), "SELECT image_id, y - 1 AS y, x - 4 AS x, v FROM chats WHERE x BETWEEN 4 AND 20 AND y BETWEEN 1 AND 5", "chats")
add_pixels(
    "clip_image",
    lambda s, d: P.clip_image(chats(s, d), 4, 10, 20, 15),
    "SELECT image_id, y, x, v FROM chats WHERE x BETWEEN 4 AND 20 AND y BETWEEN 10 AND 15 UNION ALL SELECT image_id, y, x, v FROM chats WHERE x = 0 AND y = 0 AND image_id NOT IN (SELECT image_id FROM chats WHERE x BETWEEN 4 AND 20 AND y BETWEEN 10 AND 15)",
    "chats",
)
add_pixels(
    "pad_image",
    lambda s, d: P.pad_image(chats(s, d), 1, 2, 3, 4, 255),
    "SELECT g.image_id, g.y::INT AS y, g.x::INT AS x, coalesce(c.v, 255) AS v FROM (SELECT image_id, y, unnest(range(ncols + 6)) AS x FROM (SELECT image_id, ncols, unnest(range(nrows + 4)) AS y FROM size)) g LEFT JOIN chats c ON c.image_id = g.image_id AND c.y = g.y - 1 AND c.x = g.x - 4",
    "chats size",
)
add_pixels("pad_image_default", lambda s, d: P.pad_image(dots(s, d), 1, 1, 1, 1, 0), "SELECT g.image_id, g.y::INT AS y, g.x::INT AS x, coalesce(c.v, 0) AS v FROM (SELECT image_id, y, unnest(range(ncols + 2)) AS x FROM (SELECT image_id, ncols, unnest(range(nrows + 2)) AS y FROM size)) g LEFT JOIN dots c ON c.image_id = g.image_id AND c.y = g.y - 1 AND c.x = g.x - 1", "dots size")
add_pixels(
    "trim_image",
    lambda s, d: P.trim_image(R.ink(chats2(s, d), 160)),
    ", o AS (SELECT image_id, y, x, (v > 160)::INT AS v FROM chats2), b AS (SELECT image_id, coalesce(min(y) FILTER (v <> 0), min(y)) AS y0, coalesce(max(y) FILTER (v <> 0), max(y)) AS y1, coalesce(min(x) FILTER (v <> 0), min(x)) AS x0, coalesce(max(x) FILTER (v <> 0), max(x)) AS x1 FROM o GROUP BY image_id) SELECT image_id, y - y0 AS y, x - x0 AS x, v FROM o JOIN b USING (image_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1",
    "chats2",
)
add_pixels("mirror_horizontal", lambda s, d: P.mirror_horizontal(chats(s, d)), "SELECT image_id, nrows - 1 - y AS y, x, v FROM chats JOIN size USING (image_id)", "chats size")
add_pixels("mirror_vertical", lambda s, d: P.mirror_vertical(chats(s, d)), "SELECT image_id, y, ncols - 1 - x AS x, v FROM chats JOIN size USING (image_id)", "chats size")
add_pixels(
    "shear_row",
    lambda s, d: P.shear_row(chats(s, d), 0, 3),
    "SELECT image_id, y, x, v FROM chats WHERE y <> 0 UNION ALL SELECT a.image_id, a.y, a.x, b.v FROM chats a JOIN size s USING (image_id) JOIN chats b ON b.image_id = a.image_id AND b.y = 0 AND b.x = least(greatest(a.x - 3, 0), s.ncols - 1) WHERE a.y = 0",
    "chats size",
)
add_pixels(
    "shear_column",
    lambda s, d: P.shear_column(chats(s, d), 0, 2),
    "SELECT image_id, y, x, v FROM chats WHERE x <> 0 UNION ALL SELECT a.image_id, a.y, a.x, b.v FROM chats a JOIN size s USING (image_id) JOIN chats b ON b.image_id = a.image_id AND b.x = 0 AND b.y = least(greatest(a.y - 2, 0), s.nrows - 1) WHERE a.x = 0",
    "chats size",
)
add_pixels(
    "resize",
    lambda s, d: P.resize(chats(s, d), 8, 16),
    "SELECT g.image_id, g.y::INT AS y, g.x::INT AS x, c.v FROM (SELECT image_id, nrows, ncols, y, unnest(range(16)) AS x FROM (SELECT *, unnest(range(8)) AS y FROM size)) g JOIN chats c ON c.image_id = g.image_id AND c.y = g.y * g.nrows // 8 AND c.x = g.x * g.ncols // 16",
    "chats size",
)
add_pixels(
    "scale",
    lambda s, d: P.scale(chats(s, d), 0.5),
    "SELECT g.image_id, g.y::INT AS y, g.x::INT AS x, c.v FROM (SELECT *, unnest(range(nc)) AS x FROM (SELECT *, greatest(nrows // 2, 1) AS nr, greatest(ncols // 2, 1) AS nc, unnest(range(greatest(nrows // 2, 1))) AS y FROM size)) g JOIN chats c ON c.image_id = g.image_id AND c.y = g.y * g.nrows // g.nr AND c.x = g.x * g.ncols // g.nc",
    "chats size",
)
add("histogram", lambda s, d: P.histogram(chats(s, d)).withColumn("share", F.round("share", 9)), "SELECT image_id, v, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY image_id), 9) AS share FROM chats GROUP BY image_id, v", "chats")
MINMAX = "SELECT image_id, min(v) AS min_v, arg_min(y, v * 100000 - y * 32 - x) AS min_y, arg_min(x, v * 100000 - y * 32 - x) AS min_x, max(v) AS max_v, arg_max(y, v * 100000 + y * 32 + x) AS max_y, arg_max(x, v * 100000 + y * 32 + x) AS max_x FROM {} GROUP BY image_id"
add("min_max_location_nomask", lambda s, d: P.min_max_location(chats(s, d)), MINMAX.format("chats"), "chats")
add("min_max_location", lambda s, d: P.min_max_location(chats2(s, d), dots(s, d)), ", m AS (SELECT a.* FROM chats2 a JOIN dots b USING (image_id, y, x) WHERE b.v > 0) " + MINMAX.format("m"), "chats2 dots")
add("ccs_from_labeled_image", lambda s, d: P.ccs_from_labeled_image(chats(s, d)), "SELECT image_id, v AS label, min(x) AS ulx, min(y) AS uly, max(x) AS lrx, max(y) AS lry, count(*) AS n FROM chats WHERE v > 0 GROUP BY image_id, v", "chats")
PAL = " ".join(f"WHEN v > 0 AND v % 8 = {k} THEN {{{k}}}" for k in range(8))
add_pixels(
    "color_ccs",
    lambda s, d: flat(P.color_ccs(chats(s, d))),
    "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN v = 1 THEN 0 {PAL.format(*[c[i] for c in P.PALETTE])} ELSE 255 END AS {n}" for i, n in enumerate("rgb")) + " FROM chats",
    "chats",
    values=RGB,
)
add_pixels("nested_list_round_trip", lambda s, d: R.from_nested_list(R.to_nested_list(R.padded(chats(s, d), 0)), "image_id", "rows"), "SELECT g.image_id, g.y::INT AS y, g.x::INT AS x, coalesce(c.v, 0) AS v FROM (SELECT image_id, y, unnest(range(ncols)) AS x FROM (SELECT image_id, ncols, unnest(range(nrows)) AS y FROM size)) g LEFT JOIN chats c ON c.image_id = g.image_id AND c.y = g.y AND c.x = g.x", "chats size")
add("to_nested_list", lambda s, d: R.to_nested_list(chats(s, d)).select("image_id", F.to_json("rows").alias("rows")))
add("to_raw_string", lambda s, d: R.to_raw_string(chats(s, d)).select("image_id", "nrows", "ncols", F.md5("data").alias("digest")), "SELECT image_id, max(y) + 1 AS nrows, max(x) + 1 AS ncols, md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY y, x))) AS digest FROM chats GROUP BY image_id", "chats")
add_pixels("raw_string_round_trip", lambda s, d: R.from_raw_string(R.to_raw_string(chats(s, d))), "SELECT image_id, y, x, v FROM chats", "chats")
add("to_rgb_string", lambda s, d: R.to_rgb_string(rgb(chats(s, d))).select("image_id", F.md5("data").alias("digest")), "SELECT image_id, md5(unhex(string_agg(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0'), '' ORDER BY y, x))) AS digest FROM rgb GROUP BY image_id", "rgb")
add_pixels("draw_cc", lambda s, d: flat(P.highlight(rgb(chats(s, d)), R.ink(chats2(s, d), 127), None).withColumn("v", F.coalesce("v", F.struct(F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))))), "SELECT image_id, y, x, CASE WHEN p.v > 127 THEN 255 ELSE r END AS r, CASE WHEN p.v > 127 THEN 0 ELSE g END AS g, CASE WHEN p.v > 127 THEN 0 ELSE b END AS b FROM rgb JOIN chats2 p USING (image_id, y, x)", "rgb chats2", values=RGB)
