"""Comparing Spark results with DuckDB and building small images."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def connection(sf_dir: str = SF):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float | np.floating):
        return "nan" if math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}" if math.isfinite(v) else str(v)
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, run, sql: str, sf_dir: str = SF) -> int:
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = connection(sf_dir).execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, res.fetchall())
    assert got == want
    return len(got)


def image(spark, *grids, kind: str = "int"):
    """px of rasters, numbered from 0."""
    rows = [(i, y, x, float(v) if kind == "double" else int(v)) for i, g in enumerate(grids) for y, r in enumerate(np.asarray(g)) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, v {kind}")


def grid(df, image_id: int = 0) -> np.ndarray:
    r = df.where(f"image_id = {image_id}").collect()
    out = np.zeros((max(x["y"] for x in r) + 1, max(x["x"] for x in r) + 1), dtype=float)
    for x in r:
        out[x["y"], x["x"]] = x["v"]
    return out
