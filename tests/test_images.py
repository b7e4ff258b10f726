"""Goldens of small rasters, and brute force in numpy."""

import numpy as np
import pytest
from helpers import grid, image

from pagewright.operators import features as Q
from pagewright.operators import kernels as K
from pagewright.operators import neighborhood as N
from pagewright.operators import pixel as P
from pagewright.operators import segment as S
from pagewright.operators import threshold as T
from pagewright.plans.scratch import keep
from pagewright.sources import codecs
from pagewright.sources import raster as R


def blank(h, w, *fills):
    a = np.zeros((h, w), dtype=int)
    for y0, x0, y1, x1, v in fills:
        a[y0 : y1 + 1, x0 : x1 + 1] = v
    return a


def hollow(a, x0, y0, x1, y1):
    a[[y0, y1], x0 : x1 + 1] = 1
    a[y0 : y1 + 1, [x0, x1]] = 1


def test_area_and_shape(spark):
    got = {r["image_id"]: r for r in Q.page_features(image(spark, blank(9, 9), blank(6, 4), blank(17, 4), blank(9, 9, (1, 1, 5, 3, 1)))).collect()}
    assert [got[i]["area"] for i in range(3)] == [81, 24, 68]
    assert got[0]["aspect_ratio"] == 1.0 and round(got[1]["aspect_ratio"], 4) == 0.6667 and round(got[2]["aspect_ratio"], 6) == 0.235294
    assert got[3]["black_area"] == 15


def test_compactness(spark):
    px = image(spark, blank(8, 8, (0, 0, 7, 7, 1)), blank(8, 8, (1, 1, 6, 6, 1)), blank(8, 8, (1, 1, 1, 1, 1)), blank(8, 8, (2, 2, 2, 6, 1)), blank(3, 3))
    got = {r["image_id"]: r["compactness"] for r in Q.compactness(px).collect()}
    assert [round(got[i], 4) for i in range(4)] == [0.5625, 0.7778, 8.0, 3.2]
    assert got[4] > 1e300


def test_moments(spark):
    px = image(spark, blank(9, 9, (1, 4, 1, 4, 1)), blank(8, 8, (3, 2, 4, 5, 1)), blank(4, 4))
    got = {r["image_id"]: list(r)[1:] for r in Q.moments(px).collect()}
    assert got[0][:3] == [0.5, 0.125, 0.0] and got[0][8] == 0.0
    assert np.allclose(got[1], [0.5, 0.5, 0.15625, 0.03125, 0, 0, 0, 0, 0])
    assert np.allclose(got[2], 0)


def test_holes_top_bottom_and_regions(spark):
    a = blank(8, 8)
    hollow(a, 1, 1, 4, 5)
    hollow(a, 2, 3, 6, 7)
    a[7, 3:6] = 0
    r = Q.nholes(image(spark, a)).first()
    assert (r["vertical"], r["horizontal"]) == (0.375, 0.75)
    b = blank(8, 8)
    b[2:6, 1] = 1
    b[5, 1:4] = 1
    t = Q.top_bottom(image(spark, b)).first()
    assert (t["top"], t["bottom"]) == (0.25, 0.625)
    assert Q.page_features(image(spark, b)).first()["volume"] == 0.09375
    c = blank(8, 8)
    hollow(c, 1, 1, 6, 4)
    hollow(c, 2, 4, 7, 7)
    v = [x["volume"] for x in sorted(Q.region_volumes(image(spark, c), 4).collect(), key=lambda x: x["region"])]
    assert v[:10] == [0.25, 0.5, 0.25, 0, 0.5, 0, 0.75, 0.75, 0.5, 0]


def test_edge_rows_of_top_bottom(spark):
    got = {r["image_id"]: (r["top"], r["bottom"]) for r in Q.top_bottom(image(spark, blank(4, 4), blank(4, 4, (0, 0, 0, 3, 1)))).collect()}
    assert got == {0: (1.0, 0.0), 1: (0.0, -0.25)}


def test_run_length_round_trip(spark):
    rng = np.random.default_rng(3)
    grids = [rng.integers(0, 2, (5, 7)), blank(3, 3), blank(3, 3, (0, 0, 2, 2, 1))]
    px = image(spark, *grids)
    rle = Q.to_rle(px)
    assert {r["image_id"]: r["rle"] for r in rle.collect()}[2] == "0 9"
    back = Q.from_rle(rle.join(R.sizes(px), "image_id"))
    for i, g in enumerate(grids):
        assert (grid(back, i) == g).all()
    with pytest.raises(Exception, match="must be numbers"):
        Q.from_rle(spark.createDataFrame([(0, "1 x", 2)], "image_id long, rle string, ncols int")).collect()


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(5)
    grids = [(rng.random((12, 15)) < p).astype(int) for p in (0.2, 0.4, 0.7)]
    got = S.cc_analysis(image(spark, *grids), keep)
    for i, g in enumerate(grids):
        a, b = grid(got, i), K.label(g)
        assert ((a > 0) == (b > 0)).all()
        assert len({(p, q) for p, q in zip(a.ravel(), b.ravel())}) == len(set(b.ravel()))
    small = S.despeckle(image(spark, grids[0]), 3, keep)
    assert (grid(small) == (K.despeckle(grids[0], 3) > 0)).all()


def test_filters_against_numpy(spark):
    a = np.random.default_rng(1).integers(0, 256, (6, 8))
    px = image(spark, a)
    want = np.array([[np.sort(np.pad(a, 1, constant_values=255)[y : y + 3, x : x + 3].ravel())[4] for x in range(8)] for y in range(6)])
    assert (grid(N.rank(px, 5)) == want).all()
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(a, 2, constant_values=-1), (5, 5)).max(axis=(2, 3))
    assert (grid(N.min_max_filter(px, 5, "max")) == wide).all()
    k = np.array([[0.0, 0.1, 0.2], [0.3, 0.1, 0.0], [0.2, 0.1, 0.0]])
    p = np.pad(a, 1, mode="reflect")
    conv = sum(k[i, j] * p[2 - i : 8 - i, 2 - j : 10 - j] for i in range(3) for j in range(3))
    assert np.allclose(grid(N.convolve(px, k.tolist(), "reflect")), conv)


def test_otsu_flat_and_split(spark):
    px = image(spark, [[5, 5, 5]], [[0, 0, 200, 210]])
    got = {r["image_id"]: r["t"] for r in T.otsu_find_threshold(px).collect()}
    assert got[0] == 127 and got[1] == 0


def test_thinning_keeps_lines_thin_and_connected():
    a = blank(12, 12, (2, 3, 9, 8, 1))
    for f in (K.thin_zs, K.thin_hs, K.thin_lc):
        s = f(a)
        assert 0 < s.sum() < a.sum() and (s <= a).all() and K.label(s).max() == 1


def test_distance_transform_brute():
    a = (np.random.default_rng(2).random((7, 9)) < 0.8).astype(int)
    white = np.argwhere(a == 0)
    for norm, f in (("euclidean", lambda d: np.hypot(*d.T)), ("manhattan", lambda d: np.abs(d).sum(1)), ("chessboard", lambda d: np.abs(d).max(1))):
        want = np.array([[f(white - (y, x)).min() for x in range(9)] for y in range(7)])
        assert np.allclose(K.distance_transform(a, norm), want)


def test_codecs():
    rng = np.random.default_rng(0)
    for form, enc, dec in (("png", codecs.encode_png, codecs.decode_png), ("tiff", codecs.encode_tiff, codecs.decode_tiff)):
        for kind, top, shape in (("onebit", 2, (5, 11)), ("greyscale", 256, (4, 3)), ("grey16", 65536, (3, 5)), ("rgb", 256, (4, 6, 3))):
            a = rng.integers(0, top, shape)
            assert (dec(enc(a, kind)) == a).all(), (form, kind)
    with pytest.raises(ValueError, match="not a TIFF"):
        codecs.info(b"junk" * 4)


def test_voronoi_golden():
    a = np.zeros((10, 10), dtype=int)
    a[2, 2], a[2, 3], a[8, 3], a[5, 6] = 2, 2, 3, 4
    v = K.voronoi_from_labeled_image(a)
    assert (v[4, 2], v[8, 4], v[4, 5]) == (2, 3, 4)
    assert len(K.delaunay([(50, 50), (25, 100), (50, 150), (150, 60), (150, 125)])) == 7


def test_sizes_must_agree(spark):
    with pytest.raises(Exception, match="differ in size"):
        P.arithmetic(image(spark, [[1, 2]]), image(spark, [[1]]), "add").collect()


def test_empty_images(spark):
    none = image(spark)
    for f in (Q.page_features, Q.moments, Q.projection_rows, Q.runs, Q.to_rle, T.otsu_find_threshold, P.invert, N.dilate, Q.compactness):
        assert f(none).count() == 0
