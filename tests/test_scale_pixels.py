"""Pixel queries at size: what is sent to the driver, how texts are dealt, how long a kernel takes."""

import time

import numpy as np
import pytest
from helpers import SF

from pagewright.operators import kernels as K
from pagewright.plans import base, library

Q = library.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["convolve_avoid", "convolve_clip", "convolve_x", "convolve_xy", "convolve_y", "create_gabor_filter", "simple_sharpen", "sobel_edge_detection", "gaussian_gradient", "laplacian_of_gaussian", "dilate_with_structure", "erode_with_structure", "labeled_region_edges_both", "outline_inner", "outline_outer"])
def test_masks_join_no_pixels(spark, name):
    assert "Join" not in plan(Q[name](spark, SF))


@pytest.mark.parametrize("name", ["abutaleb_threshold", "bernsen_threshold"])
def test_thresholds_join_no_pixels(spark, name):
    assert "Join" not in plan(Q[name](spark, SF))


@pytest.mark.parametrize("name", ["filter_narrow_runs", "filter_wide_runs", "filter_short_runs", "filter_tall_runs"])
def test_run_filters_join_no_pixels(spark, name):
    assert "Join" not in plan(Q[name](spark, SF))


@pytest.mark.parametrize("name", ["highlight", "mse", "pad_image", "draw_cc"])
def test_two_images_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(Q[name](spark, SF))


def test_hough_accumulator_is_not_joined(spark):
    assert "Join" not in plan(Q["hough_lines"](spark, SF))


@pytest.mark.parametrize("run", [lambda a: K.kfill(a), lambda a: K.kfill_modified(a), lambda a: K.degrade_kanungo(a, 0.01, 0.5, 1.0, 0.5, 1.0), lambda a: K.difference_of_exponential_crack_edge_image(a * 200)])
def test_kernels_take_whole_rows_at_once(run):
    a = (np.random.default_rng(1).random((700, 700)) < 0.5).astype(np.int32)
    start = time.process_time()
    run(a)
    assert time.process_time() - start < 1.5


def test_texts_are_dealt_by_their_characters(spark, monkeypatch):
    few = base.chats(spark, SF).rdd.getNumPartitions()
    monkeypatch.setattr(base, "TASK_PIXELS", 1000)
    assert base.chats(spark, SF).rdd.getNumPartitions() > 2 * few
