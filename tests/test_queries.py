"""Registered queries against DuckDB on the smallest tables."""

import pytest
from helpers import compare

from pagewright.plans import library

Q, SQL = library.queries(), library.oracle_sql()
SAMPLE = [
    "page_features", "moments", "projections", "iterate_runs", "run_histogram", "to_rle", "contour_bottom", "compactness", "rect_intersects_join", "rect_distances", "cc_analysis", "color_channels", "colors_to_labels",
    "add_images", "xor_image", "trim_image", "shear_row", "min_max_location", "pad_image", "mean_filter", "rank", "simple_sharpen", "dilate_with_structure", "labeled_region_edges_both", "otsu_threshold", "tsai_moment_preserving_threshold",
    "brink_threshold", "bernsen_threshold", "sauvola_threshold", "gatos_threshold", "knn_classify", "confusion_matrix", "normalization", "graph_components", "graph_bfs", "kdtree_k_nearest_neighbors", "rule_engine", "edit_distance",
    "stats_describe", "stats_histogram", "stats_spearmanr", "stats_rank_sums", "stats_f_oneway", "tables_abut", "tables_collapse", "png_rgb_round_trip", "tiff_onebit_round_trip", "glyph_xml_round_trip", "windowed_counts", "streaming_classification",
    "mlcc_relabel", "region_lookup", "group_and_update_list_automatic", "generate_features", "get_confidence", "graph_dfs", "convolve_clip", "distance_transform_euclidean", "simple_feature_selector", "name_lookup_unicode",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    assert compare(spark, Q[name], SQL[name]) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(Q)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(library.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
