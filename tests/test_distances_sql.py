"""Distance transforms of images without white against DuckDB."""

import pytest
from helpers import compare

from pagewright.plans import library


@pytest.mark.parametrize("norm", ["chessboard", "manhattan", "euclidean"])
def test_image_without_white_has_no_distance(spark, tmp_path, norm):
    rows = [(1, 0, "user", "a" * 32), (1, 1, "user", "ab cd e f" * 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    name = f"distance_transform_{norm}"
    assert compare(spark, library.queries()[name], library.oracle_sql()[name], str(tmp_path)) == 1
