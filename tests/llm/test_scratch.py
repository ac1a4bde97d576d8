"""Intermediate tables go once the work that read them has been written."""

import os

from wardwise.llm import common


def test_stored_tables_go_with_their_scope(spark, tmp_path):
    before = common.stored(spark.range(3), "outside")
    with common.scratch(spark):
        inner = common.stored(spark.range(5), "inside")
        path = inner.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        inner.write.parquet(str(tmp_path / "result"))
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
    assert before.count() == 3 and spark.read.parquet(str(tmp_path / "result")).count() == 5
