import os

import pytest

from pulse.session import scratch, shared_dir


def test_scratch_folders_are_removed_with_the_block(spark):
    outside = shared_dir(spark, "kept")
    spark.range(3).write.parquet(outside)
    with scratch(spark) as folder:
        inner = shared_dir(spark, "table")
        assert inner.startswith(folder + "/") and inner != shared_dir(spark, "table")
        spark.range(5).write.parquet(inner)
        with scratch(spark) as nested:
            spark.range(1).write.parquet(shared_dir(spark, "table"))
            assert nested.startswith(folder + "/") and os.path.isdir(nested)
        assert not os.path.isdir(nested) and spark.read.parquet(inner).count() == 5
    assert not os.path.isdir(folder) and spark.read.parquet(outside).count() == 3
    assert not shared_dir(spark, "x").startswith(folder)


def test_scratch_folders_are_removed_after_an_error(spark):
    with pytest.raises(KeyError), scratch(spark) as folder:
        spark.range(2).write.parquet(shared_dir(spark, "table"))
        raise KeyError
    assert not os.path.isdir(folder)
    with scratch(spark):
        pass  # nothing was written, so there is nothing to remove
