import pytest

from framesift.llm.common import connected_components


def test_unsettled_components_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, rounds=1)
