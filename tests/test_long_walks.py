"""A walk through history is whole or an error."""

import inspect

import pytest

from stratadiff.operators import graphs


def test_no_walk_ends_early(spark):
    steps = spark.createDataFrame([("r", f"c{i}", 1, f"c{i + 1}", 1) for i in range(4)], "repo string, from_commit string, from_line int, commit_id string, line_no int")
    start = spark.createDataFrame([("r", "c0", 1)], "repo string, commit_id string, line_no int")
    with pytest.raises(ValueError):
        graphs.walk_back(start, steps, ["repo"], most=2)
    assert graphs.walk_back(start, steps, ["repo"], most=4).count() == graphs.walk_back(start, steps, ["repo"]).count() == 5
    assert inspect.signature(graphs.walk_back).parameters["most"].default is None
