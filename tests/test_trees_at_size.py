"""Trees are much larger than the files they come from: they are made once, in many tasks, and never broadcast."""

import pytest
from pyspark.sql import functions as F

from stratadiff.operators import code, syntax
from stratadiff.plans import graph_queries


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.range(60).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize(("name", "scans"), [("functions_of_texts", 2), ("statements_around", 1), ("names_in_ranges", 1), ("function_by_name", 1)])
def test_plans(spark, parts, name, scans):
    plan = getattr(graph_queries, name)(spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInPandas") == scans


def test_tasks(spark, parts):
    s = graph_queries._scripts(spark, parts)
    for rows in (syntax.syntax(s, ["p_partkey"], "js"), code.functions(s, ["p_partkey"], "c", "c")):
        assert rows.select(F.spark_partition_id()).distinct().count() > 8


def test_rows_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(syntax, "ROWS", 7)
    files = spark.createDataFrame([(i, "a;" * 5) for i in range(9)] + [(9, None), (10, "")], "id long, code string").coalesce(1)
    got = {r["id"]: r["n"] for r in syntax.syntax(files, ["id"], "code").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {**dict.fromkeys(range(9), 11), 10: 1}


def test_a_function_that_a_function_returns(spark):
    """One node in two roles; and the function around each node."""
    files = spark.createDataFrame([(0, "const f = () => { return function g(a) { return a + 1; }; };\n({ k: x => { return 1; return; } });")], "id long, code string")
    nodes = syntax.syntax(files, ["id"], "code")
    got = sorted((r.name, r.params, r.ret) for r in syntax.functions(files, ["id"], "code", nodes.where("first_line = 2").unionByName(nodes.where("first_line = 1"))).collect())
    assert got[-1] == ("k", "x", "1") and len(got) == 2
    name = {r.node: r.kind for r in nodes.where("kind LIKE '%function%'").collect()}
    assert {name.get(r.inside) for r in nodes.where("kind = 'number' AND first_line = 1").collect()} == {"function_expression"}
