"""How work spreads: texts made from few bytes of keys are dealt over tasks, whatever the table's files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, quality, seams
from loomgraph.plans import source_catalogue
from loomgraph.plans.stored_catalogue import texts
from loomgraph.sources.projection import Graph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", ["py_files", "c_files", "java_files", "command_files"])
def test_texts_are_dealt_over_tasks(spark, name):
    assert source_catalogue
    g = Graph(spark, DATA)
    made = texts(g, name)
    assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism > g.table("part").rdd.getNumPartitions()
    assert made.count() == g.table("part").count()


def test_links_of_one_file_are_dealt_over_tasks(spark):
    """The accesses are few bytes, so one task made all pairs."""
    accesses = spark.range(400).selectExpr("concat('E', id % 3) as env_name", "case when id = 7 then null when id = 8 then 'none' else 'hot' end as file").coalesce(1)
    surfaces = spark.range(50).selectExpr("'hot' as file", "concat('S', id) as surface")
    got = seams.link(accesses, surfaces)
    assert got.count() == 398 * 50 + 2 and got.filter("surface is null").count() == 2
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= 4 * spark.sparkContext.defaultParallelism and max(per) < sum(per) / 4


def test_equal_accesses_meet_surfaces_once(spark, monkeypatch):
    """What is shuffled was as large as the accesses, and each row of the result was joined by itself."""
    monkeypatch.setattr(seams, "COPIES", 64)
    accesses = spark.range(3000).selectExpr("concat('E', id % 2) as env_name", "case id % 3 when 0 then null when 1 then 'none' else 'hot' end as file")
    surfaces = spark.createDataFrame([("hot", "S1"), ("hot", "S2"), ("hot", "S2"), ("other", "S3")], "file string, surface string")
    got = seams.link(accesses, surfaces)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and plan.index("Generate") < plan.index("Repartition") < plan.index("Join")
    want = {(e, f, s): 500 * n for e in ("E0", "E1") for f, s, n in ((None, None, 1), ("none", None, 1), ("hot", "S1", 1), ("hot", "S2", 2))}
    assert {(r.env_name, r.file, r.surface): r["count"] for r in got.groupBy("env_name", "file", "surface").count().collect()} == want


def test_tasks_follow_the_rows(spark):
    dealt = graph.in_bounded_tasks(spark.range(1000), "id", most=10)
    assert dealt.rdd.getNumPartitions() == 100 and dealt.count() == 1000
    assert graph.in_bounded_tasks(spark.range(0), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_of_commit_and_file_are_dealt_before_they_are_counted(spark):
    """Map tasks held a table of nearly all their rows, and so did those after the shuffle, whatever their number."""
    commits = spark.range(3000).selectExpr("id % 700 as commit", "concat('f', id % 9) as file_uid", "id % 5 as added", "1L as deleted")
    got = quality.churn(commits)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    rows = [(x % 700, f"f{x % 9}", x % 5 + 1) for x in range(3000)]
    assert {tuple(r) for r in got.collect()} == {(f, len({c for c, g, _ in rows if g == f}), sum(n for _, g, n in rows if g == f)) for f in {g for _, g, _ in rows}}


def test_a_baseline_is_not_held_by_every_task(spark):
    """A column's few bytes in a file are far more in a table of hashes, so size on disk is no measure for a broadcast."""
    facts = spark.range(50).selectExpr("concat('P', id) as target", "'cyclomatic_complexity' as kind", "double(id) as value", "'m' as module", "'m/f' as file", "'CLASS' as symbol_kind")
    policy = {"policy_id": "p", "policy_kind": "no_worsened", "measurement_kind": "cyclomatic_complexity", "threshold": 10}
    got = quality.policy_rows([policy], facts, facts.selectExpr("target", "kind", "value - int(value % 2) as value").filter("value <> 12"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.target for r in got.filter("violates").collect()) == sorted(f"P{i}" for i in range(15, 50, 2)) and got.count() == 50
