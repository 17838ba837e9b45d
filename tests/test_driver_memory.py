"""Joins of tables that grow with the input are never broadcast by the size of their compressed files."""

import re

import pytest

from folioweave.operators.questions import question_entities
from folioweave.plans import catalog
from folioweave.session import stage

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}  # by files, not by measured sizes
#: Together these make every step of both retrievals; the other queries stop earlier on the same way.
WHOLE = ("c1_merge_keys", "c1_assign_keys", "c1_format_context", "c2_result", "eval_c1", "eval_c2")


@pytest.fixture
def by_files(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_runs_of_words_are_not_broadcast(by_files, tmp_path):
    by_files.createDataFrame([(1, "b", "one two three four five six seven")], "qid int, book_id string, question string").write.parquet(f"{tmp_path}/q")
    by_files.createDataFrame([("b", "c", "two three")], "book_id string, chunk_id string, entity string").write.parquet(f"{tmp_path}/m")
    found = question_entities(by_files.read.parquet(f"{tmp_path}/q"), by_files.read.parquet(f"{tmp_path}/m"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.qid, r.entity, r.pos) for r in found.collect()] == [(1, "two three", 1)]


@pytest.mark.parametrize("name", WHOLE)
def test_no_join_is_broadcast(by_files, sf, name):
    store, bus = by_files._jsparkSession.sharedState().statusStore(), by_files.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = max([-1, *(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))])
    catalog.queries()[name](by_files, sf).write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [r.physicalPlanDescription() for i in range(runs.size()) if (r := runs.apply(i)).executionId() > before]
    assert plans and not [x for p in plans for x in re.findall(r"BroadcastHashJoin[^\n]*\n.*\n.*", p)]


def test_stage_leaves_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    assert sorted(r.n for r in stage(spark.range(9).selectExpr("id % 3 AS n").distinct(), "n").collect()) == [0, 1, 2]
    assert spark.conf.get(key, None) == before


def test_the_pool_is_searched_once(spark, sf):
    plan = catalog.queries()["c1_assign_keys"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsIn" not in plan  # the search was written before its rows are joined with entities
