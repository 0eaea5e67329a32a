"""Every registered query against the SQL oracle, on the smallest tables."""

import pytest
from compare import same_rows

from millrace.registry import all_oracles, all_queries


@pytest.mark.parametrize("key", sorted(all_oracles()))
def test_oracle(spark, duck, small, key):
    same_rows(all_queries()[key](spark, small), duck.sql(all_oracles()[key]))


@pytest.mark.parametrize("key", sorted(set(all_queries()) - set(all_oracles())))
def test_rows_only(spark, small, key):
    assert all_queries()[key](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.l_returnflag for r in e.entry(spark).collect()} <= {"A", "N", "R"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_facts(spark, small):
    from millrace.sources.tables import table

    n, r = table(spark, small, "nation"), table(spark, small, "region")
    joined = n.join(r, n.n_regionkey == r.r_regionkey)
    assert joined.count() == 25
    assert joined.where("r_name = 'AFRICA'").count() == 5
    assert sorted(x["count"] for x in n.groupBy("n_regionkey").count().collect()) == [5] * 5


def test_plan_shapes(spark, small):
    from millrace.plans.statements import explain_plan

    q = all_queries()
    plan = explain_plan(q["tpch_q03"](spark, small))
    assert "Join" in plan and "Exchange" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = explain_plan(q["tpch_q06"](spark, small))
    assert "PushedFilters" in plan and "l_comment" not in plan and "HashAggregate" in plan
    assert "TakeOrderedAndProject" in explain_plan(q["topk"](spark, small))
    assert "WindowGroupLimit" in explain_plan(q["window_topn"](spark, small))
    assert "ShuffledHashJoin" in explain_plan(q["join_hint_hash"](spark, small))
    assert "SortMergeJoin" in explain_plan(q["join_hint_merge"](spark, small))


def test_not_in_with_nulls_keeps_nothing(spark, small):
    assert all_queries()["subq_not_in_null"](spark, small).count() == 0


@pytest.mark.parametrize("key", ["sort_desc", "sort_nulls", "sort_nulls_last", "sort_expr", "sort_ordinal", "sort_multi"])
def test_whole_sorts_keep_every_row_in_order(spark, duck, small, key):
    """Row by row, in order."""
    ours = [tuple(r) for r in all_queries()[key](spark, small).collect()]
    assert ours == duck.sql(all_oracles()[key]).fetchall() and "LIMIT" not in all_oracles()[key]
    if "nulls" in key:
        assert len({r[0] is None for r in ours}) == 2


@pytest.mark.parametrize("key", ["subq_not_in", "subq_not_in_null", "tpch_q16"])
def test_not_in_shuffles_where_broadcasts_are_off(spark, small, key):
    from millrace.plans.statements import explain_plan

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explain_plan(all_queries()[key](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "Broadcast" not in plan and "Cartesian" not in plan
