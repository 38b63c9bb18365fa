"""What keeps queries within their limits on large tables, read off their plans on the smallest ones."""

import pytest

from graphloom import plans
from graphloom.plans import extraction_queries as eq
from graphloom.plans import medical_queries as mq
from graphloom.plans import quality_queries as qq
from graphloom.plans import trade

DATA = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, most", [("qa_rejects", 5), ("qa_final_edges", 2), ("qa_summary", 2), ("qa_prune_keep", 3), ("qa_prune_reject", 3)])
def test_ends_are_looked_up_once(spark, name, most):
    assert optimized(plans.queries()[name](spark, DATA)).count("Join LeftOuter") <= most


@pytest.mark.parametrize("name", ["qa_edges_clean", "qa_edge_reasons"])
def test_edges_that_reject_themselves_are_not_joined(spark, name):
    judged = qq.judged_edges(spark, DATA)
    own = judged.filter("reason in ('invalid_relationship_type', 'invalid_confidence', 'low_confidence')")
    assert own.filter("src_label is not null or new_src is not null").count() == 0 < own.count()
    assert "Union" in optimized(plans.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["kg_edges", "qa_edges_clean"])
def test_edges_are_not_combined_before_they_are_shuffled(spark, name):
    plan = physical(plans.queries()[name](spark, DATA))
    assert plan.index("partial_min") < plan.index("REPARTITION_BY_COL")  # the plan is printed from its end


@pytest.mark.parametrize("column, ids, bought", [("dst", ["Nation:1", "Region:0"], False), ("src", ["Supplier:1", "Nation:2"], False), ("src", ["Customer:7", "Customer:8"], True), ("dst", ["Part:1", "Nation:3"], True), ("src", [], False), ("dst", ["none"], False)])
def test_edges_at_few_nodes(spark, column, ids, bought):
    near = trade.edges_at(spark, DATA)(column, ids)
    whole = trade.edges(spark, DATA)
    assert sorted(map(tuple, near.collect()), key=repr) == sorted(map(tuple, whole.filter(whole[column].isin(ids)).collect()), key=repr)
    assert ("Join" in optimized(near)) == bought
    assert "SortMergeJoin" not in physical(near)


@pytest.mark.parametrize("name", ["page_security", "page_documents"])
def test_pages_come_to_python_a_few_at_a_time(spark, name):
    plan = physical(plans.queries()[name](spark, DATA))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("make", [mq.names, eq.medical_documents])
def test_made_rows_are_dealt_over_the_cores(spark, make):
    assert make(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
