"""What the plans must and must not contain."""

import pytest

import __spark_entry__ as entry_points
from conftest import SMALL, plan_of
from tallydesk.operators import insights, lookup, search
from workload import catalog
from workload.catalog import SNAPSHOT
from workload.views import Tables

PLAIN = sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", PLAIN)
def test_everything_stays_in_the_jvm_without_cross_joins(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, SMALL))
    for operator in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_account_filter_reaches_the_scan(spark):
    orders = lookup.enrich_orders(Tables(spark, SMALL).v_orders, SNAPSHOT).filter("account_id = 7")
    assert "EqualTo(o_custkey,7)" in plan_of(orders)


def test_unused_columns_are_not_read(spark):
    tables = Tables(spark, SMALL)
    queue = insights.resolution_review_queue(tables.v_tickets).select("ticket_id")
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan_of(queue)


def test_tickets_are_shuffled_once_for_insights(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    tables = Tables(spark, SMALL)
    found = insights.ticket_insights(
        tables.v_tickets, tables.v_accounts, tables.v_contract_sla, SNAPSHOT, ordered=False
    )
    plan = found._jdf.queryExecution().simpleString()
    # One scan, and so one exchange, carries the text of tickets; the others carry counts.
    whole = [line for line in plan.splitlines() if "FileScan" in line and "props" in line]
    assert len(whole) == 1
    assert "Window" not in plan


def test_only_marked_sides_are_broadcast(spark, settings):
    """With automatic broadcasts off, what is left is bounded: hot keys, frequent terms, query terms, hits."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    tables = Tables(spark, SMALL)
    joined = insights.with_accounts(tables.v_tickets, tables.v_accounts)
    plan = joined._jdf.queryExecution().simpleString()
    assert plan.count("BroadcastHashJoin") == 2  # hot keys, once per side
    assert "SortMergeJoin" in plan
    # What bounds the hot keys is their share of all rows, not a limit.
    assert "ubquery" in plan and "Limit" not in plan


def test_ledger_ids_need_no_random_numbers(spark):
    plan = plan_of(entry_points.queries()["action_ledger"](spark, SMALL))
    assert "uuid" not in plan and "rand(" not in plan


def test_norms_split_texts_into_words_once(spark):
    """The counts are written before document frequencies, their total, frequent and rare words are read from them."""
    assert "regexp_extract_all" not in plan_of(catalog.QUERIES["index_norms"](spark, SMALL))


def test_words_are_counted_outside_of_lambdas(spark):
    chunks = spark.createDataFrame([(1, "the refund of the refund", "sop", None)], "chunk_ord long, text string, doc_type string, account_id string")
    vectors = search.term_vectors(chunks, ["the", "of"])
    plan = plan_of(vectors)
    assert "arrays_zip" in plan and "array_sort(" not in plan and "named_struct" not in plan
    assert [tuple(word) for word in vectors.first()["words"]] == [("refund", 2)]
