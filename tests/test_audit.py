import pytest

from conftest import tuples
from tallydesk import schemas
from tallydesk.operators import audit


def call(ident, name, arguments):
    return (ident, "function", (name, arguments))


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        ("c", 1, "user", "where is it?", None, None),
        ("c", 2, "assistant", None, [call("a", "search_documents", '{"query": "x"}'), call("b", "propose_action", "")], None),
        ("c", 3, "tool", '{"results": []}', None, "a"),
        ("c", 4, "tool", '{"status": "staged"}', None, "b"),
        ("c", 5, "assistant", "done", None, None),
        ("d", 1, "assistant", "hm", [call("a", "structured_data_lookup", '{"table":')], None),
        ("d", 2, "assistant", "hm", [call("z", "structured_data_lookup", "{}")], None),
        ("d", 3, "tool", "first", None, "z"),
        ("d", 4, "tool", "second", None, "z"),
    ]
    return spark.createDataFrame(rows, schemas.MESSAGES)


def test_calls_in_order(messages):
    got = audit.tool_calls(messages).orderBy("conv_id", "turn", "call_ord")
    assert tuples(got, "conv_id", "turn", "call_ord", "tool_call_id", "said") == [
        ("c", 2, 0, "a", ""),
        ("c", 2, 1, "b", ""),
        ("d", 1, 0, "a", "hm"),
        ("d", 2, 0, "z", "hm"),
    ]


def test_results_pair_within_their_conversation(messages):
    got = audit.tool_call_audit(audit.tool_calls(messages), audit.tool_results(messages))
    rows = {(row["conv_id"], row["tool_call_id"]): row for row in got.collect()}
    assert rows["c", "a"]["result"] == '{"results": []}'
    assert rows["c", "b"]["input"] == "{}" and rows["c", "b"]["arguments_valid"]
    assert rows["d", "a"]["result"] is None and not rows["d", "a"]["arguments_valid"]
    assert rows["d", "z"]["result"] == "second"  # the last answer holds


def test_outcome_replaces_the_staged_result(spark, messages):
    outcome = spark.createDataFrame([("c", "b", '{"status": "created"}')], "conv_id string, tool_call_id string, result string")
    got = audit.tool_call_audit(audit.tool_calls(messages), audit.tool_results(messages), outcome)
    rows = {(row["conv_id"], row["tool_call_id"]): row["result"] for row in got.collect()}
    assert rows["c", "b"] == '{"status": "created"}' and rows["c", "a"] == '{"results": []}'


def test_repeated_outcomes_multiply_nothing(spark, messages):
    outcome = spark.createDataFrame(
        [("c", "b", "1"), ("c", "b", "2")], "conv_id string, tool_call_id string, result string"
    )
    got = audit.tool_call_audit(audit.tool_calls(messages), audit.tool_results(messages), outcome)
    assert [row["result"] for row in got.collect() if row["tool_call_id"] == "b"] == ["2"]


def test_the_last_answer_of_a_turn_goes_by_its_place(spark):
    rows = [("c", 1, "tool", "z", None, "a", 1), ("c", 1, "tool", "b", None, "a", 2)]
    schema = schemas.MESSAGES.simpleString()[:-1] + ",message_ord:bigint>"
    placed = spark.createDataFrame(rows, schema)
    assert tuples(audit.tool_results(placed)) == [("c", "a", "b")]
    assert tuples(audit.tool_results(placed.drop("message_ord"))) == [("c", "a", "z")]


def test_trace_and_open_calls(messages):
    calls, results = audit.tool_calls(messages), audit.tool_results(messages)
    trace = audit.tool_trace(audit.tool_call_audit(calls, results))
    assert sorted(tuples(trace, "conv_id", "tool")) == [
        ("c", "propose_action"), ("c", "search_documents"), ("d", "structured_data_lookup"),
    ]
    assert tuples(audit.unanswered_calls(calls, results), "conv_id", "tool_call_id") == [("d", "a")]
