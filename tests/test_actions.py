import pytest

from conftest import tuples
from tallydesk import schemas
from tallydesk.operators import actions

PROPOSALS = [
    ("p1", "c1", 1, 2, "create_escalation", "T-1", "late", "P1"),
    ("p2", "c1", 1, 1, "create_followup_task", "T-1", "check", None),
    ("p3", "c1", 2, 1, "create_followup_task", None, "check", "P2"),
    ("p4", "c2", 1, 1, "refund", None, None, "P9"),
    ("p5", "c2", 2, 1, None, None, "why", None),
]


@pytest.fixture(scope="module")
def proposals(spark):
    return spark.createDataFrame(PROPOSALS, schemas.PROPOSALS)


def ledger(spark, proposals, *decisions):
    got = actions.action_ledger(proposals, spark.createDataFrame(list(decisions), schemas.DECISIONS))
    return {row["proposal_id"]: row for row in got.collect()}


def test_only_confirmed_actions_are_created(spark, proposals):
    got = ledger(spark, proposals, ("p3", "confirmed"), ("p2", "cancelled"), ("p4", "confirmed"), ("p5", None))
    assert {key: row["status"] for key, row in got.items()} == {
        "p1": "awaiting_user_confirmation",
        "p2": "declined_by_user",
        "p3": "created",
        "p4": "created",
        "p5": "awaiting_user_confirmation",
    }
    assert {key for key, row in got.items() if row["action_id"]} == {"p3", "p4"}
    assert got["p3"]["action_id"].startswith("ACT-") and len(got["p3"]["action_id"]) == 20
    assert got["p2"]["severity_label"] == "" and got["p1"]["severity_label"] == "P1"


def test_only_the_first_proposal_of_a_turn_is_put_to_the_user(spark, proposals):
    """p2 is called before p1 in the same turn: p1 is never created, whatever is decided of it."""
    got = ledger(spark, proposals, ("p1", "confirmed"), ("p2", "confirmed"))
    assert {key for key, row in got.items() if row["is_asked"]} == {"p2", "p3", "p4", "p5"}
    assert got["p1"]["status"] == "awaiting_user_confirmation" and got["p1"]["action_id"] is None
    assert got["p2"]["status"] == "created"


def test_a_decision_of_a_later_turn_comes_too_late(spark, proposals):
    made = [("p2", "confirmed", 2), ("p3", "confirmed", 2), ("p4", "confirmed", None), ("p5", "cancelled", 2)]
    decisions = spark.createDataFrame(made, "proposal_id string, decision string, turn int")
    got = {row["proposal_id"]: row["status"] for row in actions.action_ledger(proposals, decisions).collect()}
    assert got["p2"] == got["p4"] == "awaiting_user_confirmation"
    assert got["p3"] == "created" and got["p5"] == "declined_by_user"


def test_calls_in_the_same_place_go_by_their_id(spark):
    rows = [(f"p{n}", "c", 1, 1, "create_followup_task", None, "why", None) for n in (3, 1, 2)]
    frame = spark.createDataFrame(rows, schemas.PROPOSALS)
    got = ledger(spark, frame, ("p1", "confirmed"), ("p2", "confirmed"))
    assert [key for key, row in got.items() if row["is_asked"]] == ["p1"]
    assert tuples(actions.first_proposal_per_turn(frame), "proposal_id") == [("p1",)]


def test_ids_are_the_same_on_every_run(spark, proposals):
    first = ledger(spark, proposals, ("p2", "confirmed"))
    second = ledger(spark, proposals.repartition(5), ("p2", "confirmed"))
    assert first["p2"]["action_id"] == second["p2"]["action_id"] is not None
    short = actions.action_ledger(
        proposals, spark.createDataFrame([("p2", "confirmed")], schemas.DECISIONS), id_digits=6
    )
    assert len(short.filter("action_id IS NOT NULL").first()["action_id"]) == 10


def test_contradicting_decisions_create_nothing(spark, proposals):
    got = ledger(spark, proposals, ("p2", "confirmed"), ("p2", "cancelled"))
    assert len(got) == 5 and got["p2"]["status"] == "declined_by_user"


def test_other_words_decide_nothing(spark, proposals):
    got = ledger(spark, proposals, ("p2", "confirmed"), ("p2", "Approved?"))
    assert got["p2"]["status"] == "created" and got["p2"]["action_id"]


def test_violations(proposals):
    got = {row["proposal_id"]: (row["valid"], row["violations"]) for row in actions.proposal_validation(proposals).collect()}
    assert got == {
        "p1": (True, []),
        "p2": (True, []),
        "p3": (False, ["severity_without_escalation"]),
        "p4": (
            False,
            ["unknown_action_type", "missing_reason", "unknown_severity", "severity_without_escalation"],
        ),
        "p5": (False, ["unknown_action_type"]),
    }


def test_first_proposal_of_a_turn(proposals):
    got = actions.first_proposal_per_turn(proposals)
    assert sorted(tuples(got, "conv_id", "turn", "proposal_id")) == [
        ("c1", 1, "p2"), ("c1", 2, "p3"), ("c2", 1, "p4"), ("c2", 2, "p5"),
    ]
