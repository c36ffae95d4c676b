from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallydesk import rules, schemas
from tallydesk.operators import insights
from tallydesk.plans.skew import Spread

NOW = datetime(2026, 7, 14, 12, 0)


def ticket(number, account, subject="", description="", status="open", age=10, resolution=None):
    created = None if age is None else NOW - timedelta(minutes=age)
    return (f"T-{number}", account, subject, description, status, created, created, resolution)


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [
        ("ACCT-001", "Alder", "Enterprise"),
        ("ACCT-003", "Birch", "Growth"),
        ("ACCT-004", "Cedar", "Mystery"),
        ("ACCT-005", "Dogwood", "Standard"),
    ]
    return spark.createDataFrame(rows, schemas.ACCOUNTS)


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [
        ticket(1, "ACCT-001", "outage", age=20),
        ticket(2, "ACCT-003", "csv upload fails", age=200),
        ticket(3, "ACCT-003", "where is my pickup", age=10),
        ticket(4, "ACCT-004", "security", age=10_000),
        ticket(5, "ACCT-999", "late pickup", age=10_000),
        ticket(6, "ACCT-005", "hello", status="closed", resolution="refunded"),
        ticket(7, "ACCT-005", "hello", age=None),
        ticket(8, None, "csv", age=5),
        ticket(9, None, "csv", age=5),
        ticket(10, "ACCT-005", "hello", status="Open", resolution="ask again"),
    ]
    return spark.createDataFrame(rows, schemas.TICKETS)


@pytest.fixture(scope="module")
def found(spark, tickets, accounts):
    return insights.ticket_insights(tickets, accounts, insights.contract_sla_table(spark), NOW)


def by_ticket(df, column):
    return {row["ticket_id"]: row[column] for row in df.collect()}


def test_columns_and_order(found):
    assert tuple(found.columns) == insights.INSIGHT_COLUMNS
    statuses = [row["sla_status"] for row in found.collect()]
    assert statuses == sorted(statuses, key=rules.SLA_STATUS_RANK.get)
    assert [row["ticket_id"] for row in found.collect()][:2] == ["T-1", "T-2"]


def test_only_open_tickets(found):
    assert set(by_ticket(found, "subject")) == {"T-1", "T-2", "T-3", "T-4", "T-5", "T-7", "T-8", "T-9"}


def test_targets(found):
    targets = by_ticket(found, "sla_target_minutes")
    assert targets["T-1"] == 15  # contract before plan
    assert targets["T-2"] == 240 and targets["T-3"] == 2880
    assert targets["T-4"] is None  # unknown plan
    assert targets["T-5"] is None  # unknown account


def test_status_and_age(found):
    status, age = by_ticket(found, "sla_status"), by_ticket(found, "age_minutes")
    assert status["T-1"] == "BREACHED" and age["T-1"] == 20.0
    assert status["T-2"] == "NEAR BREACH"
    assert status["T-4"] == status["T-5"] == status["T-7"] == "OK"
    assert age["T-7"] is None


def test_several_open_tickets(found):
    flags = by_ticket(found, "multiple_open_tickets_same_account")
    assert flags["T-2"] is flags["T-3"] is True
    assert flags["T-1"] is flags["T-5"] is flags["T-7"] is False
    assert flags["T-8"] is flags["T-9"] is False  # no account at all


def test_a_copied_account_doubles_its_tickets(spark, tickets, accounts):
    doubled = accounts.unionByName(accounts.filter("account_id = 'ACCT-001'"))
    got = insights.ticket_insights(tickets, doubled, insights.contract_sla_table(spark), NOW)
    mine = got.filter("ticket_id = 'T-1'").collect()
    assert len(mine) == 2 and all(row["multiple_open_tickets_same_account"] for row in mine)


def test_hot_accounts_change_nothing(spark, tickets, accounts, found):
    spread = insights.ticket_insights(
        tickets, accounts, insights.contract_sla_table(spark), NOW, spread=Spread(rows_per_slot=1)
    )
    assert sorted(map(str, tuples(spread))) == sorted(map(str, tuples(found)))


def test_contradicting_contract_keeps_the_tightest_target(spark, tickets, accounts):
    rows = [("ACCT-001", "P1", 50), ("ACCT-001", "P1", 40)]
    contract = spark.createDataFrame(rows, "account_id string, severity string, minutes int")
    got = insights.ticket_insights(tickets, accounts, contract, NOW)
    assert by_ticket(got, "sla_target_minutes")["T-1"] == 40
    assert got.count() == 8


def test_empty_input_keeps_its_schema(spark, tickets, accounts, found):
    none = insights.ticket_insights(tickets.limit(0), accounts, insights.contract_sla_table(spark), NOW)
    assert none.schema.names == found.schema.names and none.count() == 0
    assert insights.known_issue_clusters(none).count() == 0


def test_account_columns_with_a_taken_name(spark, tickets, accounts):
    got = insights.with_accounts(tickets, accounts.withColumn("status", F.lit("active")))
    row = got.filter("ticket_id = 'T-1'").first()
    assert row["status"] == "open" and row["status_account"] == "active" and row["plan"] == "Enterprise"
    assert got.count() == 10
    assert got.filter("ticket_id = 'T-5'").first()["plan"] is None


def test_ticket_plan_goes_before_account_plan(spark, tickets, accounts):
    own = tickets.withColumn("plan", F.lit("Standard"))
    got = insights.ticket_insights(own, accounts, insights.contract_sla_table(spark), NOW)
    assert by_ticket(got, "sla_target_minutes")["T-2"] == 1440


def test_clusters(found):
    got = tuples(insights.known_issue_clusters(found))
    upload, pickup = (name for name, _ in rules.ISSUE_KEYWORDS)
    assert got == [
        (upload, 0, "T-2, T-8, T-9", "Birch", 3),
        (pickup, 0, "T-3, T-5", "Birch", 2),
    ]


def test_cluster_pages_are_the_whole_list(found):
    whole = {row["known_issue_match"]: row for row in insights.known_issue_clusters(found).collect()}
    paged = {}
    for row in insights.known_issue_clusters(found, page_size=1).orderBy("known_issue_match", "page").collect():
        paged.setdefault(row["known_issue_match"], []).append(row)
        assert row["ticket_count"] == whole[row["known_issue_match"]]["ticket_count"]
    for issue, rows in paged.items():
        assert ", ".join(row["affected_tickets"] for row in rows) == whole[issue]["affected_tickets"]
        names = [row["affected_accounts"] for row in rows if row["affected_accounts"]]
        assert ", ".join(names) == whole[issue]["affected_accounts"]


def test_review_queue_takes_any_status_unless_told(tickets):
    assert {row["ticket_id"] for row in insights.resolution_review_queue(tickets).collect()} == {"T-6", "T-10"}
    closed = insights.resolution_review_queue(tickets, closed_only=True)
    assert tuples(closed) == [("T-6", "ACCT-005", "hello", "refunded")]


def test_stateless_steps_accept_a_stream(spark, tickets, tmp_path):
    """Severity, issue and age are column expressions; they run on a stream of tickets as well."""
    from tallydesk.functions.clock import rounded_minutes_between, snapshot_column

    tickets.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.TICKETS).parquet(str(tmp_path / "in"))
    tagged = insights.open_tickets(stream).select(
        "ticket_id",
        insights.severity_of(F.col("subject"), F.col("description")).alias("severity"),
        rounded_minutes_between(F.col("created_at"), snapshot_column(NOW)).alias("age"),
    )
    query = (
        tagged.writeStream.format("memory").queryName("tagged_tickets")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {row["ticket_id"]: (row["severity"], row["age"]) for row in spark.table("tagged_tickets").collect()}
    assert got["T-1"] == ("P1", 20.0) and len(got) == 8
