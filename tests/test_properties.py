"""Properties that hold for any input, on data made up by hypothesis."""

import re
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallydesk import rules, schemas
from tallydesk.functions.text import sections
from tallydesk.operators import actions, insights, lookup, search
from tallydesk.plans.skew import Spread

few = hypothesis_settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
NOW = datetime(2026, 7, 14, 12, 0)
ACCOUNT = st.sampled_from(["A", "B", "C", None])
WORDS = st.lists(st.sampled_from("refund parcel late upload csv outage pickup".split()), max_size=6).map(" ".join)

tickets = st.lists(
    st.tuples(ACCOUNT, WORDS, st.sampled_from(["open", "closed"]), st.integers(-100, 5000)), max_size=30
)


@few
@given(st.lists(st.sampled_from(["\n", " ", "1. A", "2. B b", "x", "12.C", "é"]), max_size=25).map("".join))
def test_sections_lose_nothing_but_white_space(spark, text):
    parts = spark.range(1).select(sections(F.lit(text)).alias("s")).first()["s"]
    squeeze = lambda value: re.sub(r"\s+", "", value)
    assert squeeze("".join(part["text"] for part in parts)) == squeeze(text)
    if text.strip():
        assert all(part["section"] == part["text"].split("\n")[0].strip() for part in parts)


@few
@given(tickets)
def test_insights_and_clusters_account_for_every_open_ticket(spark, rows):
    frame = spark.createDataFrame(
        [
            (f"T-{n:03}", account, words, None, status, NOW - timedelta(minutes=age), None, None)
            for n, (account, words, status, age) in enumerate(rows)
        ],
        schemas.TICKETS,
    )
    accounts = spark.createDataFrame([("A", "Acme", "Growth"), ("B", "Birch", None)], schemas.ACCOUNTS)
    found = insights.ticket_insights(
        frame, accounts, insights.contract_sla_table(spark), NOW, spread=Spread(rows_per_slot=3)
    ).collect()
    opened = [f"T-{n:03}" for n, row in enumerate(rows) if row[2] == "open"]
    assert sorted(row["ticket_id"] for row in found) == opened
    for row in found:
        same = [r for r in found if r["account_id"] == row["account_id"] and r["account_id"] is not None]
        assert row["multiple_open_tickets_same_account"] == (len(same) > 1)
        if row["sla_target_minutes"] is None:
            assert row["sla_status"] == "OK"
    again = spark.createDataFrame(found, _INSIGHTS)
    clusters = insights.known_issue_clusters(again, page_size=2).collect()
    tagged = [row for row in found if row["known_issue_match"]]
    assert sum(row["ticket_count"] for row in clusters if row["page"] == 0) == len(tagged)
    assert sum(len(row["affected_tickets"].split(", ")) for row in clusters) == len(tagged)


_INSIGHTS = (
    "ticket_id string, account_id string, account_name string, subject string, inferred_severity string, "
    "age_minutes double, sla_target_minutes int, sla_status string, known_issue_match string, "
    "multiple_open_tickets_same_account boolean"
)

chunks = st.lists(
    st.tuples(WORDS, st.sampled_from(["contract", "policy", None]), st.sampled_from(["A", "B", None])),
    min_size=1,
    max_size=12,
)


@few
@given(chunks, st.lists(st.tuples(WORDS, st.sampled_from(["A", "B", None])), min_size=1, max_size=4))
def test_no_hit_shows_a_foreign_contract(spark, texts, asked):
    frame = spark.createDataFrame(
        [(n, words, f"{n}", kind, "current", owner, "s") for n, (words, kind, owner) in enumerate(texts)],
        "chunk_ord bigint, text string, title string, doc_type string, status string, account_id string, section string",
    )
    queries = spark.createDataFrame(
        [(f"{n}", words, account) for n, (words, account) in enumerate(asked)],
        "query_id string, query_text string, account_id string",
    )
    hits = search.search(search.build_index(frame, []), queries, k=3).collect()
    for hit in hits:
        words, kind, owner = texts[int(hit["source"])]
        query_words, caller = asked[int(hit["query_id"])]
        assert kind != "contract" or owner == caller
        assert 0 < hit["relevance"] <= 1.0
        assert set(words.split()) & set(query_words.split())
    assert all(sum(h["query_id"] == f"{n}" for h in hits) <= 3 for n in range(len(asked)))


requests = st.lists(
    st.tuples(
        ACCOUNT,
        st.sampled_from(["account", "orders", "tickets", "invoices"]),
        st.sampled_from(["", "O-0", "O-1", "O-7", None]),
    ),
    min_size=1,
    max_size=15,
)


@few
@given(requests, st.lists(ACCOUNT, max_size=6), st.sampled_from([2, 100]))
def test_lookups_answer_every_request_with_own_records(spark, asked, owners, rows_per_slot):
    wanted = spark.createDataFrame(
        [(f"r{n}", *row) for n, row in enumerate(asked)],
        "request_id string, account_id string, table_name string, record_id string",
    )
    orders = spark.createDataFrame(
        [(f"O-{n}", owner, "BOOKED", NOW, None, None, None, None) for n, owner in enumerate(owners)], schemas.ORDERS
    )
    accounts = spark.createDataFrame([("A", "Acme", "Growth")], schemas.ACCOUNTS)
    none = spark.createDataFrame([], schemas.TICKETS)
    limits = lookup.LookupLimits(spread=Spread(rows_per_slot))
    answers = lookup.lookup(wanted, accounts, orders, none, NOW, limits=limits).collect()
    assert {row["request_id"] for row in answers} == {f"r{n}" for n in range(len(asked))}
    for n, (account, table, record) in enumerate(asked):
        mine = [row for row in answers if row["request_id"] == f"r{n}"]
        if table == "orders" and not record:
            assert len([r for r in mine if r["result"]]) == (owners.count(account) if account else 0)
        for row in mine:
            assert not (row["result"] and row["error"])
            if table == "orders" and row["result"]:
                assert f'"account_id":"{account}"' in row["result"]


@few
@given(
    st.lists(
        st.tuples(
            st.sampled_from(rules.ACTION_TYPES + ("refund", None)),
            st.sampled_from(["why", None]),
            st.sampled_from(rules.SEVERITIES + ("P9", None)),
            st.sampled_from(["confirmed", "cancelled", None]),
        ),
        min_size=1,
        max_size=20,
    )
)
def test_the_ledger_has_one_row_per_proposal(spark, rows):
    proposals = spark.createDataFrame(
        [(f"p{n}", "c", n, 0, kind, None, reason, severity) for n, (kind, reason, severity, _) in enumerate(rows)],
        schemas.PROPOSALS,
    )
    decisions = spark.createDataFrame(
        [(f"p{n}", row[3]) for n, row in enumerate(rows) if row[3]], schemas.DECISIONS
    )
    ledger = {row["proposal_id"]: row for row in actions.action_ledger(proposals, decisions).collect()}
    assert len(ledger) == len(rows)
    for n, row in enumerate(rows):
        assert (ledger[f"p{n}"]["action_id"] is not None) == (row[3] == "confirmed")
        assert ledger[f"p{n}"]["valid"] == (not ledger[f"p{n}"]["violations"])
