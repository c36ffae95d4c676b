"""What open tickets need attention, and why."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallydesk import rules, schemas
from tallydesk.functions.clock import minutes_between, snapshot_column
from tallydesk.functions.text import KeywordRules, first_rule, ticket_text
from tallydesk.plans.ordered import in_order, paged_lists
from tallydesk.plans.skew import DEFAULT_SPREAD, Spread, join_to_one, key_counts

PlanSla = Mapping[str, Mapping[str, int]]

INSIGHT_COLUMNS = (
    "ticket_id",
    "account_id",
    "account_name",
    "subject",
    "inferred_severity",
    "age_minutes",
    "sla_target_minutes",
    "sla_status",
    "known_issue_match",
    "multiple_open_tickets_same_account",
)


def contract_sla_table(spark: SparkSession, contracts: PlanSla = rules.CONTRACT_SLA_MINUTES) -> DataFrame:
    """(account_id, severity, minutes) from a nested mapping."""
    rows = [
        (account, severity, minutes)
        for account, targets in contracts.items()
        for severity, minutes in targets.items()
    ]
    return spark.createDataFrame(rows, "account_id string, severity string, minutes int")


def open_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.col("status") == "open")


def severity_of(
    subject: Column,
    description: Column,
    severities: KeywordRules = rules.SEVERITY_KEYWORDS,
    default: str = rules.DEFAULT_SEVERITY,
) -> Column:
    return first_rule(ticket_text(subject, description), severities, default)


def known_issue_of(
    subject: Column, description: Column, issues: KeywordRules = rules.ISSUE_KEYWORDS
) -> Column:
    return first_rule(ticket_text(subject, description), issues)


def plan_target(plan: Column, severity: Column, plan_sla: PlanSla = rules.PLAN_SLA_MINUTES) -> Column:
    """Minutes a plan allows for a severity; the few plans are literals, so nothing is joined."""
    cases = [
        F.when((plan == name) & (severity == level), F.lit(minutes))
        for name, targets in plan_sla.items()
        for level, minutes in targets.items()
    ]
    return F.coalesce(*cases, F.lit(None).cast("int"))


def sla_status_of(age: Column, target: Column, near: float = rules.NEAR_BREACH_SHARE) -> Column:
    """Both limits are strict; an unknown age or target is OK."""
    return (
        F.when(age > target, "BREACHED").when(age > F.lit(near) * target, "NEAR BREACH").otherwise("OK")
    )


def sla_rank_of(status: Column) -> Column:
    return F.coalesce(*[F.when(status == name, F.lit(rank)) for name, rank in rules.SLA_STATUS_RANK.items()])


def _account_side(accounts: DataFrame, taken: list[str]) -> DataFrame:
    """Account columns; those whose name is taken get the suffix ``_account``."""
    return accounts.select(
        "account_id",
        *[
            F.col(name).alias(f"{name}_account" if name in taken else name)
            for name in accounts.columns
            if name != "account_id"
        ],
    )


def with_accounts(
    tickets: DataFrame, accounts: DataFrame, spread: Spread = DEFAULT_SPREAD
) -> DataFrame:
    """Tickets with the columns of their account; a ticket of an unknown account stays."""
    schemas.require(tickets, "ticket_id", "account_id", frame="tickets")
    schemas.require(accounts, "account_id", frame="accounts")
    return join_to_one(
        tickets, _account_side(accounts, tickets.columns), ["account_id"], ["ticket_id"], spread
    )


def _contract_targets(contract_sla: DataFrame, levels: list[str]) -> DataFrame:
    """One row per account, one column per severity; the tightest of contradicting targets holds."""
    return contract_sla.groupBy("account_id").agg(
        *[
            F.min(F.when(F.col("severity") == level, F.col("minutes"))).alias(f"_contract_{place}")
            for place, level in enumerate(levels)
        ]
    )


def ticket_insights(
    tickets: DataFrame,
    accounts: DataFrame,
    contract_sla: DataFrame,
    snapshot,
    severities: KeywordRules = rules.SEVERITY_KEYWORDS,
    issues: KeywordRules = rules.ISSUE_KEYWORDS,
    plan_sla: PlanSla = rules.PLAN_SLA_MINUTES,
    default_severity: str = rules.DEFAULT_SEVERITY,
    ordered: bool = True,
    spread: Spread = DEFAULT_SPREAD,
) -> DataFrame:
    """Open tickets with severity, age, SLA target and status, known issue and multi-ticket flag.

    All that is known of an account (its columns, contract targets, number of open tickets) is
    brought together first, one row each, so the tickets are shuffled once.
    """
    schemas.require(
        tickets, "ticket_id", "account_id", "subject", "description", "status", "created_at", frame="tickets"
    )
    schemas.require(accounts, "account_id", "account_name", "plan", frame="accounts")
    levels = [name for name, _ in severities] + [default_severity]
    opened = open_tickets(tickets)
    counts = key_counts(opened, ["account_id"])
    known = (
        counts.filter(F.col("account_id").isNotNull())
        .join(_account_side(accounts, tickets.columns), "account_id", "left")
        .join(key_counts(accounts, ["account_id"], "_copies"), "account_id", "left")
        .join(_contract_targets(contract_sla, levels), "account_id", "left")
        .withColumn("_many", F.col("_rows") * F.coalesce("_copies", F.lit(1)) > 1)
        .drop("_rows", "_copies")
    )
    clock = snapshot_column(snapshot)
    age = minutes_between(F.col("created_at"), clock)
    severity = F.col("inferred_severity")
    joined = (
        join_to_one(opened, known, ["account_id"], ["ticket_id"], spread, counts)
        .withColumn(
            "inferred_severity", severity_of(F.col("subject"), F.col("description"), severities, default_severity)
        )
        .withColumn("_age", age)
        .withColumn(
            "sla_target_minutes",
            F.coalesce(
                *[F.when(severity == level, F.col(f"_contract_{place}")) for place, level in enumerate(levels)],
                plan_target(F.col("plan"), severity, plan_sla),
            ),
        )
    )
    result = joined.select(
        "ticket_id",
        "account_id",
        "account_name",
        "subject",
        "inferred_severity",
        F.round("_age", 1).alias("age_minutes"),
        "sla_target_minutes",
        sla_status_of(F.col("_age"), F.col("sla_target_minutes")).alias("sla_status"),
        known_issue_of(F.col("subject"), F.col("description"), issues).alias("known_issue_match"),
        F.coalesce("_many", F.lit(False)).alias("multiple_open_tickets_same_account"),
    )
    if not ordered:
        return result
    return result.orderBy(sla_rank_of(F.col("sla_status")), "ticket_id")


def issue_tickets(insights: DataFrame) -> DataFrame:
    """One row per ticket with a known issue, with its place in the order of the cluster lists."""
    return insights.filter(F.col("known_issue_match").isNotNull()).select(
        "known_issue_match",
        sla_rank_of(F.col("sla_status")).alias("sla_rank"),
        "ticket_id",
        "account_name",
    )


def known_issue_clusters(insights: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Known issues with their tickets (by SLA status), accounts (by name) and ticket count.

    A cluster may hold a large share of all tickets, so its lists come in pages of at most
    ``page_size`` entries: one row per issue and page, a single page 0 for all but huge clusters.
    Read in order, the pages are the whole list. ``ticket_count`` counts the whole cluster.
    """
    tagged = in_order(
        issue_tickets(insights).filter(F.col("ticket_id").isNotNull()),
        "known_issue_match",
        ["sla_rank", "ticket_id"],
    )
    named = tagged.filter(F.col("account_name").isNotNull()).select("known_issue_match", "account_name")
    names = in_order(named.distinct(), "known_issue_match", ["account_name"])
    tickets = paged_lists(tagged, "known_issue_match", "ticket_id", page_size)
    accounts = paged_lists(names, "known_issue_match", "account_name", page_size)
    # A page of names exists only where there is a page of tickets: names never outnumber tickets.
    return (
        tickets.withColumnRenamed("values", "affected_tickets")
        .join(
            accounts.select("known_issue_match", "page", F.col("values").alias("affected_accounts")),
            ["known_issue_match", "page"],
            "left",
        )
        .select(
            "known_issue_match",
            "page",
            "affected_tickets",
            "affected_accounts",
            F.col("total").alias("ticket_count"),
        )
        .orderBy(F.desc("ticket_count"), "known_issue_match", "page")
    )


def resolution_review_queue(tickets: DataFrame, closed_only: bool = False) -> DataFrame:
    """Tickets whose earlier resolution someone should check before it is used again."""
    schemas.require(
        tickets, "ticket_id", "account_id", "subject", "historical_resolution", frame="tickets"
    )
    queue = tickets.filter(F.col("historical_resolution").isNotNull())
    if closed_only:
        queue = queue.filter(F.col("status") == "closed")
    return queue.select("ticket_id", "account_id", "subject", "historical_resolution")
