"""Proposed actions, what users decided on them, and what came of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallydesk import rules, schemas

ACTION_ID_DIGITS = 16


def action_id(proposal_id: Column, digits: int = ACTION_ID_DIGITS) -> Column:
    """An id derived from the proposal, the same on every run; up to 64 hex digits."""
    digest = F.sha2(proposal_id.cast("string"), 256)
    return F.concat(F.lit(rules.ACTION_ID_PREFIX), F.upper(F.substring(digest, 1, digits)))


def proposal_validation(proposals: DataFrame) -> DataFrame:
    """Proposals with the rules they break, named in ``violations``, and ``valid`` if none."""
    schemas.require(proposals, "proposal_id", "action_type", "reason", "severity", frame="proposals")
    severity = F.col("severity")
    checks = {
        "unknown_action_type": ~F.coalesce(F.col("action_type").isin(*rules.ACTION_TYPES), F.lit(False)),
        "missing_reason": F.col("reason").isNull(),
        "unknown_severity": severity.isNotNull() & ~severity.isin(*rules.SEVERITIES),
        "severity_without_escalation": severity.isNotNull()
        & ~F.col("action_type").eqNullSafe(F.lit("create_escalation")),
    }
    named = F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()])
    return proposals.withColumn("violations", F.array_compact(named)).withColumn(
        "valid", F.size("violations") == 0
    )


def first_proposal_per_turn(proposals: DataFrame, keys: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """The proposal of each turn that a user is asked about: the one called first."""
    schemas.require(proposals, *keys, "call_ord", "proposal_id", frame="proposals")
    rest = [name for name in proposals.columns if name not in keys]
    return (
        proposals.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct("call_ord", "proposal_id")).alias("_first"))
        .select(*keys, "_first.*")
    )


def _decisions_in_time(asked: DataFrame, decisions: DataFrame) -> DataFrame:
    """(proposal_id, decision) of the proposals that were put to the user.

    A proposal waits until the conversation goes on: where decisions say in which ``turn`` they were
    made, one of a later turn comes too late. Of contradicting decisions the cancellation holds;
    other words decide nothing.
    """
    schemas.require(decisions, "proposal_id", "decision", frame="decisions")
    made = decisions.filter(F.col("decision").isin("confirmed", "cancelled"))
    if "turn" in decisions.columns:
        made = made.select("proposal_id", "decision", F.col("turn").alias("_decided"))
        in_time = asked.join(made, "proposal_id").filter(F.coalesce(F.col("_decided") == F.col("turn"), F.lit(False)))
    else:
        in_time = asked.join(made.select("proposal_id", "decision"), "proposal_id")
    return in_time.groupBy("proposal_id").agg(F.min("decision").alias("decision"))


def action_ledger(
    proposals: DataFrame, decisions: DataFrame, id_digits: int = ACTION_ID_DIGITS, keys: Sequence[str] = ("conv_id", "turn")
) -> DataFrame:
    """One row per proposal with its status; only a confirmed one has an action id.

    Only the first proposal of a turn is put to the user (``is_asked``). The others of the turn keep
    waiting, whatever a decision says of them, and are never created.
    """
    schemas.require(proposals, *keys, "call_ord", "proposal_id", frame="proposals")
    first = proposals.groupBy(*keys).agg(F.min(F.struct("call_ord", "proposal_id")).alias("_first"))
    asked = first.select(*keys, F.col("_first.proposal_id").alias("proposal_id"))
    decided = asked.join(_decisions_in_time(asked, decisions), "proposal_id", "left")
    marks = decided.select("proposal_id", F.lit(True).alias("is_asked"), "decision")
    status = (
        F.when(F.col("decision") == "confirmed", rules.CREATED)
        .when(F.col("decision") == "cancelled", rules.DECLINED)
        .otherwise(rules.AWAITING)
    )
    return (
        proposal_validation(proposals)
        .join(marks, "proposal_id", "left")
        .withColumn("status", status)
        .withColumn(
            "action_id",
            F.when(F.col("status") == rules.CREATED, action_id(F.col("proposal_id"), id_digits)),
        )
        .select(
            "proposal_id",
            "action_id",
            "action_type",
            "related_id",
            "severity",
            F.coalesce("severity", F.lit("")).alias("severity_label"),
            "reason",
            "status",
            F.coalesce("is_asked", F.lit(False)).alias("is_asked"),
            "valid",
            "violations",
        )
    )
