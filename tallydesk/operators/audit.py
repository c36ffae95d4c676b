"""The record of tool calls in conversations, paired with what they returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallydesk import schemas
from tallydesk.functions.arguments import parsed_arguments

CALL_KEYS = ("conv_id", "tool_call_id")


def tool_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call of an assistant message, in the order they were made."""
    schemas.require(messages, "conv_id", "turn", "role", "content", "tool_calls", frame="messages")
    return (
        messages.filter(F.col("role") == "assistant")
        .select(
            "conv_id", "turn", F.coalesce("content", F.lit("")).alias("said"), F.posexplode("tool_calls")
        )
        .select(
            "conv_id",
            "turn",
            F.col("pos").alias("call_ord"),
            F.col("col.id").alias("tool_call_id"),
            F.col("col.function.name").alias("tool"),
            F.col("col.function.arguments").alias("arguments"),
            "said",
        )
    )


def tool_results(messages: DataFrame) -> DataFrame:
    """(conv_id, tool_call_id, result): the last answer given to each call.

    Within a turn a column ``message_ord`` tells which is the last; without it, or at a tie, the
    greatest text is taken, so that runs agree.
    """
    schemas.require(messages, "conv_id", "turn", "role", "content", "tool_call_id", frame="messages")
    order = ["message_ord"] if "message_ord" in messages.columns else []
    return (
        messages.filter((F.col("role") == "tool") & F.col("tool_call_id").isNotNull())
        .groupBy(*CALL_KEYS)
        .agg(F.max_by("content", F.struct("turn", *order, "content")).alias("result"))
    )


def tool_call_audit(
    calls: DataFrame, results: DataFrame, decision_results: DataFrame | None = None
) -> DataFrame:
    """Calls with parsed arguments and result; the outcome of a decision replaces the staged result.

    ``results`` holds one row per (conv_id, tool_call_id). Of several decision results of a call the
    greatest text is taken.
    """
    schemas.require(calls, *CALL_KEYS, "turn", "call_ord", "tool", "arguments", frame="calls")
    schemas.require(results, *CALL_KEYS, "result", frame="results")
    answered = calls.join(results.select(*CALL_KEYS, F.col("result").alias("_result")), list(CALL_KEYS), "left")
    result = F.col("_result")
    if decision_results is not None:
        outcome = decision_results.groupBy(*CALL_KEYS).agg(F.max("result").alias("_outcome"))
        answered = answered.join(outcome, list(CALL_KEYS), "left")
        result = F.coalesce("_outcome", "_result")
    return answered.withColumn("_parsed", parsed_arguments(F.col("arguments"))).select(
        "conv_id",
        "turn",
        "call_ord",
        "tool_call_id",
        "tool",
        F.col("_parsed.input").alias("input"),
        F.col("_parsed.is_valid").alias("arguments_valid"),
        result.alias("result"),
    )


def tool_trace(audit: DataFrame) -> DataFrame:
    """The steps that were carried out: (conv_id, turn, call_ord, tool, input, result)."""
    return audit.filter(F.col("result").isNotNull()).select(
        "conv_id", "turn", "call_ord", "tool", "input", "result"
    )


def unanswered_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls that never got a result."""
    return calls.join(results.select(*CALL_KEYS), list(CALL_KEYS), "left_anti")
