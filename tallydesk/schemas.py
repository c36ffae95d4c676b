"""Declared column types of the input tables. Columns beyond these pass through untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ORDER_TIMES = (
    "booked_at",
    "pickup_window_start",
    "pickup_window_end",
    "pickup_actual_at",
    "cancellation_requested_at",
)
TICKET_TIMES = ("created_at", "last_customer_message_at")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _times(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.TimestampNTZType()) for name in names]


ACCOUNTS = T.StructType(_strings("account_id", "account_name", "plan"))
ORDERS = T.StructType(_strings("order_id", "account_id", "status") + _times(*ORDER_TIMES))
TICKETS = T.StructType(
    _strings("ticket_id", "account_id", "subject", "description", "status")
    + _times(*TICKET_TIMES)
    + _strings("historical_resolution")
)
META = T.StructType([T.StructField("row_ord", T.IntegerType())] + _strings("key", "value"))
REGISTRY = T.StructType(
    [T.StructField("doc_ord", T.LongType())] + _strings("doc_id", "doc_type", "status", "account_id", "title")
)
PAGES = T.StructType(
    _strings("doc_id") + [T.StructField("page_no", T.IntegerType())] + _strings("text")
)
CHUNKS = T.StructType(
    [T.StructField("chunk_ord", T.DecimalType(38, 0))]
    + _strings("text", "title", "doc_type", "status", "account_id", "section")
)
PROPOSALS = T.StructType(
    _strings("proposal_id", "conv_id")
    + [T.StructField("turn", T.LongType()), T.StructField("call_ord", T.LongType())]
    + _strings("action_type", "related_id", "reason", "severity")
)
DECISIONS = T.StructType(_strings("proposal_id", "decision"))
MESSAGES = T.StructType(
    _strings("conv_id")
    + [T.StructField("turn", T.LongType())]
    + _strings("role", "content")
    + [
        T.StructField(
            "tool_calls",
            T.ArrayType(
                T.StructType(
                    _strings("id", "type")
                    + [T.StructField("function", T.StructType(_strings("name", "arguments")))]
                )
            ),
        )
    ]
    + _strings("tool_call_id")
)


def require(df: DataFrame, *names: str, frame: str) -> DataFrame:
    """Fail at once, with the name of the frame, when a needed column is absent."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{frame} lacks column(s): {', '.join(missing)}")
    return df
