"""Account, order and ticket tables and the snapshot clock."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk import rules, schemas
from tallydesk.functions.clock import known_moment


def coerce_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zone-free timestamps; text that is none becomes null instead of failing the job."""
    return df.withColumns(
        {name: F.col(name).try_cast("timestamp_ntz") for name in columns}
    )


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give the declared columns their types; other columns pass through."""
    schemas.require(df, *schema.names, frame="table")
    return df.withColumns({field.name: F.col(field.name).try_cast(field.dataType) for field in schema})


# Values may hold line breaks and doubled quotes, as spreadsheets write them.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, source_format: str = "parquet", **options
) -> DataFrame:
    """Read a Parquet, ORC or CSV table; its types are declared, no scan infers them.

    ``options`` go to the reader. A CSV file whose values never hold line breaks can be split over
    several tasks with ``multiLine=False``.
    """
    defaults = CSV_OPTIONS if source_format == "csv" else {}
    return typed(spark.read.format(source_format).options(**defaults | options).load(path), schema)


def read_accounts(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.ACCOUNTS, source_format)


def read_orders(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.ORDERS, source_format)


def read_tickets(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.TICKETS, source_format)


@dataclass(frozen=True)
class Desk:
    """The tables of one snapshot and its clock."""

    accounts: DataFrame
    orders: DataFrame
    tickets: DataFrame
    snapshot_time: DataFrame


def read_desk(spark: SparkSession, folder: str, source_format: str = "parquet") -> Desk:
    """The tables ``accounts``, ``orders``, ``tickets`` and ``meta`` of a folder; persist what is used often."""

    def path(name: str) -> str:
        return f"{folder.rstrip('/')}/{name}"

    return Desk(
        read_accounts(spark, path("accounts"), source_format),
        read_orders(spark, path("orders"), source_format),
        read_tickets(spark, path("tickets"), source_format),
        snapshot_clock(read_table(spark, path("meta"), schemas.META, source_format)),
    )


@contextmanager
def held_desk(desk: Desk, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[Desk]:
    """The desk for many queries: each table is read once, when it is first used, and let go at the end.

    The clock is read now, so that all queries measure against the same one. Parts of a table that
    are lost with an executor are read again from its source.
    """
    now = desk.snapshot_time
    if isinstance(now, DataFrame):
        now = now.first()[0]
    held = Desk(desk.accounts.persist(level), desk.orders.persist(level), desk.tickets.persist(level), now)
    try:
        yield held
    finally:
        for table in (held.accounts, held.orders, held.tickets):
            table.unpersist()


def snapshot_clock(meta: DataFrame, key: str = rules.SNAPSHOT_KEY) -> DataFrame:
    """One row with ``snapshot_time``: the first entry under the key, read without its zone name.

    Without such an entry, or with text that is no time, reading it fails: ages against no clock
    would all look harmless.
    """
    first = meta.filter(F.col("key") == key).agg(F.min_by("value", "row_ord").alias("value"))
    text = F.btrim(F.regexp_replace("value", rules.SNAPSHOT_ZONE, ""))
    return first.select(known_moment(text.try_cast("timestamp_ntz")).alias("snapshot_time"))


def account_directory(accounts: DataFrame, order_by: str = "account_id") -> DataFrame:
    """(label, account_id): ``name (id, plan)``; of equal labels the last account stays."""
    schemas.require(accounts, "account_id", "account_name", "plan", order_by, frame="accounts")
    label = F.format_string(
        "%s (%s, %s)", F.col("account_name"), F.col("account_id").cast("string"), F.col("plan")
    )
    return (
        accounts.select(label.alias("label"), "account_id", F.col(order_by).alias("_ord"))
        .groupBy("label")
        .agg(F.max_by("account_id", "_ord").alias("account_id"))
    )


def first_accounts(accounts: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per account id: the first one by ``order_by``, then the least by all columns that have an order."""
    schemas.require(accounts, "account_id", frame="accounts")
    sortable = [F.col(name) for name, kind in accounts.dtypes if "map<" not in kind and "variant" not in kind]
    first = Window.partitionBy("account_id").orderBy(*([F.col(order_by)] if order_by else []), *sortable)
    # The group limit of this rank keeps one row per account and task before anything is shuffled.
    return accounts.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
