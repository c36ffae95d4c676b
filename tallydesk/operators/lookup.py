"""Answers to batches of record requests, each confined to the account that asks.

The account of a request comes from the session that sent it and is part of every join key, so a
record of another account is indistinguishable from one that does not exist.

The distinct keys of a batch are written to a table first, so that Spark knows how large they are:
keys of few bytes are broadcast and sift the records where they lie, others meet them in a shuffle,
or in place where the records are stored by account (``store_records``).

An answer has two forms. In ``Answers`` every record that someone asks for stands once, however many
ask for it, and every request has one row that says which records are its own: rows grow with
requests plus records. ``lookup`` and its parts put the two together, a row per request and record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallydesk import rules, schemas
from tallydesk.functions.clock import iso_text, rounded_minutes_between, snapshot_column
from tallydesk.plans.checkpoints import parquet_checkpoint
from tallydesk.plans.skew import DEFAULT_SPREAD, Spread, join_many, join_to_one
from tallydesk.sources.sinks import json_object
from tallydesk.sources.tables import first_accounts

REQUEST_COLUMNS = ("request_id", "account_id", "table_name", "record_id")
TABLES = ("account", "orders", "tickets")


# Records of one account are stored in so many slots, by their id.
SLOT = "_slot"


@dataclass(frozen=True)
class LookupLimits:
    """How hot accounts are spread, and how many rows a task makes that puts lists together."""

    spread: Spread = DEFAULT_SPREAD
    rows_per_task: int = 500_000


@dataclass(frozen=True)
class Answers:
    """``requests``: (request_id, account_id, table_name, record_id, is_list, n_records, error), a row per request.

    ``records``: what is asked for, each record once. A list (``is_list``) is all of them with the
    request's account; any other request is for the one with its record id too.
    """

    requests: DataFrame
    records: DataFrame


DEFAULT_LIMITS = LookupLimits()


def _times_as_text(df: DataFrame) -> DataFrame:
    kinds = (T.TimestampNTZType, T.TimestampType)
    times = [field.name for field in df.schema if isinstance(field.dataType, kinds)]
    return df.withColumns({name: iso_text(F.col(name)) for name in times}) if times else df


def enrich_orders(orders: DataFrame, snapshot) -> DataFrame:
    """Orders with the waiting and delay times that apply to them; one that does not apply is null."""
    schemas.require(orders, "order_id", "account_id", "status", *schemas.ORDER_TIMES, frame="orders")
    now = snapshot_column(snapshot)
    booked, window_end = F.col("booked_at"), F.col("pickup_window_end")
    picked_up, cancelled = F.col("pickup_actual_at"), F.col("cancellation_requested_at")
    enriched = orders.withColumns(
        {
            "minutes_since_booking": rounded_minutes_between(booked, now),
            "pickup_delay_vs_window_end_minutes": F.when(
                picked_up.isNotNull(), rounded_minutes_between(window_end, picked_up)
            ),
            "minutes_past_pickup_window_end_if_still_not_picked_up": F.when(
                picked_up.isNull() & F.col("status").isin("BOOKED"), rounded_minutes_between(window_end, now)
            ),
            "minutes_between_booking_and_cancellation_request": F.when(
                cancelled.isNotNull(), rounded_minutes_between(booked, cancelled)
            ),
        }
    )
    return _times_as_text(enriched)


def enrich_tickets(tickets: DataFrame, snapshot) -> DataFrame:
    """Tickets with their age, and a warning on those that carry an earlier resolution."""
    schemas.require(tickets, "ticket_id", "account_id", "created_at", frame="tickets")
    warning = F.lit(None).cast("string")
    if "historical_resolution" in tickets.columns:
        warning = F.when(F.col("historical_resolution").isNotNull(), F.lit(rules.RESOLUTION_WARNING))
    enriched = tickets.withColumns(
        {
            "ticket_age_minutes": rounded_minutes_between(F.col("created_at"), snapshot_column(snapshot)),
            "_warning": warning,
        }
    )
    return _times_as_text(enriched)


def _requests_for(requests: DataFrame, table: str) -> DataFrame:
    schemas.require(requests, *REQUEST_COLUMNS, frame="requests")
    return requests.select(*REQUEST_COLUMNS).filter(F.col("table_name") == table).drop("table_name")


def _asks_for_one() -> Column:
    """An empty record id is the same as none."""
    return F.coalesce(F.col("record_id").cast("string"), F.lit("")) != ""


def _slot_of(record: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(record.cast("string")), F.lit(slots)).cast("int")


def store_records(records: DataFrame, table: str, id_column: str, buckets: int = 256, slots: int = 16, mode: str = "error") -> DataFrame:
    """Save orders or tickets as a table bucketed by account and slot, for lookups that do not move them.

    The records of an account are dealt into ``slots`` by their id, so that a hot account fills many
    buckets. Lookups of records in place need ``spark.sql.requireAllClusterKeysForCoPartition=false``,
    as a record is found by account, slot and id.
    """
    stored = records.withColumn(SLOT, _slot_of(F.col(id_column), slots))
    dealt = stored.repartition(buckets, "account_id", SLOT)
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, "account_id", SLOT).sortBy("account_id", SLOT).saveAsTable(table)
    return records.sparkSession.table(table)


def _slots_of(records: DataFrame, asked: DataFrame, slots: int | None) -> tuple[DataFrame, list[str]]:
    """The asked keys with the slots that their records can lie in, where records are stored in slots."""
    if SLOT not in records.columns:
        return asked, []
    if slots is None:
        raise ValueError("say in how many slots the records are stored")
    every = F.sequence(F.lit(0), F.lit(slots - 1))
    own = F.when(F.col("_id").isNull(), every).otherwise(F.array(_slot_of(F.col("_id"), slots)))
    return asked.withColumn(SLOT, F.explode(own)), [SLOT]


def _asked_records(mine: DataFrame, records: DataFrame, id_column: str, slots: int | None) -> DataFrame:
    """The records that some request asks for, each once: ``_id``, and whether by list (``_all``) or by id (``_one``)."""
    asked = mine.select("account_id", "_id").distinct().filter(F.col("account_id").isNotNull())
    asked, place = _slots_of(records, parquet_checkpoint(asked, "asked"), slots)
    lists = asked.filter("_id IS NULL").select("account_id", *place, F.lit(True).alias("_all"))
    ones = asked.filter("_id IS NOT NULL").select("account_id", *place, "_id", F.lit(True).alias("_one"))
    keyed = records.withColumn("_id", F.col(id_column).cast("string"))
    met = keyed.join(ones, ["account_id", *place, "_id"], "left").join(lists, ["account_id", *place], "left")
    return met.filter("_all OR _one").drop(*place)


def record_answers(
    requests: DataFrame,
    table: str,
    records: DataFrame,
    id_column: str,
    not_found: str,
    slots: int | None = None,
) -> Answers:
    """Requests for orders or tickets and the records they ask for, neither repeated for the other.

    ``records`` of the answer has two more columns: ``_id``, the record's id as text, and ``_all``,
    true where a list asks for it.
    """
    wanted = F.when(_asks_for_one(), F.col("record_id").cast("string"))
    mine = _requests_for(requests, table).withColumn("_id", wanted)
    found = parquet_checkpoint(_asked_records(mine, records, id_column, slots), "asked_records")
    by_id = found.filter("_one").groupBy("account_id", "_id").agg(F.count(F.lit(1)).alias("_n"))
    by_account = found.filter("_all").groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))
    number = F.coalesce("_n", F.lit(0)).alias("n_records")
    kept = ("request_id", "account_id", F.lit(table).alias("table_name"), "record_id")
    one = mine.filter("_id IS NOT NULL").join(by_id, ["account_id", "_id"], "left")
    error = F.when(F.col("_n").isNull(), F.format_string(not_found, F.col("_id")))
    one = one.select(*kept, F.lit(False).alias("is_list"), number, error.alias("error"))
    lists = mine.filter("_id IS NULL").join(by_account, ["account_id"], "left")
    lists = lists.select(*kept, F.lit(True).alias("is_list"), number, F.lit(None).cast("string").alias("error"))
    return Answers(one.unionByName(lists), found.drop("_one"))


def account_answers(requests: DataFrame, accounts: DataFrame, order_by: str | None = None) -> Answers:
    """Requests for the caller's account, whatever record they name, and the account rows they get."""
    mine = _requests_for(requests, "account")
    asked = parquet_checkpoint(mine.select("account_id").distinct(), "asked")
    found = parquet_checkpoint(first_accounts(accounts.join(asked, "account_id", "left_semi"), order_by), "asked_accounts")
    known = found.select("account_id", F.lit(1).cast("long").alias("_n"))
    error = F.when(F.col("_n").isNull(), F.lit(rules.ACCOUNT_NOT_FOUND))
    answered = mine.join(known, "account_id", "left").select(
        "request_id",
        "account_id",
        F.lit("account").alias("table_name"),
        "record_id",
        F.lit(False).alias("is_list"),
        F.coalesce("_n", F.lit(0)).alias("n_records"),
        error.alias("error"),
    )
    return Answers(answered, found)


def _put_together(answers: Answers, enrich: Callable[[DataFrame], DataFrame], id_column: str, limits: LookupLimits) -> DataFrame:
    """One row per request and record found.

    A request for one record matches on account and record id at once. Only requests for a list
    match on the account alone. A list without records gives one row that is empty but no error.
    """
    asked = answers.requests.drop("table_name")
    found = enrich(answers.records.drop("_all"))
    one = asked.filter(~F.col("is_list")).withColumn("_id", F.col("record_id").cast("string"))
    # Account and record id together are near unique: nothing to count, and adaptive execution
    # splits the requests where many ask for one record.
    single = one.join(found, ["account_id", "_id"], "left")
    lists = asked.filter("is_list")
    listed = found.join(answers.records.filter("_all").select("account_id").distinct(), "account_id", "left_semi")
    # The result is many times what is shuffled for it, so bytes of the shuffle don't tell how many tasks it needs.
    rows = lists.agg(F.sum("n_records")).first()[0] or 0
    many = join_many(
        lists.filter("n_records > 0"),
        listed.drop("_id"),
        ["account_id"],
        ["request_id"],
        [id_column],
        limits.spread,
        tasks=max(1, -(-rows // limits.rows_per_task)),
    )
    empty = lists.filter("n_records = 0")
    whole = single.drop("_id").unionByName(many).unionByName(empty, allowMissingColumns=True)
    error = F.col("error").alias("error")
    return whole.select(*[c for c in whole.columns if c not in ("error", "is_list", "n_records")], error)


def _with_account(answers: Answers, limits: LookupLimits) -> DataFrame:
    """One row per request with the columns of its account."""
    asked = answers.requests.drop("table_name", "is_list", "n_records")
    joined = join_to_one(asked, answers.records, ["account_id"], ["request_id"], limits.spread)
    return joined.select(*[c for c in joined.columns if c != "error"], "error")


def lookup_account(
    requests: DataFrame,
    accounts: DataFrame,
    order_by: str | None = None,
    limits: LookupLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """The caller's own account row, whatever record was asked for."""
    return _with_account(account_answers(requests, accounts, order_by), limits)


def lookup_orders(
    requests: DataFrame, orders: DataFrame, snapshot, limits: LookupLimits = DEFAULT_LIMITS, slots: int | None = None
) -> DataFrame:
    """The caller's order, or all of them, with derived times."""
    answers = record_answers(requests, "orders", orders, "order_id", rules.ORDER_NOT_FOUND, slots)
    return _put_together(answers, lambda rows: enrich_orders(rows, snapshot), "order_id", limits)


def lookup_tickets(
    requests: DataFrame, tickets: DataFrame, snapshot, limits: LookupLimits = DEFAULT_LIMITS, slots: int | None = None
) -> DataFrame:
    """The caller's ticket, or all of them, with derived times."""
    answers = record_answers(requests, "tickets", tickets, "ticket_id", rules.TICKET_NOT_FOUND, slots)
    return _put_together(answers, lambda rows: enrich_tickets(rows, snapshot), "ticket_id", limits)


def _unknown_tables(requests: DataFrame) -> DataFrame:
    schemas.require(requests, *REQUEST_COLUMNS, frame="requests")
    known = F.coalesce(F.col("table_name").isin(*TABLES), F.lit(False))
    return requests.filter(~known).select(
        "request_id",
        "account_id",
        "table_name",
        "record_id",
        F.lit(None).cast("string").alias("result"),
        F.format_string(rules.UNKNOWN_TABLE, F.coalesce("table_name", F.lit("None"))).alias("error"),
    )


def lookup(
    requests: DataFrame,
    accounts: DataFrame,
    orders: DataFrame,
    tickets: DataFrame,
    snapshot,
    account_order_by: str | None = None,
    limits: LookupLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """All requests answered in one frame: (request, result as JSON, error), a row per record.

    A record's JSON is made once, before it meets the requests that ask for it.
    """

    def as_json(rows: DataFrame, id_column: str, *keys: str) -> DataFrame:
        # A result names the account as its request does.
        named = rows.withColumn("account_id", F.col("account_id").cast(requests.schema["account_id"].dataType))
        text = json_object(*[c for c in named.columns if c not in keys])
        return named.select("account_id", *keys, id_column, F.when(F.col(id_column).isNotNull(), text).alias("result"))

    def uniform(answered: DataFrame, table: str) -> DataFrame:
        return answered.select("request_id", "account_id", F.lit(table).alias("table_name"), "record_id", "result", "error")

    def orders_as_json(rows: DataFrame) -> DataFrame:
        return as_json(enrich_orders(rows.select(*orders.columns, "_id"), snapshot), "order_id", "_id")

    def tickets_as_json(rows: DataFrame) -> DataFrame:
        return as_json(enrich_tickets(rows.select(*tickets.columns, "_id"), snapshot), "ticket_id", "_id")

    by_account = account_answers(requests, accounts, account_order_by)
    found = by_account.records
    texts = found.select("account_id", json_object(*accounts.columns).alias("result"))
    by_account = _with_account(Answers(by_account.requests, texts), limits)
    by_order = record_answers(requests, "orders", orders, "order_id", rules.ORDER_NOT_FOUND)
    by_ticket = record_answers(requests, "tickets", tickets, "ticket_id", rules.TICKET_NOT_FOUND)
    return (
        uniform(by_account, "account")
        .unionByName(uniform(_put_together(by_order, orders_as_json, "order_id", limits), "orders"))
        .unionByName(uniform(_put_together(by_ticket, tickets_as_json, "ticket_id", limits), "tickets"))
        .unionByName(_unknown_tables(requests))
    )


def answers_once(
    requests: DataFrame,
    accounts: DataFrame,
    orders: DataFrame,
    tickets: DataFrame,
    snapshot,
    account_order_by: str | None = None,
) -> Answers:
    """The answers to all requests with every record once: ``records`` is (table_name, account_id, record_id, result as JSON).

    Where ``lookup`` gives a row for every request and record, this grows with requests plus records.
    """

    def uniform(answers: Answers, table: str, id_column: str, records: DataFrame, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rows = enrich(answers.records.select(*records.columns))
        own = [F.lit(table).alias("table_name"), F.col("account_id"), F.col(id_column).cast("string").alias("record_id")]
        return rows.select(*own, json_object(*rows.columns).alias("result"))

    by_account = account_answers(requests, accounts, account_order_by)
    by_order = record_answers(requests, "orders", orders, "order_id", rules.ORDER_NOT_FOUND)
    by_ticket = record_answers(requests, "tickets", tickets, "ticket_id", rules.TICKET_NOT_FOUND)
    unknown = _unknown_tables(requests).select(
        "request_id", "account_id", "table_name", "record_id", F.lit(False).alias("is_list"), F.lit(0).cast("long").alias("n_records"), "error"
    )
    answered = by_account.requests.unionByName(by_order.requests).unionByName(by_ticket.requests).unionByName(unknown)
    records = (
        uniform(by_account, "account", "account_id", accounts, lambda rows: rows)
        .unionByName(uniform(by_order, "orders", "order_id", orders, lambda rows: enrich_orders(rows, snapshot)))
        .unionByName(uniform(by_ticket, "tickets", "ticket_id", tickets, lambda rows: enrich_tickets(rows, snapshot)))
    )
    return Answers(answered, records)


def lookup_errors(answers: DataFrame) -> DataFrame:
    """Requests that could not be answered, with the reason."""
    return answers.filter(F.col("error").isNotNull()).select(
        "request_id", "account_id", "table_name", "record_id", "error"
    )
