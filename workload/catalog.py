"""Every registered query: the Spark operator over the test tables, and SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallydesk import rules
from tallydesk.operators import actions, audit, authority, index_store, insights, lookup, search
from tallydesk.plans.checkpoints import checkpoint_stage
from tallydesk.sources import documents, sinks, tables
from workload.views import SNAPSHOT, Tables, standalone

Query = Callable[[SparkSession, str], DataFrame]

SEVERITIES = (("P1", ("error",)), ("P2", ("purchase", '"k": 1')))
ISSUES = (("KI-A", ('"k": 2', "signup")), ("KI-B", ("click", '"k": 3')))
STOP_WORDS = (
    "the of and to in is it that for as with at by an he she on are was be this have from or had but not "
    "la le les des un une du est et en de que el los las por con der die und den von zu das mit ein"
).split()
CLOCK = f"TIMESTAMP '{SNAPSHOT}'"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        name = build.__name__.lstrip("_")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = standalone(sql)
        return build

    return add


# --- sources ------------------------------------------------------------------------------------


@_register(
    """
    SELECT CAST(regexp_replace(value, '\\s+[A-Za-z]+/[A-Za-z_]+$', '') AS TIMESTAMP) AS snapshot_time
    FROM {v_meta} WHERE key = 'Dataset snapshot' ORDER BY row_ord LIMIT 1"""
)
def snapshot_clock(t: Tables) -> DataFrame:
    return tables.snapshot_clock(t.v_meta)


@_register("SELECT event_id, TRY_CAST(created_at AS TIMESTAMP) AS created_at FROM {v_raw_times}")
def coerce_timestamps(t: Tables) -> DataFrame:
    return tables.coerce_timestamps(t.v_raw_times, ["created_at"])


@_register(
    """
    SELECT label, MAX(account_id) AS account_id
    FROM (SELECT account_name || ' (' || CAST(account_id AS STRING) || ', ' || COALESCE(plan, 'null') || ')' AS label, account_id
          FROM {v_accounts}) x
    GROUP BY label"""
)
def account_directory(t: Tables) -> DataFrame:
    return tables.account_directory(t.v_accounts)


@_register(
    """
    SELECT account_id,
           '{{"account_id":' || CAST(account_id AS STRING) || ',"account_name":"' || account_name || '"'
           || COALESCE(',"plan":"' || plan || '"', '') || '}}' AS json
    FROM {v_accounts}"""
)
def accounts_as_json(t: Tables) -> DataFrame:
    return sinks.as_json(t.v_accounts, keep=["account_id"])


@_register(
    """
    SELECT doc_id, string_agg(COALESCE(text, ''), chr(10) ORDER BY page_no) AS text
    FROM {v_pages} GROUP BY doc_id"""
)
def join_pages(t: Tables) -> DataFrame:
    return documents.join_pages(t.v_pages)


@_register(
    """
    WITH docs AS (
        SELECT doc_id, string_agg(COALESCE(text, ''), chr(10) ORDER BY page_no) AS text
        FROM {v_headed_pages} GROUP BY doc_id),
    cut AS (
        SELECT doc_id, string_split(regexp_replace(text, '\\n(\\d+\\.\\s+[A-Z])', chr(1) || '\\1', 'g'), chr(1)) AS parts
        FROM docs),
    trimmed AS (
        SELECT doc_id, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS parts
        FROM cut),
    numbered AS (
        SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos FROM trimmed)
    SELECT r.doc_ord * 536870912 + n.pos AS chunk_ord, n.text, r.title, r.doc_type, r.status, r.account_id,
           regexp_replace(string_split(n.text, chr(10))[1], '^\\s+|\\s+$', '', 'g') AS section
    FROM numbered n JOIN {v_registry} r ON n.doc_id = r.doc_id
    UNION ALL
    SELECT r.doc_ord * 536870912, d.text, r.title, r.doc_type, r.status, r.account_id, 'Full document'
    FROM docs d JOIN {v_registry} r ON d.doc_id = r.doc_id WHERE trim(d.text) = ''"""
)
def build_chunks(t: Tables) -> DataFrame:
    chunks = documents.build_chunks(documents.join_pages(t.v_headed_pages), t.v_registry)
    return chunks.withColumn("chunk_ord", F.col("chunk_ord").cast("bigint"))


# Names hold line breaks, quotes and commas, as text that people type does.
_TYPED_ACCOUNTS = """
    SELECT CAST(account_id AS STRING) AS account_id, 'Say "' || account_name || '",' || chr(10) || 'Ltd' AS account_name, plan
    FROM {v_accounts}"""


@_register(_TYPED_ACCOUNTS)
def read_desk_csv(t: Tables) -> DataFrame:
    folder = t.new_folder("accounts")
    t.sql(_TYPED_ACCOUNTS).write.options(header=True, escape='"').csv(folder)
    return tables.read_accounts(t.spark, folder, "csv")


@_register(_TYPED_ACCOUNTS)
def write_read_table(t: Tables) -> DataFrame:
    folder = t.new_folder("accounts")
    sinks.write_table(t.sql(_TYPED_ACCOUNTS), folder)
    return tables.read_accounts(t.spark, folder)


@_register(
    """
    SELECT CAST(ticket_id AS STRING) AS ticket_id, CAST(account_id AS STRING) AS account_id, subject, description, status,
           created_at, last_customer_message_at, historical_resolution, 'kept' AS extra
    FROM {v_tickets}"""
)
def read_desk_parquet(t: Tables) -> DataFrame:
    folder = t.new_folder("tickets")
    sinks.write_table(t.v_tickets.withColumn("extra", F.lit("kept")), folder)
    return tables.read_tickets(t.spark, folder)


@_register(
    """
    SELECT doc_ord, CAST(doc_id AS STRING) AS doc_id, doc_type, status, CAST(account_id AS STRING) AS account_id, title
    FROM {v_registry}"""
)
def read_registry(t: Tables) -> DataFrame:
    folder = t.new_folder("registry")
    sinks.write_table(t.v_registry, folder)
    return documents.read_registry(t.spark, folder)


# --- insights -----------------------------------------------------------------------------------

_TEXT = "lower(COALESCE(subject, '') || ' ' || COALESCE(description, ''))"
_SEVERITY = f"""CASE WHEN contains({_TEXT}, 'error') THEN 'P1'
    WHEN contains({_TEXT}, 'purchase') OR contains({_TEXT}, '"k": 1') THEN 'P2' ELSE 'P3' END"""
_ISSUE = f"""CASE WHEN contains({_TEXT}, '"k": 2') OR contains({_TEXT}, 'signup') THEN 'KI-A'
    WHEN contains({_TEXT}, 'click') OR contains({_TEXT}, '"k": 3') THEN 'KI-B' END"""


def _minutes(start: str, end: str) -> str:
    return f"((date_diff('microsecond', {start}, {end}) / 1e6) / 60.0)"


_PLAN_CASES = " ".join(
    f"WHEN plan = '{plan}' AND inferred_severity = '{severity}' THEN {minutes}"
    for plan, targets in rules.PLAN_SLA_MINUTES.items()
    for severity, minutes in targets.items()
)
_INSIGHTS = f"""
    WITH opened AS (
        SELECT t.ticket_id, t.account_id, a.account_name, t.subject, a.plan, {_SEVERITY} AS inferred_severity,
               {_ISSUE} AS known_issue_match, {_minutes("t.created_at", CLOCK)} AS age
        FROM {{v_tickets}} t LEFT JOIN {{v_accounts}} a ON t.account_id = a.account_id
        WHERE t.status = 'open'),
    targeted AS (
        SELECT o.*, COALESCE(c.minutes, CASE {_PLAN_CASES} END) AS target
        FROM opened o LEFT JOIN {{v_contract_sla}} c
          ON o.account_id = c.account_id AND o.inferred_severity = c.severity),
    insights AS (
        SELECT ticket_id, account_id, account_name, subject, inferred_severity, ROUND(age, 1) AS age_minutes,
               target AS sla_target_minutes,
               CASE WHEN age > target THEN 'BREACHED' WHEN age > 0.8 * target THEN 'NEAR BREACH' ELSE 'OK' END AS sla_status,
               known_issue_match,
               COUNT(*) OVER (PARTITION BY account_id) > 1 AS multiple_open_tickets_same_account
        FROM targeted)
"""
_SLA_RANK = "CASE sla_status WHEN 'BREACHED' THEN 0 WHEN 'NEAR BREACH' THEN 1 ELSE 2 END"


def _insights(t: Tables, ordered: bool = False, tickets: DataFrame | None = None) -> DataFrame:
    return insights.ticket_insights(
        t.v_tickets if tickets is None else tickets, t.v_accounts, t.v_contract_sla, SNAPSHOT, SEVERITIES, ISSUES, ordered=ordered
    )


@_register(_INSIGHTS + f"SELECT * FROM insights ORDER BY {_SLA_RANK}, ticket_id")
def ticket_insights(t: Tables) -> DataFrame:
    return _insights(t, ordered=True)


@_register(_INSIGHTS + "SELECT * FROM insights WHERE subject = 'none of these'")
def insights_of_nothing(t: Tables) -> DataFrame:
    return _insights(t, tickets=t.v_tickets.filter("subject = 'none of these'"))


@_register(f"SELECT ticket_id, {_SEVERITY} AS inferred_severity FROM {{v_tickets}}")
def ticket_severity(t: Tables) -> DataFrame:
    severity = insights.severity_of(F.col("subject"), F.col("description"), SEVERITIES)
    return t.v_tickets.select("ticket_id", severity.alias("inferred_severity"))


@_register(f"SELECT ticket_id, {_ISSUE} AS known_issue_match FROM {{v_tickets}}")
def known_issue_tag(t: Tables) -> DataFrame:
    issue = insights.known_issue_of(F.col("subject"), F.col("description"), ISSUES)
    return t.v_tickets.select("ticket_id", issue.alias("known_issue_match"))


@_register(_INSIGHTS + "SELECT ticket_id, inferred_severity, sla_target_minutes FROM insights")
def sla_target(t: Tables) -> DataFrame:
    return _insights(t).select("ticket_id", "inferred_severity", "sla_target_minutes")


@_register(_INSIGHTS + "SELECT ticket_id, age_minutes, sla_status FROM insights")
def sla_status(t: Tables) -> DataFrame:
    return _insights(t).select("ticket_id", "age_minutes", "sla_status")


@_register(_INSIGHTS + "SELECT ticket_id, account_id, multiple_open_tickets_same_account FROM insights")
def multi_open_flag(t: Tables) -> DataFrame:
    return _insights(t).select("ticket_id", "account_id", "multiple_open_tickets_same_account")


@_register(
    """
    SELECT t.*, a.account_name, a.plan, a.status AS status_account
    FROM {v_tickets} t
    LEFT JOIN (SELECT *, CASE WHEN plan IS NULL THEN 'no plan' ELSE 'active' END AS status FROM {v_accounts}) a
      ON t.account_id = a.account_id"""
)
def tickets_with_accounts(t: Tables) -> DataFrame:
    status = F.when(F.col("plan").isNull(), "no plan").otherwise("active")
    return insights.with_accounts(t.v_tickets, t.v_accounts.withColumn("status", status))


def _cluster_pages(page_size: int) -> str:
    return (
        _INSIGHTS
        + f"""
    , placed AS (
        SELECT known_issue_match, ticket_id, {_SLA_RANK} AS sla_rank,
               (ROW_NUMBER() OVER (PARTITION BY known_issue_match ORDER BY {_SLA_RANK}, ticket_id) - 1) // {page_size} AS page
        FROM insights WHERE known_issue_match IS NOT NULL),
    named AS (
        SELECT known_issue_match, account_name,
               (ROW_NUMBER() OVER (PARTITION BY known_issue_match ORDER BY account_name) - 1) // {page_size} AS page
        FROM (SELECT DISTINCT known_issue_match, account_name FROM insights
              WHERE known_issue_match IS NOT NULL AND account_name IS NOT NULL) d),
    ticket_pages AS (
        SELECT known_issue_match, page,
               string_agg(CAST(ticket_id AS STRING), ', ' ORDER BY sla_rank, ticket_id) AS affected_tickets
        FROM placed GROUP BY known_issue_match, page),
    name_pages AS (
        SELECT known_issue_match, page, string_agg(account_name, ', ' ORDER BY account_name) AS affected_accounts
        FROM named GROUP BY known_issue_match, page),
    totals AS (
        SELECT known_issue_match, COUNT(ticket_id) AS ticket_count FROM insights GROUP BY known_issue_match)
    SELECT k.known_issue_match, k.page, k.affected_tickets, n.affected_accounts, c.ticket_count
    FROM ticket_pages k
    LEFT JOIN name_pages n ON k.known_issue_match = n.known_issue_match AND k.page = n.page
    JOIN totals c ON k.known_issue_match = c.known_issue_match
    ORDER BY c.ticket_count DESC, k.known_issue_match, k.page"""
    )


@_register(_cluster_pages(10_000))
def known_issue_clusters(t: Tables) -> DataFrame:
    return insights.known_issue_clusters(_insights(t))


@_register(_cluster_pages(500))
def known_issue_cluster_pages(t: Tables) -> DataFrame:
    return insights.known_issue_clusters(_insights(t), page_size=500)


@_register(
    _INSIGHTS
    + f"""
    SELECT known_issue_match, {_SLA_RANK} AS sla_rank, ticket_id, account_name
    FROM insights WHERE known_issue_match IS NOT NULL"""
)
def issue_tickets(t: Tables) -> DataFrame:
    return insights.issue_tickets(_insights(t))


@_register(
    """
    SELECT ticket_id, account_id, subject, historical_resolution
    FROM {v_tickets} WHERE historical_resolution IS NOT NULL"""
)
def resolution_review_queue(t: Tables) -> DataFrame:
    return insights.resolution_review_queue(t.v_tickets)


# --- lookups ------------------------------------------------------------------------------------


def _iso(column: str) -> str:
    return f"""(strftime({column}, '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN strftime({column}, '%f') = '000000' THEN '' ELSE '.' || strftime({column}, '%f') END)"""


def _rounded(start: str, end: str) -> str:
    return f"ROUND({_minutes(start, end)}, 1)"


_ORDERS = f"""
    SELECT order_id, account_id, status, {_iso("booked_at")} AS booked_at,
           {_iso("pickup_window_start")} AS pickup_window_start, {_iso("pickup_window_end")} AS pickup_window_end,
           {_iso("pickup_actual_at")} AS pickup_actual_at,
           {_iso("cancellation_requested_at")} AS cancellation_requested_at,
           {_rounded("booked_at", CLOCK)} AS minutes_since_booking,
           {_rounded("pickup_window_end", "pickup_actual_at")} AS pickup_delay_vs_window_end_minutes,
           CASE WHEN pickup_actual_at IS NULL AND status = 'BOOKED'
                THEN {_rounded("pickup_window_end", CLOCK)} END AS minutes_past_pickup_window_end_if_still_not_picked_up,
           {_rounded("booked_at", "cancellation_requested_at")} AS minutes_between_booking_and_cancellation_request
    FROM {{v_orders}}"""
_TICKETS = f"""
    SELECT ticket_id, account_id, subject, description, status, {_iso("created_at")} AS created_at,
           {_iso("last_customer_message_at")} AS last_customer_message_at, historical_resolution,
           {_rounded("created_at", CLOCK)} AS ticket_age_minutes,
           CASE WHEN historical_resolution IS NOT NULL THEN '{rules.RESOLUTION_WARNING}' END AS _warning
    FROM {{v_tickets}}"""


@_register(_ORDERS)
def enrich_orders(t: Tables) -> DataFrame:
    return lookup.enrich_orders(t.v_orders, SNAPSHOT)


@_register(_TICKETS)
def enrich_tickets(t: Tables) -> DataFrame:
    return lookup.enrich_tickets(t.v_tickets, SNAPSHOT)


def _answers(table: str, rows: str, id_column: str, not_found: str, columns: str) -> str:
    return f"""
    WITH rows_of AS ({rows}),
    mine AS (SELECT request_id, account_id, record_id FROM {{v_requests}} WHERE table_name = '{table}')
    SELECT q.request_id, q.account_id, q.record_id, {columns},
           CASE WHEN q.record_id <> '' AND r.{id_column} IS NULL
                THEN '{not_found.replace("%s", "' || q.record_id || '")}' END AS error
    FROM mine q LEFT JOIN rows_of r
      ON q.account_id = r.account_id
     AND (q.record_id IS NULL OR q.record_id = '' OR q.record_id = CAST(r.{id_column} AS STRING))"""


_ORDER_COLUMNS = "r.* EXCLUDE (account_id)"
_ACCOUNT_ANSWERS = f"""
    SELECT q.request_id, q.account_id, q.record_id, a.account_name, a.plan,
           CASE WHEN a.account_id IS NULL THEN '{rules.ACCOUNT_NOT_FOUND}' END AS error
    FROM {{v_requests}} q LEFT JOIN {{v_accounts}} a ON q.account_id = a.account_id
    WHERE q.table_name = 'account'"""


@_register(_ACCOUNT_ANSWERS)
def lookup_account(t: Tables) -> DataFrame:
    return lookup.lookup_account(t.v_requests, t.v_accounts)


@_register(_answers("orders", _ORDERS, "order_id", rules.ORDER_NOT_FOUND, _ORDER_COLUMNS))
def lookup_orders(t: Tables) -> DataFrame:
    return lookup.lookup_orders(t.v_requests, t.v_orders, SNAPSHOT)


@_register(_answers("tickets", _TICKETS, "ticket_id", rules.TICKET_NOT_FOUND, _ORDER_COLUMNS))
def lookup_tickets(t: Tables) -> DataFrame:
    return lookup.lookup_tickets(t.v_requests, t.v_tickets, SNAPSHOT)


# Of each record its id and every field that tables share or that is derived, under one name each.
_RECORD_FIELDS = {
    "status": "string",
    "booked_at": "string",
    "pickup_window_start": "string",
    "pickup_window_end": "string",
    "pickup_actual_at": "string",
    "cancellation_requested_at": "string",
    "minutes_since_booking": "double",
    "pickup_delay_vs_window_end_minutes": "double",
    "minutes_past_pickup_window_end_if_still_not_picked_up": "double",
    "minutes_between_booking_and_cancellation_request": "double",
    "subject": "string",
    "description": "string",
    "created_at": "string",
    "last_customer_message_at": "string",
    "historical_resolution": "string",
    "ticket_age_minutes": "double",
    "_warning": "string",
    "account_name": "string",
    "plan": "string",
}
_ALL_ANSWERS = f"""
    WITH answers AS (
        SELECT request_id, account_id, record_id, error, 'account' AS table_name,
               CASE WHEN error IS NULL THEN CAST(account_id AS STRING) END AS record, account_name, plan
        FROM ({_ACCOUNT_ANSWERS}) a
        UNION ALL BY NAME
        SELECT * EXCLUDE (order_id), 'orders' AS table_name, CAST(order_id AS STRING) AS record
        FROM ({_answers("orders", _ORDERS, "order_id", rules.ORDER_NOT_FOUND, _ORDER_COLUMNS)}) o
        UNION ALL BY NAME
        SELECT * EXCLUDE (ticket_id), 'tickets' AS table_name, CAST(ticket_id AS STRING) AS record
        FROM ({_answers("tickets", _TICKETS, "ticket_id", rules.TICKET_NOT_FOUND, _ORDER_COLUMNS)}) k
        UNION ALL BY NAME
        SELECT request_id, account_id, table_name, record_id, NULL AS record, 'Unknown table ' || table_name AS error
        FROM {{v_requests}} WHERE table_name NOT IN ('account', 'orders', 'tickets'))
"""


def _lookup(t: Tables) -> DataFrame:
    return lookup.lookup(t.v_requests, t.v_accounts, t.v_orders, t.v_tickets, SNAPSHOT)


@_register(_ALL_ANSWERS + f"SELECT request_id, account_id, table_name, record_id, record, error, {', '.join(_RECORD_FIELDS)} FROM answers")
def lookup_all(t: Tables) -> DataFrame:
    keys = ("order_id", "ticket_id", "account_id")
    fields = {**dict.fromkeys(keys, "string"), **_RECORD_FIELDS}
    record = F.from_json("result", ", ".join(f"`{name}` {kind}" for name, kind in fields.items()))
    return (
        _lookup(t)
        .withColumn("read", record)
        .select(
            "request_id",
            "account_id",
            "table_name",
            "record_id",
            F.coalesce(*[F.col(f"read.{name}") for name in keys]).alias("record"),
            "error",
            *[F.col(f"read.{name}").alias(name) for name in _RECORD_FIELDS],
        )
    )


_IS_LIST = "(table_name IN ('orders', 'tickets') AND COALESCE(record_id, '') = '')"


def _once(t: Tables) -> lookup.Answers:
    return lookup.answers_once(t.v_requests, t.v_accounts, t.v_orders, t.v_tickets, SNAPSHOT)


@_register(
    _ALL_ANSWERS
    + f"""
    SELECT request_id, account_id, table_name, record_id, {_IS_LIST} AS is_list, COUNT(record) AS n_records, MAX(error) AS error
    FROM answers GROUP BY request_id, account_id, table_name, record_id"""
)
def lookup_requests_once(t: Tables) -> DataFrame:
    return _once(t).requests


@_register(
    _ALL_ANSWERS
    + f"""
    SELECT DISTINCT table_name, account_id, record, {', '.join(_RECORD_FIELDS)} FROM answers WHERE record IS NOT NULL"""
)
def lookup_records_once(t: Tables) -> DataFrame:
    read = F.from_json("result", ", ".join(f"`{name}` {kind}" for name, kind in _RECORD_FIELDS.items()))
    records = _once(t).records.withColumn("read", read)
    fields = [F.col(f"read.{name}").alias(name) for name in _RECORD_FIELDS]
    return records.select("table_name", "account_id", F.col("record_id").alias("record"), *fields)


@_register(
    _ALL_ANSWERS
    + "SELECT request_id, account_id, table_name, record_id, error FROM answers WHERE error IS NOT NULL"
)
def lookup_errors(t: Tables) -> DataFrame:
    return lookup.lookup_errors(_lookup(t))


# --- search -------------------------------------------------------------------------------------

_STOP_LIST = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS)))
_INDEX = f"""
    WITH counts AS MATERIALIZED (
        SELECT chunk_ord, doc_type = 'contract' AS is_contract, account_id AS owner, term, COUNT(*) AS tf
        FROM (SELECT chunk_ord, doc_type, account_id,
                     unnest(regexp_extract_all(lower(text), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}')) AS term FROM {{v_chunks}}) w
        WHERE term NOT IN ({_STOP_LIST})
        GROUP BY ALL),
    terms AS MATERIALIZED (
        SELECT term, df, ln((1.0 + (SELECT COUNT(*) FROM {{v_chunks}})) / (1.0 + df)) + 1.0 AS idf
        FROM (SELECT term, COUNT(*) AS df FROM counts GROUP BY term) d),
    norms AS MATERIALIZED (
        SELECT chunk_ord, sqrt(SUM((tf * idf) * (tf * idf))) AS norm
        FROM counts JOIN terms USING (term) GROUP BY chunk_ord),
    postings AS (
        SELECT chunk_ord, term, tf, tf * idf / norm AS weight, is_contract, owner
        FROM counts JOIN terms USING (term) JOIN norms USING (chunk_ord))
"""
_HITS = (
    _INDEX
    + f"""
    , query_counts AS (
        SELECT query_id, account_id AS caller, term, COUNT(*) AS tf
        FROM (SELECT query_id, account_id,
                     unnest(regexp_extract_all(lower(query_text), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}')) AS term FROM {{v_queries}}) w
        WHERE term NOT IN ({_STOP_LIST})
        GROUP BY ALL),
    query_norms AS (
        SELECT query_id, sqrt(SUM((tf * idf) * (tf * idf))) AS norm
        FROM query_counts JOIN terms USING (term) GROUP BY query_id),
    vectors AS (
        SELECT query_id, caller, term, tf * idf / norm AS query_weight
        FROM query_counts JOIN terms USING (term) JOIN query_norms USING (query_id)),
    scores AS (
        SELECT query_id, chunk_ord, SUM(weight * query_weight) AS score
        FROM postings JOIN vectors USING (term)
        WHERE NOT is_contract OR owner IS NOT DISTINCT FROM caller
        GROUP BY query_id, chunk_ord),
    best AS (
        SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(score, 9) DESC, chunk_ord) AS INTEGER) AS rank
        FROM scores WHERE score > 0),
    hits AS (
        SELECT query_id, rank, title AS source, section, doc_type, status,
               CASE doc_type WHEN 'contract' THEN 0 WHEN 'sop' THEN 1 WHEN 'policy' THEN 1 WHEN 'product_doc' THEN 2 ELSE 9 END AS authority_rank,
               ROUND(score, 3) AS relevance, text
        FROM best JOIN {{v_chunks}} USING (chunk_ord) WHERE rank <= 5)
"""
)


def _terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    counts = search.term_counts(t.v_chunks, STOP_WORDS)
    return counts, search.document_frequencies(counts, t.v_chunks)


def _hits(t: Tables) -> DataFrame:
    return search.search(search.build_index(t.v_chunks, STOP_WORDS), t.v_queries, stop_words=STOP_WORDS)


# Of an index over so few chunks, one file a shelf and room.
_LAYOUT = index_store.Layout(shelves=4, parts=1, rooms=2)


@_register(_INDEX + "SELECT chunk_ord, is_contract, owner, term, tf FROM counts")
def index_tf(t: Tables) -> DataFrame:
    return search.term_counts(t.v_chunks, STOP_WORDS)


@_register(_INDEX + "SELECT term, df, ROUND(idf, 9) AS idf FROM terms")
def index_term_df(t: Tables) -> DataFrame:
    return _terms(t)[1].withColumn("idf", F.round("idf", 9))


@_register(_INDEX + "SELECT chunk_ord, ROUND(norm, 6) AS norm FROM norms")
def index_norms(t: Tables) -> DataFrame:
    # Counts are read several times, and their texts are split into words once.
    counts = checkpoint_stage(search.term_counts(t.v_chunks, STOP_WORDS), "counts")
    terms = checkpoint_stage(search.document_frequencies(counts, t.v_chunks), "terms")
    return search.chunk_norms(counts, terms).withColumn("norm", F.round("norm", 6))


@_register(_INDEX + "SELECT chunk_ord, term, tf, ROUND(weight, 9) AS weight, is_contract, owner FROM postings")
def index_postings(t: Tables) -> DataFrame:
    postings = search.build_index(t.v_chunks, STOP_WORDS).postings
    return postings.select("chunk_ord", "term", "tf", F.round("weight", 9).alias("weight"), "is_contract", "owner")


@_register(_HITS + "SELECT * FROM hits")
def search_topk(t: Tables) -> DataFrame:
    return _hits(t)


@_register(_HITS + "SELECT * FROM hits")
def saved_index_topk(t: Tables) -> DataFrame:
    folder = t.new_folder("index")
    index_store.write_index(t.v_chunks, folder, STOP_WORDS, _LAYOUT)
    return search.search(index_store.load_index(t.spark, folder), t.v_queries)


@_register(_HITS + "SELECT * FROM hits")
def extended_index_topk(t: Tables) -> DataFrame:
    """The index of contracts, extended by everything else, and searched."""
    folder, is_contract = t.new_folder("index"), F.coalesce(F.col("doc_type") == "contract", F.lit(False))
    index_store.write_index(t.v_chunks.filter(is_contract), folder, STOP_WORDS, _LAYOUT)
    index = index_store.extend_index(t.spark, folder, t.v_chunks.filter(~is_contract))
    return search.search(index, t.v_queries)


@_register(_INDEX + "SELECT chunk_ord, term, tf, ROUND(weight, 9) AS weight, is_contract, owner FROM postings")
def extended_index_postings(t: Tables) -> DataFrame:
    """The same weights as of an index built of all chunks at once."""
    folder, is_long = t.new_folder("index"), F.length("text") > 2000
    index_store.write_index(t.v_chunks.filter(is_long), folder, STOP_WORDS, _LAYOUT)
    postings = index_store.extend_index(t.spark, folder, t.v_chunks.filter(~is_long)).postings
    return postings.select("chunk_ord", "term", "tf", F.round("weight", 9).alias("weight"), "is_contract", "owner")


@_register(
    _HITS
    + f"""
    SELECT query_id, account_id, '{rules.NO_PASSAGES}' AS note
    FROM {{v_queries}} WHERE query_id NOT IN (SELECT query_id FROM hits)"""
)
def search_no_hits(t: Tables) -> DataFrame:
    return search.queries_without_hits(t.v_queries, _hits(t))


@_register(
    _HITS
    + """
    , placed AS (
        SELECT *, status = 'current' AS is_current,
               CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY status = 'current' DESC, authority_rank, rank) AS INTEGER) AS authority_position
        FROM hits)
    SELECT *, is_current AND authority_position = 1 AS is_guidance, status = 'deprecated' AS is_superseded FROM placed"""
)
def resolve_authority(t: Tables) -> DataFrame:
    return authority.resolve_authority(_hits(t))


# --- actions ------------------------------------------------------------------------------------

_CHECKED = """
    WITH checked AS (
        SELECT *, array_to_string(list_filter([
                   CASE WHEN action_type NOT IN ('create_escalation', 'create_followup_task') THEN 'unknown_action_type' END,
                   CASE WHEN reason IS NULL THEN 'missing_reason' END,
                   CASE WHEN severity NOT IN ('P1', 'P2', 'P3') THEN 'unknown_severity' END,
                   CASE WHEN severity IS NOT NULL AND action_type <> 'create_escalation' THEN 'severity_without_escalation' END
               ], lambda v: v IS NOT NULL), ', ') AS violations
        FROM {v_proposals})
"""


@_register(_CHECKED + "SELECT *, violations = '' AS valid FROM checked")
def proposal_validation(t: Tables) -> DataFrame:
    checked = actions.proposal_validation(t.v_proposals)
    return checked.withColumn("violations", F.array_join("violations", ", "))


@_register(
    """
    SELECT * EXCLUDE (place) FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY call_ord) AS place FROM {v_proposals}) p
    WHERE place = 1"""
)
def first_proposal_per_turn(t: Tables) -> DataFrame:
    return actions.first_proposal_per_turn(t.v_proposals)


@_register(
    _CHECKED
    + """
    , placed AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY call_ord, proposal_id) = 1 AS is_asked FROM checked),
    decided AS (
        SELECT p.proposal_id, MIN(d.decision) AS decision FROM placed p
        JOIN {v_decisions} d ON p.proposal_id = d.proposal_id AND p.turn = d.turn
        WHERE p.is_asked AND d.decision IN ('confirmed', 'cancelled') GROUP BY p.proposal_id)
    SELECT c.proposal_id,
           CASE WHEN d.decision = 'confirmed' THEN 'ACT-' || upper(left(sha256(CAST(c.proposal_id AS STRING)), 16)) END AS action_id,
           c.action_type, c.related_id, c.severity, COALESCE(c.severity, '') AS severity_label, c.reason,
           CASE d.decision WHEN 'confirmed' THEN 'created' WHEN 'cancelled' THEN 'declined_by_user'
                ELSE 'awaiting_user_confirmation' END AS status,
           c.is_asked, c.violations = '' AS valid, c.violations
    FROM placed c LEFT JOIN decided d ON c.proposal_id = d.proposal_id"""
)
def action_ledger(t: Tables) -> DataFrame:
    ledger = actions.action_ledger(t.v_proposals, t.v_decisions)
    return ledger.withColumn("violations", F.array_join("violations", ", "))


# --- audit --------------------------------------------------------------------------------------

_AUDIT = f"""
    WITH audit AS (
        SELECT c.conv_id, c.turn, c.call_ord, c.tool_call_id, c.tool,
               CASE WHEN c.arguments = '' THEN '{{{{}}}}' WHEN json_valid(c.arguments) THEN c.arguments
                    ELSE '{{{{"error":"{rules.BAD_ARGUMENTS}"}}}}' END AS input,
               c.arguments = '' OR json_valid(c.arguments) AS arguments_valid,
               COALESCE(d.result, r.result) AS result
        FROM {{v_tool_calls}} c
        LEFT JOIN {{v_tool_results}} r ON c.conv_id = r.conv_id AND c.tool_call_id = r.tool_call_id
        LEFT JOIN (SELECT conv_id, tool_call_id, MAX(result) AS result FROM {{v_decision_results}} GROUP BY ALL) d ON c.conv_id = d.conv_id AND c.tool_call_id = d.tool_call_id)
"""


def _messages(t: Tables) -> DataFrame:
    """The flat calls and results as messages of conversations."""
    return t.sql(
        """
        SELECT conv_id, turn, 'assistant' AS role, said AS content,
               array(named_struct('id', tool_call_id, 'type', 'function',
                                  'function', named_struct('name', tool, 'arguments', arguments))) AS tool_calls,
               CAST(NULL AS STRING) AS tool_call_id
        FROM {v_tool_calls}
        UNION ALL
        SELECT conv_id, turn, 'tool', result, NULL, tool_call_id FROM {v_tool_results}"""
    )


def _audit(t: Tables) -> DataFrame:
    messages = _messages(t)
    return audit.tool_call_audit(
        audit.tool_calls(messages), audit.tool_results(messages), t.v_decision_results
    )


@_register(_AUDIT + "SELECT * FROM audit")
def tool_call_audit(t: Tables) -> DataFrame:
    return _audit(t)


@_register(_AUDIT + "SELECT conv_id, turn, call_ord, tool, input, result FROM audit WHERE result IS NOT NULL")
def tool_trace(t: Tables) -> DataFrame:
    return audit.tool_trace(_audit(t))


@_register(
    """
    SELECT c.* REPLACE (COALESCE(said, '') AS said) FROM {v_tool_calls} c
    WHERE NOT EXISTS (SELECT 1 FROM {v_tool_results} r WHERE r.conv_id = c.conv_id AND r.tool_call_id = c.tool_call_id)"""
)
def tool_calls_unanswered(t: Tables) -> DataFrame:
    messages = _messages(t)
    return audit.unanswered_calls(audit.tool_calls(messages), audit.tool_results(messages))
