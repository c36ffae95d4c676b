"""Support-desk tables derived from the star-schema test tables.

Each view is SQL that Spark and DuckDB both run; ``{name}`` stands for a table or another view.
Every view covers its whole tables.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallydesk.plans.checkpoints import shared_folder

SNAPSHOT = "2024-01-30 00:00:00"

VIEWS = {
    "v_accounts": """
        SELECT c_custkey AS account_id, c_name AS account_name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Enterprise' WHEN 'BUILDING' THEN 'Growth'
                    WHEN 'HOUSEHOLD' THEN 'Growth' WHEN 'FURNITURE' THEN 'Standard' END AS plan
        FROM {customer}""",
    # Accounts with a large balance have a contract.
    "v_contract_sla": """
        SELECT c_custkey AS account_id, 'P1' AS severity, 15 AS minutes FROM {customer} WHERE c_acctbal > 5000
        UNION ALL SELECT c_custkey, 'P2', 60 FROM {customer} WHERE c_acctbal > 5000
        UNION ALL SELECT c_custkey, 'P3', 480 FROM {customer} WHERE c_acctbal > 5000""",
    # People who are signing up have no account yet: left-join misses.
    "v_tickets": """
        SELECT event_id AS ticket_id, CASE WHEN event_type = 'signup' THEN -user_id ELSE user_id END AS account_id,
               event_type AS subject, props AS description,
               CASE WHEN value < 12 THEN 'closed' ELSE 'open' END AS status,
               ts AS created_at, ts + INTERVAL '1' HOUR AS last_customer_message_at,
               CASE WHEN value > 30 THEN 'Resolved as ' || event_type END AS historical_resolution
        FROM {events}""",
    "v_orders": """
        SELECT o.o_orderkey AS order_id, o.o_custkey AS account_id,
               CASE o.o_orderstatus WHEN 'F' THEN 'PICKED_UP' WHEN 'O' THEN 'BOOKED' ELSE 'CANCELLED' END AS status,
               o.o_orderdate AS booked_at,
               o.o_orderdate + INTERVAL '1' DAY AS pickup_window_start,
               o.o_orderdate + INTERVAL '5' DAY AS pickup_window_end,
               CASE WHEN o.o_orderstatus = 'F' THEN l.first_ship END AS pickup_actual_at,
               CASE WHEN o.o_orderstatus = 'P'
                    THEN o.o_orderdate + CAST(o.o_orderkey % 600 AS INT) * INTERVAL '1' SECOND END AS cancellation_requested_at
        FROM {orders} o
        LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_ship FROM {lineitem} GROUP BY l_orderkey) l
          ON o.o_orderkey = l.l_orderkey""",
    "v_meta": """
        SELECT event_id AS row_ord, CASE event_type WHEN 'signup' THEN 'Dataset snapshot' ELSE event_type END AS key,
               CAST(ts AS STRING) || ' Asia/Kolkata' AS value
        FROM {events}""",
    # Error events carry text that is no time.
    "v_raw_times": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS STRING) END AS created_at
        FROM {events}""",
    # Pages of a document are the turns of a conversation; a null page follows every answer.
    "v_pages": """
        SELECT conv_id AS doc_id, turn * 2 AS page_no, text FROM {conversations}
        UNION ALL SELECT conv_id, turn * 2 + 1, CAST(NULL AS STRING) FROM {conversations} WHERE role = 'assistant'""",
    # The turns with a numbered header each; regions are documents with a blank page only.
    "v_headed_pages": """
        SELECT conv_id AS doc_id, turn AS page_no, CAST(turn + 1 AS STRING) || '. ' || text AS text
        FROM {conversations}
        UNION ALL SELECT CAST(-1 - r_regionkey AS BIGINT), CAST(0 AS BIGINT), '  ' FROM {region}""",
    "v_registry": """
        SELECT conv_id AS doc_ord, conv_id AS doc_id,
               CASE WHEN MAX(turn) > 5 THEN 'contract' WHEN MAX(turn) > 3 THEN 'policy' ELSE 'sop' END AS doc_type,
               CASE WHEN MIN(role) = 'assistant' THEN 'current' ELSE 'deprecated' END AS status,
               CASE WHEN MAX(turn) > 5 THEN conv_id END AS account_id,
               'Conversation ' || CAST(conv_id AS STRING) AS title
        FROM {conversations} GROUP BY conv_id
        UNION ALL SELECT CAST(-1 - r_regionkey AS BIGINT), CAST(-1 - r_regionkey AS BIGINT), 'memo', 'current', CAST(NULL AS BIGINT), r_name
        FROM {region}""",
    "v_chunks": """
        SELECT doc_id AS chunk_ord, text, 'Document ' || CAST(doc_id AS STRING) AS title,
               CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'contract'
                    WHEN source IN ('src4', 'src5', 'src6', 'src7') THEN 'sop'
                    WHEN source IN ('src8', 'src9', 'src10', 'src11') THEN 'policy'
                    WHEN source IN ('src12', 'src13', 'src14', 'src15') THEN 'product_doc' ELSE 'memo' END AS doc_type,
               CASE WHEN lang = 'en' THEN 'current' WHEN n_chars > 2000 THEN 'current' ELSE 'deprecated' END AS status,
               CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN doc_id % 15 END AS account_id,
               lang AS section
        FROM {documents}""",
    # The queries made from regions have no hit.
    "v_queries": """
        SELECT item_id AS query_id, text AS query_text, item_id % 15 AS account_id FROM {benchmark}
        UNION ALL SELECT CAST(-1 - r_regionkey AS BIGINT), 'zqxj' || CAST(r_regionkey AS STRING) || ' vwkq', r_regionkey FROM {region}""",
    # For every order: its own record, a foreign record, the list of orders, of tickets, the account,
    # an unknown account and an unknown table.
    "v_requests": """
        SELECT o_orderkey * 10 AS request_id, o_custkey AS account_id, 'orders' AS table_name, CAST(o_orderkey AS STRING) AS record_id FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 1, o_custkey + 1, 'orders', CAST(o_orderkey AS STRING) FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 2, o_custkey, 'orders', '' FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 3, o_custkey, 'tickets', NULL FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 4, o_custkey, 'account', NULL FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 5, -o_custkey, 'account', 'x' FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 6, o_custkey, 'invoices', NULL FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 7, o_custkey, 'tickets', CAST(o_orderkey AS STRING) FROM {orders}""",
    "v_proposals": """
        SELECT event_id AS proposal_id, user_id AS conv_id, CAST(dayofmonth(ts) AS BIGINT) AS turn, event_id AS call_ord,
               CASE WHEN value > 60 THEN 'refund' WHEN event_type = 'error' THEN 'create_escalation'
                    ELSE 'create_followup_task' END AS action_type,
               CAST(event_id AS STRING) AS related_id,
               CASE WHEN value >= 3 THEN 'about ' || event_type END AS reason,
               CASE WHEN value > 40 THEN 'P9' WHEN value > 15 THEN 'P1' END AS severity
        FROM {events}""",
    # Proposals of middling value are undecided, those of high value are decided a turn too late; every
    # one got a second answer that decides nothing.
    "v_decisions": """
        SELECT event_id AS proposal_id, CASE WHEN value < 10 THEN 'cancelled' WHEN value > 20 THEN 'confirmed' END AS decision,
               CAST(dayofmonth(ts) AS BIGINT) + CASE WHEN value > 45 THEN 1 ELSE 0 END AS turn
        FROM {events}
        UNION ALL SELECT event_id, 'Approved?', CAST(dayofmonth(ts) AS BIGINT) FROM {events}""",
    # Every event calls one tool; broken arguments on errors, empty ones on sign-ups.
    "v_tool_calls": """
        SELECT user_id AS conv_id, CAST(dayofmonth(ts) AS BIGINT) AS turn, 0 AS call_ord,
               'call-' || CAST(event_id AS STRING) AS tool_call_id,
               CASE event_type WHEN 'view' THEN 'search_documents' WHEN 'click' THEN 'structured_data_lookup'
                    ELSE 'propose_action' END AS tool,
               CASE WHEN event_type = 'error' AND value < 5 THEN '{{}}],[{{}}' WHEN event_type = 'error' THEN props || '}}'
                    WHEN event_type = 'signup' THEN '' ELSE props END AS arguments,
               CASE WHEN value < 5 THEN NULL ELSE 'Looking at ' || event_type END AS said
        FROM {events}""",
    # Sign-ups never get an answer.
    "v_tool_results": """
        SELECT user_id AS conv_id, CAST(dayofmonth(ts) AS BIGINT) AS turn, 'call-' || CAST(event_id AS STRING) AS tool_call_id,
               '{{"value": "' || event_type || '"}}' AS result
        FROM {events} WHERE event_type <> 'signup'""",
    "v_decision_results": """
        SELECT user_id AS conv_id, 'call-' || CAST(event_id AS STRING) AS tool_call_id,
               CASE WHEN value < 10 THEN '{{"status": "declined_by_user"}}' ELSE '{{"status": "created"}}' END AS result
        FROM {events} WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, 'call-' || CAST(event_id AS STRING), '{{"status": "a"}}' FROM {events} WHERE event_type = 'purchase'""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


class Tables:
    """The test tables and views of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    def new_folder(self, name: str) -> str:
        """A folder of its own on storage that all executors share."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_"):
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: getattr(self, name) for name in names_in(text)})


def standalone(sql: str) -> str:
    """The statement for DuckDB, with every view it uses as a common table expression."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text).replace("{{", "{").replace("}}", "}")

    views = [f"{name} AS ({plain(VIEWS[name])})" for name in needed]
    body = plain(sql).strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body
