"""Default rule sets. Every operator that uses one takes it as a parameter."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Results depend on these exact keywords, minutes, ranks and texts.
# ---------------------------------------------------------------------------------------------

# SLA minutes agreed in a signed contract, by account and severity.
CONTRACT_SLA_MINUTES = {
    "ACCT-001": {"P1": 15, "P2": 60, "P3": 480},
    "ACCT-002": {"P1": 120, "P2": 240, "P3": 2880},
}

# SLA minutes of a plan, used where no contract says otherwise.
PLAN_SLA_MINUTES = {
    "Enterprise": {"P1": 30, "P2": 120, "P3": 1440},
    "Growth": {"P1": 120, "P2": 240, "P3": 2880},
    "Standard": {"P1": 240, "P2": 1440, "P3": 2880},
}

# Severities in the order they are tested; the first with a keyword in the text wins.
SEVERITY_KEYWORDS = (
    ("P1", ("outage", "all shipment creation", "every user", "api key", "security", "credential")),
    ("P2", ("fails", "failing", "not working", "unavailable", "degraded")),
)
DEFAULT_SEVERITY = "P3"

# Known issues in the order they are tested; the first with a keyword in the text wins.
ISSUE_KEYWORDS = (
    ("KI-208 (Bulk Upload failures on large CSVs)", ("bulk upload", "csv", "upload")),
    ("KI-211 (SwiftShip pickup webhook delay)", ("swiftship", "still shows booked", "webhook", "pickup")),
)

# A ticket is near its breach beyond this share of its SLA target.
NEAR_BREACH_SHARE = 0.8
SLA_STATUS_RANK = {"BREACHED": 0, "NEAR BREACH": 1, "OK": 2}

# Lower is more authoritative; any other document type gets the default.
AUTHORITY_RANK = {"contract": 0, "sop": 1, "policy": 1, "product_doc": 2}
DEFAULT_AUTHORITY_RANK = 9

# A section starts at a numbered header at the beginning of a line: "3. Severity".
SECTION_HEADER = r"(?U)\n(?=\d+\.[\s\x1c-\x1f]+[A-Z])"
WHOLE_DOCUMENT = "Full document"

# Search tokens are runs of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
TOP_K = 5

SNAPSHOT_KEY = "Dataset snapshot"
SNAPSHOT_ZONE = r"\s+[A-Za-z]+/[A-Za-z_]+$"

ACTION_TYPES = ("create_escalation", "create_followup_task")
SEVERITIES = ("P1", "P2", "P3")
ACTION_ID_PREFIX = "ACT-"
AWAITING = "awaiting_user_confirmation"
CREATED = "created"
DECLINED = "declined_by_user"

ACCOUNT_NOT_FOUND = "Account not found."
ORDER_NOT_FOUND = "No order %s found for this account."
TICKET_NOT_FOUND = "No ticket %s found for this account."
UNKNOWN_TABLE = "Unknown table %s"
NO_PASSAGES = "No relevant passages found."
BAD_ARGUMENTS = "Invalid JSON arguments returned by model."

# ---------------------------------------------------------------------------------------------

RESOLUTION_WARNING = (
    "Carries an earlier resolution: background only, possibly wrong, and not to be quoted as policy in force."
)
