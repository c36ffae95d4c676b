from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallydesk import rules
from tallydesk.functions.arguments import parsed_arguments
from tallydesk.functions.clock import iso_text, minutes_between, rounded_minutes_between
from tallydesk.functions.text import sections, strip_space, tokens
from tallydesk.operators.insights import known_issue_of, severity_of, sla_status_of


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "age, target, status",
    [
        (100.0, 100, "NEAR BREACH"),
        (100.1, 100, "BREACHED"),
        (80.0, 100, "OK"),
        (80.1, 100, "NEAR BREACH"),
        (1e9, None, "OK"),
        (None, 100, "OK"),
    ],
)
def test_sla_limits_are_strict_and_nulls_are_ok(spark, age, target, status):
    assert one(spark, sla_status_of(F.lit(age).cast("double"), F.lit(target).cast("int"))) == status


@pytest.mark.parametrize(
    "subject, description, severity",
    [
        ("API Key leaked", "", "P1"),
        ("label is not", "working today", "P2"),
        ("outage: import fails", "", "P1"),
        ("uploads fails", None, "P2"),
        (None, "everything slow", "P3"),
        (None, None, "P3"),
    ],
)
def test_severity(spark, subject, description, severity):
    text = (F.lit(subject).cast("string"), F.lit(description).cast("string"))
    assert one(spark, severity_of(*text)) == severity


@pytest.mark.parametrize(
    "text, issue", [("csv and pickup", 0), ("late Pickup", 1), ("reuploaded", 0), ("billing", None)]
)
def test_first_issue_in_order_wins(spark, text, issue):
    expected = None if issue is None else rules.ISSUE_KEYWORDS[issue][0]
    assert one(spark, known_issue_of(F.lit(text), F.lit(None).cast("string"))) == expected


def test_rule_sets_are_parameters(spark):
    custom = (("hot", ("fire",)), ("warm", ("smoke",)))
    assert one(spark, severity_of(F.lit("smoke and fire"), F.lit(""), custom, "cold")) == "hot"
    assert one(spark, severity_of(F.lit("rain"), F.lit(""), custom, "cold")) == "cold"


def test_minutes_are_signed_and_rounded_half_up(spark):
    start, later = ntz("2026-01-01 10:00:00"), ntz("2026-01-01 10:00:15")
    assert one(spark, rounded_minutes_between(start, later)) == 0.3
    assert one(spark, minutes_between(later, start)) == -0.25
    assert one(spark, minutes_between(F.lit(None).cast("timestamp_ntz"), later)) is None
    assert one(spark, minutes_between(start, ntz("2026-01-01 10:00:00.000600"))) == pytest.approx(1e-5)


def test_minutes_do_not_depend_on_the_session_zone(spark, settings):
    settings(spark__sql__session__timeZone="America/New_York")
    # The clocks of that zone skip an hour in between.
    assert one(spark, minutes_between(ntz("2024-03-10 01:30:00"), ntz("2024-03-10 03:30:00"))) == 120.0
    assert one(spark, iso_text(ntz("2024-03-10 02:30:00"))) == "2024-03-10T02:30:00"


def test_iso_text(spark):
    assert one(spark, iso_text(ntz("2026-07-14 10:05:00"))) == "2026-07-14T10:05:00"
    assert one(spark, iso_text(ntz("2026-07-14 10:05:00.5"))) == "2026-07-14T10:05:00.500000"
    assert one(spark, iso_text(F.lit(None).cast("timestamp_ntz"))) is None


def cut(spark, text):
    return [tuple(part) for part in one(spark, sections(F.lit(text).cast("string")))]


def test_sections_keep_the_preamble(spark):
    text = " Title \nabout\n1. Scope\nall of it\n12.  Limits\nnone\n"
    assert cut(spark, text) == [
        ("Title", "Title \nabout"),
        ("1. Scope", "1. Scope\nall of it"),
        ("12.  Limits", "12.  Limits\nnone"),
    ]


def test_text_without_header_is_one_section(spark):
    assert cut(spark, "First line \nsecond") == [("First line", "First line \nsecond")]


@pytest.mark.parametrize("text", ["", " \n\t ", None])
def test_blank_text_falls_back(spark, text):
    assert cut(spark, text) == [("Full document", text or "")]


def test_what_is_no_header(spark):
    assert len(cut(spark, "a\n1. lower\n2.Close\n3 Missing\nx 4. Inline")) == 1
    assert [title for title, _ in cut(spark, "a\n1.\nNext")] == ["a", "1."]
    assert [title for title, _ in cut(spark, "a\n١. Arabic digit")] == ["a", "١. Arabic digit"]


def test_strip_takes_all_white_space(spark):
    assert one(spark, strip_space(F.lit(" \x1c\n x y 　\r\n"))) == "x y"


def test_tokens(spark):
    assert one(spark, tokens(F.lit("A cat's été_2, b 42!"))) == ["cat", "été_2", "42"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    "text, expected, valid",
    [
        ('{"a": 1}', '{"a": 1}', True),
        ("", "{}", True),
        (None, "{}", True),
        ('{"a": ', None, False),
        ('{"a": 1}}', None, False),
        ('{"a": 1}, {"b": 2}', None, False),
        ("{'a': 1}", None, False),
        ("   ", None, False),
        (" [1, 2] ", " [1, 2] ", True),
        ("null", "null", True),
    ],
)
def test_arguments(spark, text, expected, valid):
    got = one(spark, parsed_arguments(F.lit(text).cast("string")))
    assert got["is_valid"] is valid
    assert got["input"] == (expected if valid else '{"error":"%s"}' % rules.BAD_ARGUMENTS)


def test_datetime_snapshot(spark):
    from tallydesk.functions.clock import snapshot_column

    moment = datetime(2026, 7, 14, 10, 5)
    assert one(spark, snapshot_column(moment)) == moment
    assert one(spark, snapshot_column("2026-07-14 10:05")) == moment
    frame = spark.sql("SELECT TIMESTAMP_NTZ '2026-07-14 10:05:00' AS snapshot_time")
    assert tuples(spark.range(1).select(snapshot_column(frame))) == [(moment,)]


@pytest.mark.parametrize("text", ["1],[2", "{}],[{}", '1,"b":2', "1}", "{", "[1", "1 2"])
def test_text_that_closes_its_own_frame_is_no_json(spark, text):
    assert not one(spark, parsed_arguments(F.lit(text)))["is_valid"]


@pytest.mark.parametrize("text", ['{"k": 1}', "[1]", '"s"', "1", "null"])
def test_single_json_values_are_valid(spark, text):
    assert one(spark, parsed_arguments(F.lit(text)))["is_valid"]
