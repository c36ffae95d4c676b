"""Dropped lines against a plain count over all documents."""

import hashlib
import random

import pytest

from tallydesk.llm import linededup
from tallydesk.llm.linededup import LineRule

SCHEMA = "doc_id long, text string"


def key_of(line):
    line = line.strip(" \t\n\r\x0b\x0c")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute(rows, rule):
    """(doc_id, text) to (n_lines, n_dropped, kept)."""
    documents = sorted({(n is not None, n, text or "") for n, text in rows}, key=lambda d: (d[0], d[1] or 0))
    holders = {}
    for document in documents:
        for place, line in enumerate(document[2].split("\n")):
            if len(key_of(line)) >= max(1, rule.characters):
                holders.setdefault(key_of(line), []).append((document, place))
    gone = set()
    for found in holders.values():
        if len({document for document, _ in found}) >= rule.documents:
            gone.update(found[1:] if rule.keep_first else found)
    out = {}
    for document in documents:
        lines = document[2].split("\n")
        kept = [line for place, line in enumerate(lines) if (document, place) not in gone]
        out[document[1:]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def dedup(spark, rows, rule):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = linededup.kept_text(docs, linededup.keep_bitmaps(docs, rule))
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()), key=repr)


def agrees(spark, rows, rule):
    expected = brute(rows, rule)
    wanted = [(n, text, *expected[(n, text or "")]) for n, text in rows]
    assert dedup(spark, rows, rule) == sorted(wanted, key=repr)


def corpus(seed, documents=300):
    draw = random.Random(seed)
    common = ["Share this", " share THIS\t", "Élan", "élan", "a b", "", "  ", "x", "©"]
    rows = []
    for n in range(documents):
        lines = [draw.choice(common) if draw.random() < 0.5 else f"line {draw.randrange(200)}" for _ in range(draw.randrange(12))]
        rows.append((n, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(
    "rule, batch",
    [
        (LineRule(), "7"),
        (LineRule(), "10000"),
        (LineRule(2, 4), "7"),
        (LineRule(2, keep_first=True), "7"),
        (LineRule(2, keep_first=True), "10000"),
        (LineRule(1, keep_first=True), "7"),
        (LineRule(1), "10000"),
        (LineRule(400), "7"),
    ],
)
def test_same_as_a_plain_count(spark, settings, rule, batch):
    settings(spark__sql__execution__arrow__maxRecordsPerBatch=batch)
    agrees(spark, corpus(1), rule)


def test_a_line_that_every_document_has(spark, settings):
    """Its records are spread over all ranges and are still counted together."""
    settings(spark__sql__execution__arrow__maxRecordsPerBatch="5")
    rows = [(n, f"Menu\nown {n}\nmenu ") for n in range(200)]
    agrees(spark, rows, LineRule())
    agrees(spark, rows, LineRule(150, keep_first=True))


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(None, "a\nb"), (None, "a\nb"), (None, None), (1, None), (1, ""), (1, "a"), (1, "a"), (2, "a\n\n"), (3, "\n\n\n"), (4, "A"), (4, "b")]
    for rule in (LineRule(2), LineRule(3), LineRule(2, keep_first=True), LineRule(5)):
        agrees(spark, rows, rule)


def test_a_very_long_text(spark):
    rows = [(1, "\n".join(["same"] * 200_000 + ["own"])), (2, "x" * 2_000_000 + "\nsame"), (3, "same")]
    agrees(spark, rows, LineRule(3))


def test_no_rows(spark):
    assert dedup(spark, [], LineRule()) == []


def test_clashing_names(spark):
    rows = [(n, "same", 7, "k", 1.5, None) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_lines int, kept string, `a.b` double, _text string")
    found = linededup.kept_text(docs, linededup.keep_bitmaps(docs))
    assert found.columns == ["doc_id", "text", "a.b", "_text", "n_lines", "n_dropped", "kept"]
    assert {tuple(row)[1:] for row in found.collect()} == {("same", 1.5, None, 1, 1, "")}


def test_bitmaps_are_small_and_hold_no_text(spark):
    docs = spark.createDataFrame([(n, "\n".join(["menu"] * 4_000)) for n in range(10)], SCHEMA)
    bitmaps = linededup.keep_bitmaps(docs)
    assert bitmaps.columns == ["doc_id", "text_key", "n_lines", "n_dropped", "keep"]
    assert all(len(row["keep"]) < 30 and row["n_dropped"] == 4_000 for row in bitmaps.collect())


def test_the_digest_of_the_query(spark):
    from conftest import SMALL
    from tallydesk.llm import queries

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = brute([tuple(row) for row in docs], LineRule())
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_line_dedup"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for (n, _), (lines, dropped, kept) in expected.items():
        assert tuple(got[n])[:4] == (n, lines, dropped, hashlib.sha256(kept.encode()).hexdigest())
