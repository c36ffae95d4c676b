"""Leaks against brute force over the sets of shingles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallydesk.llm import decontamination


def shingles(text):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(found[n : n + 5]) for n in range(max(1, len(found) - 4))} if found else set()


def brute(docs, items):
    found = set()
    for doc, text in docs:
        for item, wanted in items:
            held = len(shingles(text) & shingles(wanted))
            if shingles(wanted) and 100 * held >= 80 * len(shingles(wanted)):
                found.add((doc, item, len(shingles(wanted)), held))
    return sorted(found, key=str)


def leaks(spark, docs, items):
    found = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return sorted({(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found.collect()}, key=str)


def test_same_as_brute_force(spark):
    draw = random.Random(2)
    word = lambda: draw.choice("abcdefgh") + draw.choice("xyz")
    items = [(n, " ".join(word() for _ in range(draw.choice([1, 3, 5, 9, 20, 60])))) for n in range(40)]
    docs = []
    for n in range(150):
        text = [word() for _ in range(draw.choice([0, 4, 50, 3000]))]
        if n % 3:
            held = draw.choice(items)[1].split()
            cut = draw.randrange(max(1, len(held) // 3))
            text[len(text) // 2 : len(text) // 2] = held[cut:]
        docs.append((n, ", ".join(text).upper() if n % 5 == 0 else " ".join(text)))
    docs += [(900, None), (901, ""), (902, "--- !"), (None, items[5][1]), (903, items[5][1]), (903, items[5][1])]
    assert leaks(spark, docs, [*items, (77, None), (78, ""), items[0]]) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert leaks(spark, docs, items) == []


def test_large_item_tables_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    docs, items = [(1, "z a b c d e f g z"), (2, "q")], [(5, "a b c d e f g")]
    assert leaks(spark, docs, items) == brute(docs, items)


def test_rows_that_hold_nothing_stay_with_all_columns(spark):
    passage = "one two three four five six seven"
    rows = [(None, passage), (None, "fine text"), (1, f"x {passage} y"), (2, None), (2, "other"), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("words", F.lit("w"))
    items = spark.createDataFrame([(3, passage)], "item_id long, text string")
    kept = decontamination.without_contaminated(docs, decontamination.contaminated(docs, items))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "fine text"), (2, ""), (2, "other"), (2, "other")]


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    plan = decontamination.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
