"""Licence statements against a scan of every place."""

import re

import pytest
from pyspark.sql import functions as F

from tallydesk.llm import licenses


def words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, templates=licenses.TEMPLATES):
    found, places = words(text), []
    for template in templates:
        phrases = template.mandatory()
        for start in range(len(found)):
            if not all(found[start + at : start + at + len(p)] == p for at, p in phrases):
                continue
            same = sum(found[start + n : start + n + 1] == [word] for n, word in enumerate(template.words))
            if same * 100 >= template.percent * len(template.words):
                places.append((template.label, template.base, start, same / len(template.words)))
    return len(found), sorted(places)


TEXTS = [
    "Licensed under CC BY-NC 4.0. All rights reserved. (c) ALL RIGHTS RESERVED",
    "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more",
    "Permission is hereby granted, free of charge, to any being obtaining a copy of this software",
    "Permission is hereby granted, free of charge.",
    "general public licenses; rights reserved; all rights",
    "cc cc by by cc by",
    "naïve by cc by cc by",
    "",
    None,
    "!!! ---",
    "Released under the MIT License." + " the of and by" * 3000 + " Apache License, Version 2.0",
    "cc " * 3000 + "by",
    "reserved",
    "İ all rights reservedİ all RIGHTS reserved",
    *("x " * n + template.text for n, template in enumerate(licenses.KNOWN)),
]


def test_same_as_a_scan_of_every_place(spark):
    rows = [(n, text) for n, text in enumerate(TEXTS)] + [(0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x")).withColumn("post", F.lit(1))
    got = licenses.scan(docs)
    assert got.columns[:3] == ["doc_id", "text", "post"] and got.count() == len(rows)
    for row in got.collect():
        n, places = brute(row["text"])
        assert row["n_words"] == n
        assert sorted((p["label"], p["is_base"], p["start"], p["coverage"]) for p in row["places"]) == places
        assert row["labels"] == sorted({label for label, *_ in places})
        assert row["base_labels"] == sorted({label for label, base, *_ in places if base})
        assert row["score"] == max((p[3] for p in places), default=0)


def test_no_rows_give_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_runs_and_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def long_templates(number):
    """Whole texts of 400 words, of a vocabulary that they share, with two key phrases each."""
    made = []
    for n in range(number):
        text = [f"w{(n * 7919 + k * k * 31) % 997}" for k in range(400)]
        text[50:53], text[300:302] = ["grant", f"own{n}", "rights"], ["no", f"warranty{n % 5}"]
        made.append(licenses.Template(f"long-{n % 40}", " ".join(text), (" ".join(text[48:56]), " ".join(text[299:303]))))
    return tuple(made)


def test_whole_licence_texts_as_templates(spark):
    templates = long_templates(60)
    words_of = [template.words for template in templates]
    changed = words_of[7][:100] + ["other"] * 50 + words_of[7][150:]
    broken = words_of[8][:301] + ["other"] + words_of[8][302:]
    few = words_of[9][:100] + ["other"] * 90 + words_of[9][190:]
    texts = [
        " ".join(["before"] * 3 + words_of[3] + ["between"] + words_of[3] + words_of[59]),
        *(" ".join(text) for text in (changed, broken, few, words_of[11][1:])),
        " ".join(word for text in words_of for word in text),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan(docs, templates).collect():
        n, places = brute(row["text"], templates)
        assert (row["n_words"], sorted((p["label"], p["is_base"], p["start"], p["coverage"]) for p in row["places"])) == (n, places)
        assert len(places) == [3, 1, 0, 0, 0, 60][row["doc_id"]]


def test_the_plan_does_not_grow_with_templates(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")

    def expressions(number):
        plan = licenses.scan(docs, long_templates(number))._jdf.queryExecution().analyzed().toString()
        return sum(plan.count(name) for name in ("lambdafunction", "transform(", "filter(", "slice(", "array_intersect("))

    assert expressions(2) == expressions(60)


def test_templates_that_can_not_be_looked_up_are_refused(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    with pytest.raises(ValueError, match="no part"):
        licenses.scan(docs, [licenses.Template("none", "")])
    assert licenses.scan(docs, []).first()["labels"] == []
