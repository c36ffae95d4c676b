"""Licence statements in documents, by a positional index of rare words.

A template is a run of words with mandatory key phrases in it. The index holds postings of templates
under words: each template is posted under those words of its key phrases that are rarest in the
corpus (highest IDF), with the place the word has in the template. A file looks its own words up
that the index holds. Each lookup gives templates and, moved back by the word's place, starts; the
postings of all words of a template must meet in one start. What is left is verified phrase by
phrase, then word by word.

The index and the templates are constants of the plan: the number of its expressions does not grow
with them. All of it runs on the arrays of one row: no word of a document is shuffled. Only the
document frequencies of the licence words, whose number the templates bound, reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallydesk.llm.common import col, worked_out


@dataclass(frozen=True)
class Template:
    """A statement and its mandatory ``phrases``, all in lower case; ``base`` ones are counted place by place.

    A place counts if all phrases stand where the statement has them and ``percent`` of its words agree.
    """

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False
    percent: int = 80

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def mandatory(self) -> list[tuple[int, list[str]]]:
        """The place of each key phrase in the statement, and its words."""
        found = []
        for phrase in self.phrases or (self.text,):
            wanted = phrase.split()
            starts = [n for n in range(len(self.words)) if self.words[n : n + len(wanted)] == wanted]
            if not wanted or not starts:
                raise ValueError(f"{phrase!r} is no part of {self.text!r}")
            found.append((starts[0], wanted))
        return found


# The base phrases and their labels.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

# The usual statements of the names of well-known licences, sentences and notices of them.
KNOWN = (
    Template("apache-2.0", "apache license version 2 0"),
    Template("mit", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc0-1.0", "cc0 1 0 universal"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",),
    ),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("to deal in the software without restriction", "sublicense and or sell copies of the software", "merchantability fitness for a particular purpose"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version",
        ("you can redistribute it and or modify it", "either version 2 of the license"),
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ("you can redistribute it and or modify it", "either version 3 of the license"),
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce"),
    ),
)

TEMPLATES = BASE + KNOWN

# Under how many of its words, the rarest, a template is posted.
RARE_WORDS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case A-Z; runs of letters, digits and all that is not ASCII. A null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def document_frequencies(found: DataFrame, templates: Sequence[Template], words_column: str) -> dict[str, int]:
    """In how many documents each licence word occurs, over all of them."""
    vocabulary = sorted({word for template in templates for _, phrase in template.mandatory() for word in phrase})
    counted = (
        found.select(F.explode(F.array_intersect(col(words_column), _strings(vocabulary))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return {word: 0 for word in vocabulary} | {row["word"]: row["df"] for row in counted.collect()}


def _rarest(template: Template, frequency: dict[str, int]) -> list[tuple[int, str]]:
    """(place, word) of the words of its key phrases with the highest IDF."""
    places = {word: at + n for at, phrase in template.mandatory() for n, word in enumerate(phrase)}
    chosen = sorted(places, key=lambda word: (frequency[word], word))[:RARE_WORDS]
    return [(places[word], word) for word in chosen]


def positional_index(templates: Sequence[Template], frequency: dict[str, int]) -> list[dict[str, list[dict]]]:
    """From the rarest words of the templates on: word -> the templates posted under it and its place in them.

    A template with fewer words than that is posted under its last one again.
    """
    postings: list[dict[str, list[dict]]] = [{} for _ in range(RARE_WORDS)]
    for number, template in enumerate(templates):
        rare = _rarest(template, frequency)
        for n, posted in enumerate(postings):
            place, word = rare[min(n, len(rare) - 1)]
            posted.setdefault(word, []).append({"template": number, "at": place})
    return postings


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


_POSTINGS = "map<string, array<struct<template: int, at: int>>>"
_STATEMENTS = (
    "array<struct<label: string, is_base: boolean, percent: int, words: array<string>, phrases: array<struct<at: int, words: array<string>>>>>"
)


def _statements(templates: Sequence[Template]) -> Column:
    return _constant(
        [
            {
                "label": template.label,
                "is_base": template.base,
                "percent": template.percent,
                "words": template.words,
                "phrases": [{"at": at, "words": phrase} for at, phrase in template.mandatory()],
            }
            for template in templates
        ],
        _STATEMENTS,
    )


def _met(postings: dict[str, list[dict]], posted: Column) -> Column:
    """Template and start, in the upper and lower half of a number, of every posting of the file's words."""
    index = _constant(postings, _POSTINGS)

    def starts(post: Column) -> Column:
        fitting = F.filter(F.try_element_at(index, post["word"]), lambda posting: posting["at"] <= post["at"])
        return F.transform(fitting, lambda posting: F.shiftleft(posting["template"].cast("long"), 32) + (post["at"] - posting["at"]))

    return F.flatten(F.transform(F.filter(posted, lambda post: post["word"].isin(sorted(postings))), starts))


def _verified(statements: Column, found: Column, met: Column) -> Column:
    """The places among those met where all key phrases stand and enough words agree."""

    def candidate(number: Column) -> Column:
        start = number.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.struct(F.get(statements, F.shiftright(number, 32).cast("int")).alias("statement"), start.alias("start"))

    def stands(place: Column) -> Column:
        return F.forall(
            place["statement"]["phrases"],
            lambda phrase: F.slice(found, place["start"] + phrase["at"] + 1, F.size(phrase["words"])) == phrase["words"],
        )

    def described(place: Column) -> Column:
        wanted = place["statement"]["words"]
        agrees = F.zip_with(F.slice(found, place["start"] + 1, F.size(wanted)), wanted, lambda word, other: word == other)
        return F.struct(
            place["statement"]["label"].alias("label"),
            place["statement"]["is_base"].alias("is_base"),
            place["start"].cast("long").alias("start"),
            (F.size(F.filter(agrees, lambda same: same)) / F.size(wanted)).alias("coverage"),
            place["statement"]["percent"].alias("percent"),
        )

    places = F.transform(F.filter(F.transform(met, candidate), stands), described)
    enough = F.filter(places, lambda place: place["coverage"] * 100 >= place["percent"])
    return F.transform(enough, lambda place: place.dropFields("percent"))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """The rows with (n_words, places, base_labels, labels, score).

    ``places`` lists every verified place: label, is_base, start (in words, from 0) and coverage.
    ``score`` is the largest coverage, 0 without a place. A null text counts as empty and has no
    place; places that several templates of a label share are listed once each. Repeated rows stay.
    Columns called like the new ones are replaced.
    """
    docs = docs.drop("_words", "_posted", "_met", "n_words", "places", "base_labels", "labels", "score")
    found = worked_out(docs, "_words", words(col(text)))
    postings = positional_index(templates, document_frequencies(found, templates, "_words"))
    sought = sorted(set().union(*postings))
    all_words = F.transform(F.col("_words"), lambda word, n: F.struct(word.alias("word"), n.alias("at")))
    held = F.when(
        F.arrays_overlap(F.col("_words"), _strings(sought)),
        F.filter(all_words, lambda post: post["word"].isin(sought)),
    ).otherwise(F.slice(all_words, 1, 0))
    posted = worked_out(found, "_posted", held)
    met = worked_out(posted, "_met", F.sort_array(reduce(F.array_intersect, [_met(part, F.col("_posted")) for part in postings])))
    placed = worked_out(met, "places", _verified(_statements(templates), F.col("_words"), F.col("_met")))
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda place: place["label"])))
    base = F.filter("places", lambda place: place["is_base"])
    return (
        placed.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("base_labels", F.array_sort(F.array_distinct(F.transform(base, lambda place: place["label"]))))
        .withColumn("labels", labels)
        .withColumn("score", F.coalesce(F.array_max(F.transform("places", lambda place: place["coverage"])), F.lit(0.0)))
        .select(*[col(name) for name in docs.columns], "n_words", "places", "base_labels", "labels", "score")
    )
