"""Text expressions: trimming, sectioning, tokens and keyword rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallydesk import rules

KeywordRules = Sequence[tuple[str, Sequence[str]]]

_OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def sections(text: Column, header: str = rules.SECTION_HEADER) -> Column:
    """ARRAY<STRUCT<section, text>>: the text cut in front of every header.

    What precedes the first header is a section of its own. Blank parts are dropped; a text of
    nothing but blank parts is kept whole under a stand-in title.
    """
    whole = F.coalesce(text, F.lit(""))
    parts = F.filter(F.transform(F.split(whole, header), strip_space), lambda part: part != "")
    titled = F.transform(
        parts,
        lambda part: F.struct(
            strip_space(F.substring_index(part, "\n", 1)).alias("section"), part.alias("text")
        ),
    )
    fallback = F.array(F.struct(F.lit(rules.WHOLE_DOCUMENT).alias("section"), whole.alias("text")))
    return F.when(F.size(titled) == 0, fallback).otherwise(titled)


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more characters, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rules.TOKEN), F.lit(0))


def counted(df: DataFrame, words: str, term: str, times: str) -> DataFrame:
    """The rows with an array of words replaced by its distinct words and how often each occurs.

    Words are sorted inside the row and their runs measured, so nothing is shuffled. Lambdas see words
    and places only; terms and counts are put together outside of them, as structs made in a lambda
    cost more than all the rest. Arrays that lambdas refer to are made by a generator, as an
    expression would be put into every lambda and be worked out again for every element.
    """
    kept = [c for c in df.columns if c != words]
    in_order = df.select(*kept, F.explode(F.array(F.sort_array(words))).alias(words))
    new = F.array_compact(F.transform(words, lambda word, place: F.when(~word.eqNullSafe(F.get(words, place - 1)), place)))
    starts = in_order.select("*", F.explode(F.array(new)).alias("_starts"))
    runs = F.transform("_starts", lambda start, number: (F.coalesce(F.get("_starts", number + 1), F.size(words)) - start).cast("long"))
    apart = starts.select(*kept, F.array_distinct(words).alias(term), runs.alias(times))
    return apart.select(*kept, F.explode(F.array(F.arrays_zip(term, times))).alias(words)).select(*df.columns)


def ticket_text(subject: Column, description: Column) -> Column:
    """Lower-cased subject and description; a keyword may span the blank between them."""
    return F.lower(
        F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    )


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    """True where any keyword occurs in the text, also inside a word."""
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(text, F.lit(keyword))
    return found


def first_rule(text: Column, keyword_rules: KeywordRules, default: str | None = None) -> Column:
    """Name of the first rule, in the given order, with a keyword in the text; else the default."""
    return F.coalesce(
        *[F.when(contains_any(text, words), F.lit(name)) for name, words in keyword_rules],
        F.lit(default).cast("string"),
    )
