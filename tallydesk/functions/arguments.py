"""Arguments of tool calls, which arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallydesk import rules


def is_one_json_value(text: Column) -> Column:
    """True for text holding exactly one JSON value.

    A lenient parser stops after the first value, so the text is tested inside brackets: anything
    left over then breaks the array or adds a second element. Text that closes the brackets itself
    can't close the braces of an object as well.
    """
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    named = F.concat(F.lit('{"a":'), text, F.lit("}"))
    return (
        F.try_parse_json(boxed).isNotNull()
        & F.try_parse_json(named).isNotNull()
        & (F.coalesce(F.json_array_length(boxed), F.lit(0)) == 1)
    )


def parsed_arguments(arguments: Column) -> Column:
    """STRUCT<input, is_valid>: the JSON to work with; an error object for broken text."""
    text = F.coalesce(arguments, F.lit(""))
    valid = (text == "") | is_one_json_value(text)
    error = F.to_json(F.struct(F.lit(rules.BAD_ARGUMENTS).alias("error")))
    return F.struct(
        F.when(text == "", F.lit("{}")).when(valid, text).otherwise(error).alias("input"),
        valid.alias("is_valid"),
    )
