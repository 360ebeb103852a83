"""Reading model answers: fence-stripped JSON text to typed columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import non_empty, strip, strip_code_fence

REQUIRED_SUMMARY_KEYS = ("timeline_narrative", "cross_source_synthesis", "progressive_summary")


#: What Spark's reader allows beyond JSON.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_exact(content: Column, schema: T.DataType) -> Column:
    """The text parsed when it is exactly one JSON value, else null.

    Spark's JSON reader accepts trailing junk after the first value; inside an
    array it does not, so the text is read as the only element of one.
    """
    as_array = F.from_json(F.concat(F.lit("["), content, F.lit("]")), T.ArrayType(schema), _STRICT)
    return F.when(F.size(as_array) == 1, F.try_element_at(as_array, F.lit(1)))


def parse_strict(content: Column, schema: T.StructType) -> Column:
    """Fence-stripped answer as a struct, null when it cannot be read."""
    return parse_exact(strip_code_fence(content), schema)


def answer_lists(content: Column, fields: list[str]) -> Column:
    """The named lists of an answer, each as the text it was written as; null when the answer can't be read."""
    return parse_strict(content, T.StructType([T.StructField(f, T.StringType()) for f in fields]))


def elements(listed: Column) -> Column:
    """The elements of a list's text, each as text of its own; null when it is no list."""
    return parse_exact(listed, T.ArrayType(T.StringType()))


def as_object(element: Column, schema: T.StructType) -> Column:
    """An element as a struct, null when it is no object."""
    return F.when(element.startswith("{"), parse_exact(element, schema))


def as_id(text: Column) -> Column:
    """A whole number, written with or without quotes or a zero fraction."""
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))


def zero_as(value: Column, default: float) -> Column:
    """A missing or zero number takes the default."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


@F.pandas_udf(T.StringType())
def _longest_object(content: pd.Series) -> pd.Series:
    """From the first brace, the longest prefix that is an object with all required keys.

    One decode from the brace finds the only prefix that can be a whole
    object: a JSON object ends where its braces balance.
    """

    def recover(text):
        start = -1 if text is None else text.find("{")
        if start < 0:
            return None
        try:
            value, end = json.JSONDecoder().raw_decode(text, start)
        except ValueError:
            return None
        return text[start:end] if all(k in value for k in REQUIRED_SUMMARY_KEYS) else None

    return content.map(recover, na_action="ignore")


def recover_summary(content: Column) -> Column:
    return _longest_object(strip_code_fence(content))


_NO_SUMMARY = "(no summary has been generated for this event yet)"
_EMPTY_SUMMARY = "(summary exists but is empty)"


def _headed(heading: str, lines: Column) -> Column:
    """Heading plus lines; null when there is nothing to list."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(heading + "\n"), F.array_join(lines, "\n")))


def summary_block(summary: Column) -> Column:
    """Flatten a summary struct into the text block shown with a question."""
    text = lambda c: F.coalesce(c, F.lit(""))
    points = F.transform(F.slice(summary["key_developments"], 1, 5), lambda k: F.concat(F.lit("- "), text(k)))
    timeline = F.transform(
        F.filter(summary["timeline_narrative"], lambda e: text(e["text"]) != ""),
        lambda e: F.concat(F.lit("  - "), text(e["date"]), F.lit(": "), e["text"]),
    )
    sources = F.transform(
        F.filter(summary["cross_source_synthesis"]["by_source"], lambda e: text(e["observation"]) != ""),
        lambda e: F.concat(F.lit("  - "), F.coalesce(non_empty(e["source"]), F.lit("Unknown")), F.lit(": "), e["observation"]),
    )
    timeline_head = F.when(F.size(summary["timeline_narrative"]) > 0, F.lit("Timeline:"))
    sources_head = F.when(F.size(summary["cross_source_synthesis"]["by_source"]) > 0, F.lit("By source:"))
    progressive = non_empty(strip(summary["progressive_summary"]))
    synthesis = non_empty(strip(summary["cross_source_synthesis"]["synthesis"]))
    block = F.concat_ws(
        "\n",
        _headed("Key developments:", points),
        F.concat(F.lit("Progressive update: "), progressive),
        timeline_head,
        F.when(F.size(timeline) > 0, F.array_join(timeline, "\n")),
        F.concat(F.lit("Cross-source synthesis: "), synthesis),
        sources_head,
        F.when(F.size(sources) > 0, F.array_join(sources, "\n")),
    )
    return F.when(summary.isNull(), F.lit(_NO_SUMMARY)).otherwise(F.coalesce(non_empty(block), F.lit(_EMPTY_SUMMARY)))
