"""JSON objects inside free text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _body(text: Column) -> Column:
    """The text without surrounding blanks and, if fenced, without its code fence."""
    t = F.trim(text)
    inner = F.regexp_replace(t, r"^```[^\n]*\n?", "")
    unfenced = F.regexp_replace(inner, r"(?s)\s*```(?:(?!```).)*$", "")
    return F.when(t.startswith("```"), unfenced).otherwise(t)


@F.pandas_udf(T.StringType())
def _longest_prefix(texts: pd.Series) -> pd.Series:
    """Longest parsable run from the first opening to some closing brace."""

    def find(text):
        start = (text or "").find("{")
        if start < 0:
            return None
        try:
            _, end = json.JSONDecoder().raw_decode(text, start)
            return text[start:end]
        except ValueError:
            return None

    return texts.map(find)


def extract_object(text: Column, schema: T.StructType) -> Column:
    """Struct parsed from a whole object, an object inside prose, or one cut inside its last string."""
    body = _body(text)

    def parsed(candidate):
        value = F.from_json(candidate, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        whole = F.try_parse_json(candidate).isNotNull()
        return F.when(whole, value)

    greedy = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    opened = F.nullif(F.regexp_extract(body, r"(?s)(\{.*)$", 1), F.lit(""))
    closed = F.concat(opened, F.lit('"}'))
    # Only rows that no cheaper rule can parse reach the Python helper.
    cheap = F.coalesce(F.try_parse_json(body), F.try_parse_json(greedy)).isNotNull()
    rest = F.when(~F.coalesce(cheap, F.lit(False)), body)
    return F.coalesce(parsed(body), parsed(greedy), parsed(_longest_prefix(rest)), parsed(closed))
