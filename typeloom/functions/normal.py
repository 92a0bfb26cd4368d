"""Schemas as a validator sees them that doesn't know the reference keywords.

Reference keywords go. What they alone told apart goes with them: ``oneOf`` whose branches differ by them becomes
``anyOf``, branches that say nothing more go, and so do ``not`` and conditions that bear one, for without it they would
hold for every value; reference checks judge those. Keys with a doubled ``$`` lose one where no dialect is named.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import jsons

# Reference keywords, and the keywords below which schemas are rewritten, by how they hold them.
KEYWORDS = ("x-gts-type-ref", "x-gts-instance-ref", "x-gts-pattern-ref")
BY_NAME = ("properties", "patternProperties", "definitions", "$defs", "dependentSchemas")
LISTED = ("oneOf", "anyOf", "allOf", "prefixItems")
SINGLE = ("items", "additionalItems", "additionalProperties", "contains", "not", "if", "then", "else")
CONDITION = ("if", "then", "else")


def bears(node) -> bool:
    """Whether a reference keyword stands anywhere in a schema."""
    open_ = [node]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            if not x.keys().isdisjoint(KEYWORDS):
                return True
            open_ += x.values()
        elif isinstance(x, list):
            open_ += x
    return False


def _single(node):
    """Without doubled ``$`` in keys."""
    if isinstance(node, dict):
        return {k[1:] if k.startswith("$$") and len(k) > 2 else k: _single(x) for k, x in node.items()}
    return [_single(x) for x in node] if isinstance(node, list) else node


def stripped(schema):
    """A schema without reference keywords, by the rules above."""
    if not isinstance(schema, dict):
        return schema
    out = {k: x for k, x in schema.items() if k not in KEYWORDS}
    if bears(schema.get("if")):
        out = {k: x for k, x in out.items() if k not in CONDITION}
    if isinstance(schema.get("not"), dict) and bears(schema["not"]):
        del out["not"]
    for key in BY_NAME:
        if isinstance(out.get(key), dict):
            out[key] = {name: stripped(x) for name, x in out[key].items()}
    for key in SINGLE:
        if key in out:
            out[key] = stripped(out[key])
    for key in LISTED:
        if not isinstance(out.get(key), list):
            continue
        named = any(isinstance(x, dict) and not x.keys().isdisjoint(KEYWORDS) for x in out[key])
        out[key] = [stripped(x) for x in out[key]]
        if out[key] and all(x == {} for x in out[key]):
            del out[key]
        elif key == "oneOf" and named and "anyOf" not in schema:
            out["anyOf"] = out.pop("oneOf")
    return out


def normalised(schema):
    """The schema that is evaluated."""
    return stripped(schema if not isinstance(schema, dict) or "$schema" in schema else _single(schema))


@F.pandas_udf(StringType())
def normal_form(content: pd.Series) -> pd.Series:
    """``normalised`` as JSON text, for a column of schemas; null for what isn't JSON."""
    parsed = content.map(jsons._parsed)
    return parsed.map(lambda x: None if x is None else json.dumps(normalised(x), ensure_ascii=False))
