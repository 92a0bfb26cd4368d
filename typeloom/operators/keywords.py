"""Every keyword at every position of a schema as a row, and what each dialect, and the own vocabulary, say of it.

``facts`` walks schemas through all keywords that hold schemas (and a traits declaration), not through literals. A
dialect's rules are a table of (keyword, dialect, kind); a join with the facts gives what breaks them, for any number
of schemas at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType

from ..functions import ident, jsons, patterns
from .registry import dialect_of

# Keywords that hold schemas, by how they hold them; literals aren't walked.
BY_NAME = ("properties", "patternProperties", "definitions", "$defs", "dependentSchemas", "dependencies")
LISTED = ("allOf", "anyOf", "oneOf", "prefixItems")
SINGLE = ("items", "additionalItems", "additionalProperties", "contains", "contentSchema", "else", "if", "not", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties", "x-gts-traits-schema")
OWN_TOP = ("x-gts-final", "x-gts-abstract", "x-gts-traits", "x-gts-traits-schema")
OWN_ANY = ("x-gts-type-ref", "x-gts-instance-ref", "x-gts-pattern-ref")
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
# What the dialects' own schemas ask of a keyword's value; "@" stands for the schema itself.
_ALL, _NEW, _LAST = ("draft-07", "2019-09", "2020-12"), ("2019-09", "2020-12"), ("2020-12",)
RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "@": (_ALL, "schema"), "type": (_ALL, "types"), "required": (_ALL, "names"), "enum": (_ALL, "array"), "examples": (_ALL, "array"), "dependencies": (_ALL, "dependencies"),
    "dependentRequired": (_NEW, "names by name"), "multipleOf": (_ALL, "positive"), "items": (_ALL, "schema or list"), "prefixItems": (_LAST, "list"),
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"), (_ALL, "count")), **dict.fromkeys(("minContains", "maxContains"), (_NEW, "count")),
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), (_ALL, "number")),
    **dict.fromkeys(("uniqueItems", "readOnly"), (_ALL, "boolean")), "writeOnly": (_ALL, "boolean"), "deprecated": (_NEW, "boolean"), "$recursiveAnchor": (("2019-09",), "boolean"),
    **dict.fromkeys(("pattern", "format", "title", "description", "$comment", "$ref", "$schema", "contentMediaType", "contentEncoding"), (_ALL, "text")),
    "$id": (_ALL, "text"), "$anchor": (_NEW, "anchor"), "$recursiveRef": (("2019-09",), "text"), "$dynamicRef": (_LAST, "text"), "$dynamicAnchor": (_LAST, "anchor"),
    **dict.fromkeys(("allOf", "anyOf", "oneOf"), (_ALL, "list")), **dict.fromkeys(("properties", "patternProperties", "definitions"), (_ALL, "object")), **dict.fromkeys(("$defs", "dependentSchemas"), (_NEW, "object")),
    **dict.fromkeys(("additionalItems", "additionalProperties", "contains", "else", "if", "not", "propertyNames", "then"), (_ALL, "schema")), **dict.fromkeys(("contentSchema", "unevaluatedItems", "unevaluatedProperties"), (_NEW, "schema")),
}

FACT = StructType()
for _name, _kind in (("pointer", StringType()), ("keyword", StringType()), ("kind", StringType()), ("size", IntegerType()), ("texts", ArrayType(StringType())), ("text", StringType()), ("number", DoubleType()), ("leads", BooleanType())):
    FACT.add(_name, _kind)


def _fact(pointer: str, keyword: str, x, root) -> dict:
    kind = "null" if x is None else {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(x)]
    below = x if isinstance(x, list) else [n for y in x.values() for n in (y if isinstance(y, list) else [])] if isinstance(x, dict) else None
    texts = below if below is not None and all(isinstance(y, str) for y in below) else None
    if keyword == "dependentRequired" and isinstance(x, dict) and not all(isinstance(y, list) and len(set(map(repr, y))) == len(y) for y in x.values()):
        texts = None
    leads = jsons.local_target(root, x[1:]) is not None if keyword == "$ref" and isinstance(x, str) and x.startswith("#") else None
    number = float(x) if kind == "number" else None
    return {"pointer": pointer, "keyword": keyword, "kind": kind, "size": None if below is None else len(x), "texts": texts, "text": x if isinstance(x, str) else None, "number": number, "leads": leads}


def _facts(text):
    root = jsons._parsed(text)
    rows, todo = [], [(root, "#", root)]
    while todo:
        schema, at, base = todo.pop()
        rows.append(_fact(at, "@", schema, base))
        if not isinstance(schema, dict):
            continue
        base = schema if jsons.is_resource(schema) else base
        rows += [_fact(at, k, x, base) for k, x in schema.items()]
        step = lambda *names: "/".join((at, *(str(n).replace("~", "~0").replace("/", "~1") for n in names)))  # noqa: E731,B023
        for key in BY_NAME:
            if isinstance(schema.get(key), dict):
                todo += [(x, step(key, name), base) for name, x in schema[key].items() if not (key == "dependencies" and isinstance(x, list))]
                if key == "patternProperties":
                    rows += [_fact(step(key), "pattern", name, base) for name in schema[key]]
        for key in LISTED:
            if isinstance(schema.get(key), list):
                todo += [(x, step(key, i), base) for i, x in enumerate(schema[key])]
        for key in SINGLE:
            if key == "items" and isinstance(schema.get(key), list):
                todo += [(x, step(key, i), base) for i, x in enumerate(schema[key])]
            elif key in schema:
                todo.append((schema[key], step(key), base))
    return rows


@F.pandas_udf(ArrayType(FACT))
def _walked(content: pd.Series) -> pd.Series:
    return content.map(_facts)


def facts(schemas: DataFrame) -> DataFrame:
    """type_id, dialect and a row for each keyword at each position of the schemas (entity_key, content); ``@`` is the schema itself."""
    dialect = dialect_of(jsons.as_string(jsons.member(jsons.variant(F.col("content")), "$schema")))
    return schemas.select(F.col("entity_key").alias("type_id"), dialect.alias("dialect"), F.explode(_walked("content")).alias("n")).select("type_id", "dialect", "n.*")


def _error(df: DataFrame, text: Column) -> DataFrame:
    return df.select("type_id", F.concat("pointer", F.lit(": "), text).alias("error")).filter("error IS NOT NULL")


def dialect_errors(found: DataFrame) -> DataFrame:
    """type_id, error of keywords whose values the dialect's own schema doesn't admit."""
    rows = [(k, d, rule) for k, (dialects, rule) in RULES.items() for d in dialects]
    rules = found.sparkSession.createDataFrame(rows, "keyword string, dialect string, rule string")
    met = found.join(F.broadcast(rules), ["keyword", "dialect"])  # a fixed table
    rule, kind = F.col("rule"), F.col("kind")
    listed = (kind == "array") & (F.col("size") > 0)
    distinct = F.coalesce(F.size(F.array_distinct("texts")) == F.size("texts"), F.lit(False))
    schema = kind.isin("object", "boolean")
    known = F.coalesce(F.size(F.array_except("texts", F.array(*map(F.lit, TYPES)))) == 0, F.lit(False))
    whole = F.col("number") == F.floor("number")
    holds = (
        F.when(rule == "schema", schema).when(rule == "schema or list", schema | (listed & (F.col("dialect") != "2020-12"))).when(rule == "list", listed).when(rule == "object", kind == "object")
        .when(rule == "types", F.col("text").isin(*TYPES) | (listed & distinct & known)).when(rule == "names", (kind == "array") & distinct).when(rule == "array", kind == "array")
        .when(rule == "names by name", (kind == "object") & F.col("texts").isNotNull()).when(rule == "dependencies", (kind == "object") & F.col("texts").isNotNull())
        .when(rule == "count", whole & (F.col("number") >= 0)).when(rule == "number", kind == "number").when(rule == "positive", F.col("number") > 0)
        .when(rule == "boolean", kind == "boolean").when(rule == "anchor", F.col("text").rlike(r"^[A-Za-z_][-A-Za-z0-9._]*\z")).otherwise(kind == "string")
    )
    return _error(met.filter(~F.coalesce(holds, F.lit(False))), F.concat("keyword", F.lit(" must be "), F.when(F.col("keyword") == "@", "a schema").otherwise(F.col("rule"))))


def own_errors(found: DataFrame) -> DataFrame:
    """type_id, error of own keywords that don't exist or stand in the wrong place, and of types that aren't texts."""
    own = F.col("keyword").startswith("x-gts-")
    why = (
        F.when(own & ~F.col("keyword").isin(*OWN_TOP, *OWN_ANY), F.concat(F.lit("unknown keyword "), "keyword"))
        .when(F.col("keyword").isin(*OWN_TOP) & (F.col("pointer") != "#"), F.concat("keyword", F.lit(" must stand at the top")))
        .when((F.col("keyword") == "type") & (F.col("kind") != "string") & ((F.col("kind") != "array") | F.col("texts").isNull()), "type must be a text or a list of texts")
    )
    return _error(found, why)


def reference_shapes(found: DataFrame) -> DataFrame:
    """type_id, error of references that are neither local ones which lead somewhere nor name a type or pattern."""
    refs = found.filter("keyword = '$ref' AND text IS NOT NULL")
    text = F.col("text")
    named = F.regexp_replace(F.regexp_replace(text, "^gts://", ""), "#.*", "")
    why = F.when(text.startswith("#"), F.when(~F.col("leads"), F.concat(F.lit("$ref leads nowhere: "), text))).when(~text.startswith("gts://") | ~ident.is_pattern(named), F.concat(F.lit("unsupported $ref: "), text))
    return _error(refs, why)


def pattern_errors(found: DataFrame) -> DataFrame:
    """type_id, error of regular expressions, as values or as names of members, that aren't admitted."""
    @F.pandas_udf(StringType())
    def refused(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else patterns.refusal(t))

    rows = found.filter("keyword = 'pattern' AND text IS NOT NULL").withColumn("why", refused("text"))
    return _error(rows.filter("why IS NOT NULL"), F.concat(F.lit("pattern: "), "why"))
