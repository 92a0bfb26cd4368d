"""JSON text as Column expressions: ids, leaves, paths, canonical form.

All but ``strings`` and ``canonical`` stay in the JVM; those two walk a document of any shape in Arrow batches.
A text that isn't JSON, or null, gives null (``strings``: an empty list).
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from . import ident
from .ident import let

# Fixed field orders.
ID_FIELDS = ("gtsId", "gtsIid", "gtsOid", "gtsI", "gts_id", "gts_oid", "gts_iid", "id", "$$id", "$id")
HTTP_ID_FIELDS = ("$id", "gtsId", "gtsIid", "gtsOid", "gtsI", "gts_id", "gts_oid", "gts_iid", "id")
SCHEMA_FIELDS = ("gtsTid", "gtsType", "gtsT", "gts_t", "gts_tid", "gts_type", "type", "schema")
MAX_DEPTH = 512


def variant(content: Column) -> Column:
    return F.try_parse_json(content)


def member(v: Column, key: str) -> Column:
    """The variant under a key of an object, else null. Keys with a quote can't be written as a path and go by map."""
    if "'" in key or "?" in key:
        return F.try_variant_get(v, "$", "map<string,variant>")[key]
    return F.try_variant_get(v, f"$['{key}']", "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL or VOID; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def as_string(v: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number_text(x: Column) -> Column:
    """Shortest round-trip text of a double: plain from 1e-5 up to 1e15, else with a signed exponent of two digits or more."""
    java = x.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,22)").cast("string"), r"\.?0+\z", "")
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)\z", 1).try_cast("int")
    digits = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0"))
    scientific = F.concat(F.regexp_replace(F.regexp_extract(java, "^([^E]*)", 1), r"\.0\z", ""), F.when(exponent < 0, "E-").otherwise("E+"), digits)
    size = F.abs(x)
    return F.when(x == 0, "0").when((size >= 1e-5) & (size < 1e15), plain).otherwise(scientific)


def leaf_text(v: Column) -> Column:
    """What an attribute filter compares: texts as they are, true or false, numbers without needless digits, "" for
    JSON null, and compact JSON for objects and arrays. Null where there is nothing."""
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind(v).isin("STRING", "BIGINT", "BOOLEAN"), text)
        .when(kind(v).isin("DOUBLE", "DECIMAL", "FLOAT"), _number_text(number))
        .when(kind(v) == "VOID", "")
        .when(kind(v).isin("OBJECT", "ARRAY"), F.to_json(v))
    )


def _first_field(v: Column, fields: tuple[str, ...]) -> Column:
    """struct(field, value): the first field with an identifier, or else the first with text."""
    def value(f: str) -> Column:
        text = F.trim(as_string(member(v, f)))
        return ident.strip_uri(text) if f in ("$id", "$$id") else text

    found = F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields))

    def choice(found: Column) -> Column:
        named = F.filter(found, lambda x: ident.is_valid_legacy(x["value"]) | ident.is_legacy_pattern(x["value"]))
        filled = F.filter(found, lambda x: F.coalesce(F.length(x["value"]) > 0, F.lit(False)))
        return F.coalesce(F.get(named, F.lit(0)), F.get(filled, F.lit(0)))

    return let(found, choice)


def extract(content: Column, id_fields: tuple[str, ...] = ID_FIELDS, schema_fields: tuple[str, ...] = SCHEMA_FIELDS) -> Column:
    """struct(id, id_field, schema_id, schema_field, is_schema) of a JSON object; all null for anything else.

    A document with ``$schema`` is a type. A type's schema id is its parent in the chain, else its dialect. An
    instance's is the chain before its last segment, else what the schema fields give.
    """
    double = any(f.startswith("$$") for f in id_fields)

    def found(v: Column) -> Column:
        dialect = as_string(member(v, "$schema"))
        return F.struct(
            F.coalesce(kind(v) == "OBJECT", F.lit(False)).alias("object"),
            (F.coalesce(dialect, as_string(member(v, "$$schema"))) if double else dialect).alias("dialect"),
            _first_field(v, id_fields).alias("id"), _first_field(v, schema_fields).alias("typed"),
        )

    def result(x: Column) -> Column:
        value, field, dialect = x["id"]["value"], x["id"]["field"], x["dialect"]
        chained = F.when(ident.is_valid_legacy(value), ident.type_of(value))
        own = F.when(~field.isin("$id", "$$id"), chained)
        return F.struct(
            F.when(x["object"], value).alias("id"),
            F.when(x["object"], field).alias("id_field"),
            F.when(~x["object"], None).when(dialect.isNotNull(), F.coalesce(chained, dialect)).otherwise(F.coalesce(own, x["typed"]["value"])).alias("schema_id"),
            F.when(~x["object"] | dialect.isNotNull() | own.isNotNull(), None).otherwise(x["typed"]["field"]).alias("schema_field"),
            (x["object"] & dialect.isNotNull()).alias("is_schema"),
        )

    return let(let(variant(content), found), result)


def _walk(node, path: str = "", depth: int = 0):
    if depth >= MAX_DEPTH:
        return
    if isinstance(node, str):
        yield {"path": path or "root", "value": node}
    elif isinstance(node, dict):
        for key, x in node.items():
            yield from _walk(x, f"{path}.{key}" if path else key, depth + 1)
    elif isinstance(node, list):
        for i, x in enumerate(node):
            yield from _walk(x, f"{path}[{i}]", depth + 1)


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(ArrayType(StructType().add("path", StringType()).add("value", StringType())))
def strings(content: pd.Series) -> pd.Series:
    """Every string of a document with its path, as ``a.b[0].c``; a document that is a string has the path ``root``."""
    return content.map(lambda text: list(_walk(_parsed(text))))


def is_flat(content: Column) -> Column:
    """Whether a text is an object without objects or arrays in it, as far as its brackets show."""
    return F.coalesce(content.rlike(r"^\s*\{[^{}\[\]]*\}\s*\z"), F.lit(False))


def may_refer(content: Column) -> Column:
    """False where a text holds no identifier or pattern, however it is escaped."""
    return content.contains("gts.") | content.contains("\\u")


def flat_strings(content: Column) -> Column:
    """``strings`` of a flat object that may refer to something, in the JVM; null for any other document."""
    def members(c: Column) -> Column:
        found = F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"})
        return F.when(may_refer(c) & is_flat(c), F.transform(F.map_entries(found), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"))))

    return let(content, members)


@F.pandas_udf(StringType())
def canonical(content: pd.Series) -> pd.Series:
    """Equal for documents that differ in key order, white space or the spelling of a number only; null for a text that isn't JSON."""
    def same(x):
        if isinstance(x, dict):
            return {k: same(x[k]) for k in sorted(x)}
        return [same(y) for y in x] if isinstance(x, list) else int(x) if isinstance(x, float) and x.is_integer() else x

    def written(text):
        try:
            return json.dumps(same(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError, OverflowError):
            return None

    return content.map(written)


def content_key(content: Column) -> Column:
    """Equal for equal documents: by their canonical form, or by the text itself where it isn't JSON."""
    return F.sha2(F.coalesce(F.concat(F.lit("json "), canonical(content)), F.concat(F.lit("text "), content), F.lit("")), 256)


def _names(node, path: str = ""):
    """The paths of all members and items below a node, parents first."""
    below = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    for key, x in below:
        here = f"{path}[{key}]" if isinstance(node, list) else f"{path}.{key}" if path else key
        yield here
        yield from _names(x, here)


@F.pandas_udf(ArrayType(StringType()))
def available_fields(content: pd.Series) -> pd.Series:
    """Every path of a document, for who asks for one that isn't there."""
    return content.map(lambda text: list(_names(_parsed(text))))


def has_keyword(content: Column, name: str) -> Column:
    """Whether any object of a document has a member of this name."""
    return F.exists(available_fields(content), lambda p: F.element_at(F.split(p, r"\."), -1) == name)


def references(found: Column) -> Column:
    """array<struct(id, source_path, concrete)> of the identifiers and patterns among ``strings``, once per id and path."""
    likely = F.filter(found, lambda x: x["value"].startswith("gts"))
    stripped = F.transform(likely, lambda x: let(F.when(x["value"].startswith("gts://"), ident.strip_uri(x["value"])).otherwise(x["value"]), lambda v: F.struct(v.alias("id"), x["path"].alias("source_path"), ident.is_valid_legacy(v).alias("concrete"))))
    return F.array_distinct(F.filter(stripped, lambda x: x["concrete"] | ident.is_legacy_pattern(x["id"])))


def path_steps(path: str) -> list[str]:
    """``a/b.c[0]`` as its steps; an unclosed bracket is kept as it stands."""
    return [s for part in path.replace("/", ".").split(".") for s in re.findall(r"\[[^\]]*\]|\[.*|[^\[]+", part)]


def attribute(v: Column, path: str) -> Column:
    """The variant at a path of keys and indices; null where it leads nowhere. The empty path is the document."""
    for step in path_steps(path):
        index = re.fullmatch(r"\[?(\d+)\]?", step)
        if index:
            at = F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(int(index[1])))
            v = at if step.startswith("[") else F.coalesce(at, member(v, step))
        else:
            v = member(v, step)
    return v


def selector(text: str) -> tuple[str, str] | None:
    """``id@path`` as its two sides; None without ``@`` or id."""
    left, at, right = text.partition("@")
    return (left.strip(), right.strip()) if at and left.strip() else None


def attribute_result(v: Column, path: str) -> Column:
    """struct(resolved, value, error): the value as JSON text."""
    found = attribute(v, path)
    return F.struct(found.isNotNull().alias("resolved"), F.to_json(found).alias("value"), F.when(found.isNull(), F.lit(f"Path not found: {path}")).alias("error"))


def pointer_steps(pointer: str) -> list[str]:
    """The steps of an RFC 6901 pointer, also as the percent-encoded fragment of a reference; ``#`` and the empty pointer are the document."""
    return [unquote(s).replace("~1", "/").replace("~0", "~") for s in pointer.removeprefix("#").split("/")[1:]]


def is_resource(node) -> bool:
    """Whether a schema within a document is one of its own, with its own anchors and local references."""
    return isinstance(node, dict) and isinstance(node.get("$id"), str) and not node["$id"].startswith("#")


def _within(root):
    """All objects of a resource, but for those of resources in it."""
    open_ = [root]
    while open_:
        node = open_.pop()
        if isinstance(node, dict):
            yield node
        below = [x for k, x in node.items() if k not in ("const", "enum", "default", "examples")] if isinstance(node, dict) else node if isinstance(node, list) else []
        open_ += [x for x in below if not is_resource(x)]


def anchors(root) -> dict[str, tuple[dict, bool]]:
    """The named places of a resource, and whether they are dynamic."""
    out: dict[str, tuple[dict, bool]] = {}
    for node in _within(root):
        ids = node.get("$id")
        names = [(node.get("$anchor"), False), (node.get("$dynamicAnchor"), True), (ids[1:] if isinstance(ids, str) and ids.startswith("#") else None, False)]
        out |= {name: (node, dynamic) for name, dynamic in names if isinstance(name, str)}
    return out


def local_target(root, fragment: str) -> tuple[object, object] | None:
    """What a reference's fragment names in a resource, a pointer or an anchor, and the resource that it is in; None if nothing."""
    name = unquote(fragment)
    if name and not name.startswith("/"):
        found = anchors(root).get(name)
        return found and (found[0], root)
    node = root
    for step in pointer_steps(f"#{fragment}"):
        try:
            node = node[int(step)] if isinstance(node, list) else node[step]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
        root = node if is_resource(node) else root
    return node, root
