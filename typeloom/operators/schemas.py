"""Schemas as a table of positions, and what is decided by comparing such tables.

``positions`` gives a row for each place of an instance that a schema speaks of (``$``, ``$.a``, ``$.a[]``). References
to other types are resolved by joins; rows that speak of the same place are folded by one aggregation, which is what
``allOf`` means. Minor versions are compared, and derived types checked against their parents, by joining two such
tables on the place: any number of types in a few shuffles.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, MapType, StringType, StructType

from ..functions import ident, jsons, patterns
from ..plans.lineage import cut
from . import keywords, relations, scopes
from .registry import dialect_of

# Bounds of which a larger number is stricter, and those of which a smaller one is.
LOWER = ("minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties")
UPPER = ("maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties")
REF_KEYWORDS = ("x-gts-type-ref", "x-gts-instance-ref", "x-gts-pattern-ref")
TOP_KEYWORDS = ("x-gts-traits-schema", "x-gts-traits", "x-gts-abstract", "x-gts-final")
MAX_NODES = 100_000
#: After so many steps the positions put in place are checkpointed as a whole.
STEPS = 16

_NAMES = ArrayType(StringType())
NODE = StructType()
for _name, _kind in (
    ("path", StringType()), ("branch", BooleanType()), ("always", BooleanType()), ("types", _NAMES), ("enums", _NAMES), ("const", StringType()),
    ("bounds", MapType(StringType(), DoubleType())), ("required", _NAMES), ("properties", _NAMES), ("closed", BooleanType()), ("pattern", StringType()), ("format", StringType()),
    ("ref", StringType()), ("fallback", StringType()), ("operands", MapType(StringType(), StringType())), ("items", BooleanType()), ("shut", BooleanType()), ("opened", BooleanType()), ("error", StringType()),
):
    NODE.add(_name, _kind)


def _text(x) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False)


def _node(schema, path: str, branch: bool) -> dict:
    """What one schema position says by itself."""
    row = {"path": path, "branch": branch}
    if isinstance(schema, bool):
        return row | {"always": schema}
    kinds, ref = schema.get("type"), schema.get("$ref")
    return row | {
        "types": [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else None,
        "enums": [_text(x) for x in schema["enum"]] if isinstance(schema.get("enum"), list) else None,
        "const": _text(schema["const"]) if "const" in schema else None,
        "bounds": {k: float(schema[k]) for k in LOWER + UPPER if isinstance(schema.get(k), int | float) and not isinstance(schema[k], bool)},
        "required": [x for x in schema.get("required") or [] if isinstance(x, str)],
        "properties": list(schema.get("properties") or {}),
        "closed": schema.get("additionalProperties") is False or schema.get("unevaluatedProperties") is False,
        "pattern": schema.get("pattern"),
        "format": schema.get("format"),
        "ref": ref.removeprefix("gts://") if isinstance(ref, str) and ref.startswith("gts://") else None,
        "fallback": _text(schema["default"]) if "default" in schema else None,
        "operands": {k: schema[k] for k in REF_KEYWORDS if isinstance(schema.get(k), str)},
        "items": "items" in schema,
        "shut": schema.get("additionalProperties") is False,
        "opened": "additionalProperties" in schema,
        "error": f"unsupported $ref: {ref}" if isinstance(ref, str) and not ref.startswith(("gts://", "#")) else None,
    }


def _positions(text):
    """Rows of one schema. Local references are followed in place. One that comes back to itself below, in a member or an
    item, ends there: its positions are those above. One that comes back at the same place is an error row."""
    root = jsons._parsed(text)
    rows, todo = [], [(root, "$", False, {})]
    while todo:
        schema, path, branch, via = todo.pop()
        if not isinstance(schema, dict | bool):
            continue
        rows.append(_node(schema, path, branch))
        if len(rows) > MAX_NODES:
            return rows + [{"path": path, "branch": branch, "error": "the schema is too large"}]
        if isinstance(schema, bool):
            continue
        ref = schema.get("$ref")
        if isinstance(ref, str) and ref.startswith("#"):
            target = (jsons.local_target(root, ref[1:]) or (None,))[0]
            if target is None:
                rows[-1]["error"] = f"$ref leads nowhere: {ref}"
            elif via.get(ref) == path:
                rows[-1]["error"] = f"cyclic $ref: {ref}"
            elif ref not in via:
                todo.append((target, path, True, via | {ref: path}))
        todo += [(s, f"{path}.{k}", False, via) for k, s in (schema.get("properties") or {}).items()]
        todo += [(s, path, True, via) for s in schema.get("allOf") or []]
        if "items" in schema:
            todo.append((schema["items"], f"{path}[]", False, via))
    return rows


@F.pandas_udf(ArrayType(NODE))
def _position_rows(content: pd.Series) -> pd.Series:
    return content.map(lambda text: [{f: row.get(f) for f in NODE.names} for row in _positions(text)])


def positions(schemas: DataFrame, column: str = "content") -> DataFrame:
    """type_id and a row for each position of the schemas (entity_key, ``column``), as written."""
    return schemas.select(F.col("entity_key").alias("type_id"), F.explode(_position_rows(F.col(column))).alias("n")).select("type_id", "n.*")


def resolved(rows: DataFrame) -> DataFrame:
    """Positions with those of referenced types put in place, step by step until no reference is open: a step joins
    open references with the positions of what they name. References that come back to a type on their way, or to
    none, become error rows, so that a chain is at most as long as there are types."""
    rows = cut(rows.withColumn("via", F.array("type_id")))
    target = rows.select(F.col("type_id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in rows.columns if c not in ("type_id", "via")])
    done, front = rows, rows.filter("ref IS NOT NULL")
    step = 0
    while not front.isEmpty():
        step += 1
        known = target.select("target").distinct().withColumn("found", F.lit(True))
        opened = front.join(known, front.ref == F.col("target"), "left").drop("target")
        lost = F.when(F.array_contains("via", F.col("ref")), F.concat(F.lit("cyclic $ref: "), "ref")).when(F.col("found").isNull(), F.concat(F.lit("missing type: "), "ref"))
        opened = opened.withColumn("lost", lost).drop("found")
        bad = opened.filter("lost IS NOT NULL").withColumn("error", F.col("lost")).withColumn("ref", F.lit(None).cast("string")).drop("lost")
        put = opened.filter("lost IS NULL").join(target, F.col("ref") == F.col("target"))
        moved = cut(put.select(
            "type_id", F.concat("path", F.expr("substring(t_path, 2)")).alias("path"), (F.col("t_branch") | (F.col("t_path") == "$")).alias("branch"),
            *[F.col(f"t_{c}").alias(c) for c in rows.columns if c not in ("type_id", "path", "branch", "via")],
            F.concat("via", F.array("ref")).alias("via"),
        ))
        done = done.unionByName(moved).unionByName(bad.select(*done.columns))
        done = done if step % STEPS else cut(done)
        front = moved.filter("ref IS NOT NULL")
    return done


def folded(rows: DataFrame, own_types_only: bool = False) -> DataFrame:
    """One row per type and place. The strictest of each bound counts; names are united; of single values the first
    as written. ``own_types_only``: branches of allOf add properties, required names and closedness alone."""
    own = lambda c: F.when(~F.col("branch"), F.col(c)) if own_types_only else F.col(c)
    first = lambda c: F.min_by(own(c), F.when(own(c).isNotNull(), F.col("branch"))).alias(c)
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    bound = lambda k: (F.max if k in LOWER else F.min)(own("bounds")[k])
    return rows.groupBy("type_id", "path").agg(
        F.bool_and("always").alias("always"), first("types"), first("enums"), first("const"), first("pattern"), first("format"), first("fallback"),
        names("required"), names("properties"), F.coalesce(F.bool_or("closed"), F.lit(False)).alias("closed"), F.coalesce(F.bool_or("items"), F.lit(False)).alias("items"), F.coalesce(F.bool_or("opened"), F.lit(False)).alias("opened"),
        F.struct(*(bound(k).alias(k) for k in LOWER + UPPER)).alias("bounds"), F.sort_array(F.collect_set("error")).alias("errors"),
    )


def minor_pairs(types: DataFrame) -> DataFrame:
    """family, old, new of all pairs of a family's minor versions (a column ``gts_id`` of types; the lower is old)."""
    t = types.filter(ident.is_type(F.col("gts_id")) & ident.last_minor(F.col("gts_id")).isNotNull()).select("gts_id", ident.family(F.col("gts_id")).alias("family"), ident.last_minor(F.col("gts_id")).alias("minor")).distinct()
    a, b = t.select("family", F.col("gts_id").alias("old"), F.col("minor").alias("m1")), t.select("family", F.col("gts_id").alias("new"), F.col("minor").alias("m2"))
    return a.join(b, "family").filter("m1 < m2").select("family", "old", "new")


def structure(content: Column) -> Column:
    """Equal for schemas that differ in nothing but the minor version of ``$id`` and ``$ref``."""
    same = jsons.canonical(F.regexp_replace(content, r'("\$\$?(?:id|ref)"\s*:\s*"[^"]*\.v[0-9]+)\.[0-9]+~"', '$1~"'))
    return F.sha2(same, 256)


def structural_report(schemas: DataFrame) -> DataFrame:
    """family, old, new, equal: each pair of minor versions, compared by structure."""
    s = schemas.select("gts_id", structure(F.col("content")).alias("s"))
    pairs = minor_pairs(schemas.select("gts_id"))
    return pairs.join(s.select(F.col("gts_id").alias("old"), F.col("s").alias("so")), "old").join(s.select(F.col("gts_id").alias("new"), F.col("s").alias("sn")), "new").select("family", "old", "new", (F.col("so") == F.col("sn")).alias("equal"))


def _paired(pairs: DataFrame, rows: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """pair columns, path, and the folded rows of both sides as structs a and b, at the places that ``a`` has."""
    body = F.struct(*[c for c in rows.columns if c not in ("type_id", "path")])
    left = pairs.join(rows.select(F.col("type_id").alias(a), "path", body.alias("x")), a)
    right = rows.select(F.col("type_id").alias(b), "path", body.alias("y"))
    return left.join(right, [b, "path"], how)


def _problems(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.concat(F.col("path"), F.lit(f": {text}"))) for test, text in checks)), lambda e: e.isNotNull())


def evolution(schemas: DataFrame) -> DataFrame:
    """old, new, backward, forward (lists of errors) of all pairs of minor versions.

    Backward: what the old version admits must be valid under the new one; forward the other way round. Places that
    only one version has are judged at the place above them. Compared are names required and known, openness, type
    (an integer is a number), texts listed, constants, and the bounds that go with the old type.
    """
    rows = folded(resolved(positions(schemas)), own_types_only=True)
    p = _paired(minor_pairs(schemas.select("gts_id")), rows, "old", "new")
    o, n = F.col("x"), F.col("y")
    texts = lambda s: F.filter(s["enums"], lambda e: e.startswith('"'))
    more = lambda a, b: F.size(F.array_except(a, b)) > 0
    one = lambda s: F.when(F.size(s["types"]) == 1, s["types"][0])
    changed = ~F.array_sort(o["types"]).eqNullSafe(F.array_sort(n["types"])) & o["types"].isNotNull() & n["types"].isNotNull()
    widened, narrowed = (one(o) == "integer") & (one(n) == "number"), (one(o) == "number") & (one(n) == "integer")
    applies = {k: one(o).isin("number", "integer") for k in ("minimum", "maximum")} | {k: one(o) == "string" for k in ("minLength", "maxLength")}
    applies |= {k: (one(o) == "array") | o["items"] | o["bounds"][k].isNotNull() for k in ("minItems", "maxItems")}

    def tighter(a: Column, b: Column, k: str) -> Column:
        """The bound of ``b`` admits less than that of ``a``, or ``a`` has none."""
        x, y = a["bounds"][k], b["bounds"][k]
        return y.isNotNull() & (x.isNull() | (y > x if k in LOWER else y < x))

    def way(a: Column, b: Column, added: Column, removed: Column, allowed: Column) -> Column:
        """Errors if what ``a`` admits must be valid under ``b``."""
        return _problems(
            (more(b["required"], a["required"]), "required names were added"),
            (~a["closed"] & added | b["closed"] & removed, "the known properties differ"),
            (~a["closed"] & b["closed"], "it was closed"),
            (changed & ~F.coalesce(allowed, F.lit(False)), "the type differs"),
            (b["enums"].isNotNull() & (a["enums"].isNull() | more(texts(a), texts(b))), "fewer values are listed"),
            (b["const"].isNotNull() & ~a["const"].eqNullSafe(b["const"]), "the constant differs"),
            *((test & tighter(a, b, k), f"{k} is tighter") for k, test in applies.items()),
        )

    added, removed = more(n["properties"], o["properties"]), more(o["properties"], n["properties"])
    each = p.select("old", "new", way(o, n, added, removed, widened).alias("b"), way(n, o, removed, added, narrowed).alias("f"))
    return each.groupBy("old", "new").agg(*(F.array_sort(F.flatten(F.collect_list(c))).alias(name) for c, name in (("b", "backward"), ("f", "forward"))))


def verdicts(report: DataFrame) -> DataFrame:
    """old, new, is_backward, is_forward, is_full."""
    b, f = F.size("backward") == 0, F.size("forward") == 0
    return report.select("old", "new", b.alias("is_backward"), f.alias("is_forward"), (b & f).alias("is_full"))


def _subset(a: Column, c: Column, there: Column | None = None) -> Column:
    """What a place of a type (``c``) misses to admit no more than that of its parent (``a``); both are structs of folded rows."""
    there = c["properties"].isNotNull() if there is None else there
    number = lambda text: text.try_cast("double")
    values = F.coalesce(F.when(c["const"].isNotNull(), F.array(c["const"])), c["enums"])
    kinds = F.when(F.array_contains(a["types"], "number"), F.array_union(a["types"], F.array(F.lit("integer")))).otherwise(a["types"])
    inside = lambda k: F.coalesce(F.forall(values, lambda x: number(x) >= a["bounds"][k] if k in LOWER else number(x) <= a["bounds"][k]), F.lit(False))
    looser = lambda k: a["bounds"][k].isNotNull() & (c["bounds"][k].isNull() | (c["bounds"][k] < a["bounds"][k] if k in LOWER else c["bounds"][k] > a["bounds"][k])) & ~inside(k)
    return _problems(
        (~there, "it was dropped"),
        (there & (a["always"] == False) & ~c["always"].eqNullSafe(F.lit(False)), "the parent admits nothing"),  # noqa: E712
        (there & (c["always"] == False) & ~a["always"].eqNullSafe(F.lit(False)), "it admits nothing"),  # noqa: E712
        (there & a["types"].isNotNull() & (c["types"].isNull() & values.isNull() | (F.size(F.array_except(c["types"], kinds)) > 0)), "the type is wider"),
        (there & a["const"].isNotNull() & ~a["const"].eqNullSafe(c["const"]), "the constant differs"),
        (there & a["enums"].isNotNull() & (values.isNull() | (F.size(F.array_except(values, a["enums"])) > 0)), "values were added"),
        (there & a["pattern"].isNotNull() & ~a["pattern"].eqNullSafe(c["pattern"]), "the pattern differs"),
        (there & (F.size(F.array_except(a["required"], c["required"])) > 0), "required names were dropped"),
        (there & a["closed"] & ~c["closed"], "it was opened"),
        (there & a["closed"] & (F.size(F.array_except(c["properties"], a["properties"])) > 0), "a closed parent was extended"),
        *((there & looser(k), f"{k} is looser") for k in LOWER + UPPER),
    )


def derivation(schemas: DataFrame, written: DataFrame | None = None, put: DataFrame | None = None) -> DataFrame:
    """type_id, parent, errors of every derived type: it must be a subset of its parent.

    The parent must be stored, of the same dialect and not final; everything the parent demands at a place must be
    demanded by the type, its references resolved, at least as strictly; what it declares anew must narrow by itself,
    its closed branches restate the parent's members, and its reference scopes lie within the parent's. ``written`` and
    ``put`` are the schemas' positions, and those with references in place, where they are known already.
    """
    v = jsons.variant(F.col("content"))
    facts = schemas.select(F.col("entity_key").alias("type_id"), ident.parent_type(F.col("entity_key")).alias("parent"), F.coalesce(F.try_variant_get(v, "$['x-gts-final']", "boolean"), F.lit(False)).alias("final"), jsons.as_string(jsons.member(v, "$schema")).alias("dialect"))
    pairs = facts.filter("parent IS NOT NULL")
    above = pairs.select("type_id", "parent", "dialect").join(facts.select(F.col("type_id").alias("parent"), F.col("final").alias("p_final"), F.col("dialect").alias("p_dialect"), F.lit(True).alias("there")), "parent", "left")
    hop = above.select(
        "type_id", "parent",
        F.when(F.col("there").isNull(), F.array(F.lit("$: the parent is missing")))
        .otherwise(F.filter(F.array(F.when(F.col("p_final"), "$: the parent is final"), F.when(~F.col("dialect").eqNullSafe(F.col("p_dialect")), "$: the dialects differ")), lambda e: e.isNotNull()))
        .alias("errors"),
    )
    written = cut(positions(schemas)) if written is None else written
    rows = cut(folded(resolved(written) if put is None else put))
    p = _paired(pairs.select("type_id", "parent").withColumnsRenamed({"type_id": "child"}), rows, "parent", "child", "left")
    checks = _subset(F.col("x"), F.col("y"))
    own = rows.filter(F.size("errors") > 0).select(F.col("type_id").alias("child"), F.transform("errors", lambda e: F.concat("path", F.lit(": "), e)).alias("e"))
    related = scopes.relations(pairs.select(F.col("parent").alias("base"), F.col("type_id").alias("derived")), schemas).filter(F.col("relation") != scopes.INCLUDED)
    scoped = related.select(F.col("derived").alias("child"), F.array(F.lit("$: a reference constraint isn't known to be within the parent's")).alias("e"))
    chain = pairs.select(F.col("type_id").alias("child"), "parent")
    found = p.select("child", checks.alias("e")).unionByName(own).unionByName(scoped).unionByName(redeclared(chain, rows, cut(folded(written)))).unionByName(shut_branches(chain, rows, written))
    summed = found.groupBy(F.col("child").alias("type_id")).agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    return hop.join(summed, "type_id", "left").select("type_id", "parent", F.concat("errors", F.coalesce("e", F.array().cast("array<string>"))).alias("errors"))


def redeclared(pairs: DataFrame, above: DataFrame, written: DataFrame) -> DataFrame:
    """child, e (errors) of members that a type declares anew, as written: each must by itself be a subset of the parent's.

    A declaration need not repeat the members, required names and closedness that the parent's has at its top; what is
    below must be whole. ``above``: folded places of parents, resolved; ``written``: folded places as written.
    """
    steps = F.regexp_extract_all("path", F.lit(r"\.[^.\[]+|\[\]"), F.lit(0))
    upper = F.regexp_replace("path", r"(\.[^.\[]+|\[\])\z", "")
    body = F.struct(*[c for c in above.columns if c not in ("type_id", "path")])
    places = above.withColumn("steps", steps).filter(F.size("steps") > 0).select(F.col("type_id").alias("parent"), "path", F.size("steps").alias("depth"), F.concat(F.lit("$"), F.col("steps")[0]).alias("top"), upper.alias("upper"), body.alias("x"))
    own = written.select(F.col("type_id").alias("child"), "path", body.alias("y"))
    met = pairs.join(places, "parent").join(own.select("child", F.col("path").alias("top")), ["child", "top"])  # declared anew
    met = met.join(own, ["child", "path"], "left").join(own.select("child", F.col("path").alias("upper"), F.lit(True).alias("held")), ["child", "upper"], "left")
    x, y = F.col("x"), F.col("y")
    known = F.when(F.col("y").isNull(), None).otherwise(
        F.struct(*[
            F.array_union(y["required"], x["required"]).alias(c) if c == "required" else F.array_union(y["properties"], x["properties"]).alias(c) if c == "properties" else (y["closed"] | (x["closed"] & ~y["opened"])).alias(c) if c == "closed" else y[c].alias(c)
            for c in above.columns if c not in ("type_id", "path")
        ])
    )
    lent = (F.col("depth") == 2) & ~F.col("path").endswith("[]")  # a member below the top comes from the parent
    judged = met.filter(y.isNotNull() | (F.col("held") & ~lent)).withColumn("c", F.when(F.col("depth") == 1, known).otherwise(y))
    errors = judged.select("child", F.transform(_subset(x, F.col("c")), lambda e: F.concat(e, F.lit(", where it is declared anew"))).alias("e"))
    return errors.filter(F.size("e") > 0)


def shut_branches(pairs: DataFrame, above: DataFrame, written: DataFrame) -> DataFrame:
    """child, e (errors) of a type's branches that admit no further members and don't restate a member of the parent."""
    held = above.filter(F.size("properties") > 0).select(F.col("type_id").alias("parent"), "path", F.col("properties").alias("p"))
    shut = written.filter(F.col("shut") & ~F.col("path").contains("[]")).select(F.col("type_id").alias("child"), "path", "properties")
    met = pairs.join(held, "parent").join(shut, ["child", "path"])
    lost = F.array_except("p", F.coalesce("properties", F.array().cast("array<string>")))
    return met.filter(F.size(lost) > 0).select("child", F.array(F.concat("path", F.lit(": a closed branch doesn't restate "), F.array_join(F.array_sort(lost), ", "))).alias("e"))


def keyword_errors(schemas: DataFrame) -> DataFrame:
    """type_id and error of misused own keywords: unknown ones, modifiers that aren't boolean, final and abstract together."""
    v = jsons.variant(F.col("content"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    unknown = F.filter(keys, lambda k: k.startswith("x-gts-") & ~k.isin(*TOP_KEYWORDS, *REF_KEYWORDS))
    flag = lambda k: jsons.member(v, k)
    odd = lambda k: flag(k).isNotNull() & (jsons.kind(flag(k)) != "BOOLEAN")
    on = lambda k: F.coalesce(F.try_variant_get(v, f"$['{k}']", "boolean"), F.lit(False))
    return schemas.select(
        F.col("entity_key").alias("type_id"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keyword "), unknown[0]))
        .when(odd("x-gts-final") | odd("x-gts-abstract"), "a modifier must be boolean")
        .when(on("x-gts-final") & on("x-gts-abstract"), "a type can't be final and abstract")
        .alias("error"),
    )


def merge_patched(below, over):
    """A JSON merge patch: objects merge, null takes a member away, anything else replaces."""
    if not isinstance(over, dict):
        return over
    out = dict(below) if isinstance(below, dict) else {}
    for key, x in over.items():
        if x is None:
            out.pop(key, None)
        else:
            out[key] = merge_patched(out.get(key), x)
    return out


@F.pandas_udf(StringType())
def merged(levels: pd.Series) -> pd.Series:
    """The texts of an array, each patched by those after it, as one JSON text."""
    def one(texts) -> str:
        held: object = {}
        for text in texts:
            held = merge_patched(held, jsons._parsed(text))
        return json.dumps(held, ensure_ascii=False)

    return levels.map(one)


def traits(schemas: DataFrame) -> DataFrame:
    """type_id, trait, value: what holds for each type by its chain, the levels' objects merged from the root down; a null takes a value away.

    Every level gives its own; the levels of all types meet in one join and one aggregation per type.
    """
    v = jsons.variant(F.col("content"))
    given = schemas.select(F.col("entity_key").alias("level_id"), F.to_json(F.try_variant_get(v, "$['x-gts-traits']", "variant")).alias("value")).filter("value IS NOT NULL")
    chains = _levels(schemas).join(given, "level_id").groupBy("type_id").agg(F.sort_array(F.collect_list(F.struct("level", "value"))).alias("w"))
    whole = chains.select("type_id", F.transform("w", lambda x: x["value"]).alias("texts")).select("type_id", merged("texts").alias("m"))
    every = whole.select("type_id", F.explode(F.try_variant_get(jsons.variant(F.col("m")), "$", "map<string,variant>")).alias("trait", "v"))
    return every.select("type_id", "trait", F.to_json("v").alias("value"))


def _levels(schemas: DataFrame) -> DataFrame:
    """type_id, level_id, level of each type's chain, itself included."""
    parts = F.filter(F.split("type_id", "~"), lambda p: p != "")
    ids = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("level"), F.concat(F.array_join(F.slice(parts, 1, n), "~"), F.lit("~")).alias("level_id")))
    return schemas.select(F.col("entity_key").alias("type_id")).select("type_id", F.explode(ids).alias("l")).select("type_id", "l.*")


def trait_errors(schemas: DataFrame) -> DataFrame:
    """type_id, errors of each type that has traits or declarations: values without a declaration, unknown ones under a
    closed declaration, missing required ones without a default (abstract types may miss them), wrong types, constants
    and listed values."""
    v = jsons.variant(F.col("content"))
    declared = schemas.select("entity_key", F.to_json(F.try_variant_get(v, "$['x-gts-traits-schema']", "variant")).alias("declaration")).filter("declaration IS NOT NULL")
    # declarations refer to types; their rows are told apart by a mark that no identifier has
    mark = "traits of "
    named = positions(declared.withColumn("entity_key", F.concat(F.lit(mark), "entity_key")), "declaration")
    put = resolved(named.unionByName(positions(schemas))).filter(F.col("type_id").startswith(mark))
    own = put.withColumn("type_id", F.expr(f"substring(type_id, {len(mark) + 1})")).withColumnRenamed("type_id", "level_id").drop("via")
    lost = own.filter("error IS NOT NULL").select("level_id", F.concat(F.lit("declaration: "), "error").alias("e"))
    rows = folded(_levels(schemas).join(own, "level_id").drop("level_id", "level"))
    top = rows.filter("path = '$'").select("type_id", "required", "closed", "properties", "always")
    per = rows.filter(r"path rlike '^\\$\\.[^.\\[]+\\z'").select("type_id", F.expr("substring(path, 3)").alias("trait"), "types", "const", "enums", "fallback")
    set_ = traits(schemas)
    abstract = schemas.select(F.col("entity_key").alias("type_id"), F.coalesce(F.try_variant_get(v, "$['x-gts-abstract']", "boolean"), F.lit(False)).alias("abstract"))
    kind = jsons.kind(jsons.variant(F.col("value")))
    # JSON kinds by type name.
    fits = F.expr("false")
    for name, kinds in (("string", ["STRING"]), ("boolean", ["BOOLEAN"]), ("integer", ["BIGINT"]), ("number", ["BIGINT", "DOUBLE", "DECIMAL"]), ("object", ["OBJECT"]), ("array", ["ARRAY"]), ("null", ["VOID"])):
        fits |= F.array_contains("types", name) & kind.isin(*kinds)
    both = set_.join(top, "type_id", "left").join(per, ["type_id", "trait"], "left")
    each = both.select("type_id", F.concat(F.lit("trait "), "trait", F.lit(": "),
        F.when(F.col("properties").isNull(), "nothing is declared").when(F.col("always") == False, "traits are forbidden").when(F.col("closed") & ~F.array_contains("properties", F.col("trait")), "unknown")  # noqa: E712
        .when(F.col("types").isNotNull() & ~fits, "wrong type").when(F.col("const") != F.col("value"), "the constant differs").when(~F.array_contains("enums", F.col("value")), "not a listed value")).alias("e"))
    needed = top.join(abstract.filter("NOT abstract"), "type_id").select("type_id", F.explode("required").alias("trait"))
    missing = needed.join(set_, ["type_id", "trait"], "left_anti").join(per.filter("fallback IS NOT NULL"), ["type_id", "trait"], "left_anti").select("type_id", F.concat(F.lit("trait "), "trait", F.lit(": required")).alias("e"))
    judged = top.select("type_id").unionByName(set_.select("type_id")).distinct()
    broken = _levels(schemas).join(lost, "level_id").select("type_id", "e")
    return judged.join(each.unionByName(missing).unionByName(broken), "type_id", "left").groupBy("type_id").agg(F.sort_array(F.collect_set("e")).alias("errors"))


def reference_errors(schemas: DataFrame, entities: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """entity_key, path, keyword, value, reason of strings in instances that break a reference keyword of their type;
    with ``valid`` (entity_key of what is valid) also those that name something stored that isn't.

    The operands of a type's resolved positions meet the strings of its instances on place and type; what should be
    stored is then looked up by an anti join. ``/$id`` as an operand is the type itself.
    """
    operands = resolved(positions(schemas)).select("type_id", "path", F.explode("operands").alias("keyword", "operand"))
    operands = operands.withColumn("operand", F.when(F.col("operand") == "/$id", F.col("type_id")).otherwise(F.col("operand"))).dropDuplicates()
    found = entities.filter("NOT is_schema").select("entity_key", F.col("schema_id").alias("type_id"), F.explode(jsons.strings("content")).alias("s"))
    found = found.select("entity_key", "type_id", F.concat(F.lit("$."), F.regexp_replace("s.path", r"\[[0-9]+\]", "[]")).alias("path"), F.col("s.value").alias("value"), F.col("s.path").alias("at"))
    met = found.join(operands, ["type_id", "path"])
    value, pattern = F.col("value"), F.col("keyword") == "x-gts-pattern-ref"
    shaped = F.when(pattern, ident.is_pattern(value)).when(F.col("keyword") == "x-gts-type-ref", ident.is_valid(value) & ident.is_type(value)).otherwise(ident.is_valid(value) & ~ident.is_type(value))
    judged = met.withColumn("reason", F.when(~shaped, "NotAReference").when(~ident.covers(F.col("operand"), value), "OutOfScope"))
    known = entities.select(F.col("entity_key").alias("value")).distinct()
    absent = judged.filter(F.col("reason").isNull() & ~pattern).join(known, "value", "left_anti").withColumn("reason", F.lit("NotStored"))
    keep = ("entity_key", F.col("at").alias("path"), "keyword", "value", "reason")
    out = judged.filter("reason IS NOT NULL").select(*keep).unionByName(absent.select(*keep))
    if valid is None:
        return out
    bad = known.join(valid.select(F.col("entity_key").alias("value")), "value", "left_anti")
    return out.unionByName(judged.filter(F.col("reason").isNull() & ~pattern).join(bad, "value", "left_semi").withColumn("reason", F.lit("NotValid")).select(*keep))


def operand_errors(schemas: DataFrame, entities: DataFrame, stored: bool = True) -> DataFrame:
    """type_id, path, keyword, operand, reason of reference keywords whose operand names nothing: no identifier or
    pattern, an instance where types are meant, or (``stored``) an identifier that isn't stored, or a wildcard that
    selects nothing that is. The operands of pattern keywords are never looked up. All positions of a schema count."""
    said = keywords.facts(schemas).filter(F.col("keyword").isin(*REF_KEYWORDS))
    rows = said.select("type_id", F.col("pointer").alias("path"), "keyword", F.coalesce("text", F.lit("")).alias("operand")).filter("operand <> '/$id'")
    plain = ~F.col("operand").endswith("*")
    instance = plain & ~ident.is_type(F.col("operand"))
    judged = rows.withColumn("reason", F.when(~ident.is_pattern(F.col("operand")), "NotAReference").when((F.col("keyword") == "x-gts-type-ref") & instance, "NotAType"))
    wrong = judged.filter("reason IS NOT NULL")
    if not stored:
        return wrong
    known = entities.select(F.col("entity_key").alias("operand")).distinct()
    asked = judged.filter(F.col("reason").isNull() & (F.col("keyword") != "x-gts-pattern-ref"))
    absent = asked.filter(plain).join(known, "operand", "left_anti").withColumn("reason", F.lit("NotStored"))
    wide = relations.unmatched(asked.filter(~plain).withColumnRenamed("operand", "pattern"), known.select(F.col("operand").alias("id")))
    empty = wide.withColumnRenamed("pattern", "operand").withColumn("reason", F.lit("NoMatch"))
    return wrong.unionByName(absent.select(*wrong.columns)).unionByName(empty.select(*wrong.columns))


def mixed_dialects(schemas: DataFrame) -> DataFrame:
    """type_id of types that lead by references to a type of another dialect."""
    dialect = dialect_of(jsons.as_string(jsons.member(jsons.variant(F.col("content")), "$schema")))
    own = schemas.select(F.col("entity_key").alias("type_id"), dialect.alias("dialect"))
    ways = resolved(positions(schemas)).select("type_id", F.explode("via").alias("target")).distinct()
    target = own.select(F.col("type_id").alias("target"), F.col("dialect").alias("other"))
    return ways.join(own, "type_id").join(target, "target").filter(~F.col("dialect").eqNullSafe(F.col("other"))).select("type_id").distinct()


def type_report(schemas: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """type_id, stage, error of every type: the first stage that finds something, and its first error; null if valid.

    Stages, in order: Dialect, Keywords, References (of all types that a type leads to), Schema (the dialect's own
    rules), Patterns, Derivation, Operands, Traits. All types pass all stages at once; each stage is a table of errors.
    """
    entities = schemas if entities is None else entities
    v = jsons.variant(F.col("content"))
    ids = schemas.select(F.col("entity_key").alias("type_id"))
    dialects = schemas.filter(dialect_of(jsons.as_string(jsons.member(v, "$schema"))).isNull()).select(F.col("entity_key").alias("type_id"), F.lit("unsupported dialect").alias("error"))
    written = cut(positions(schemas))
    rows = cut(resolved(written))
    listed = lambda df: df.select("type_id", F.explode("errors").alias("error"))
    said = cut(keywords.facts(schemas))
    patterns_ = rows.filter("pattern IS NOT NULL").select("type_id", "path", "pattern").distinct()
    stages = (
        dialects,
        keyword_errors(schemas).filter("error IS NOT NULL").unionByName(keywords.own_errors(said)),
        rows.filter("error IS NOT NULL").select("type_id", F.concat("path", F.lit(": "), "error").alias("error")).unionByName(keywords.reference_shapes(said)),
        keywords.dialect_errors(said),
        patterns_.withColumn("why", pattern_refusal("pattern")).filter("why IS NOT NULL").select("type_id", F.concat("path", F.lit(": pattern: "), "why").alias("error")).unionByName(keywords.pattern_errors(said)),
        listed(derivation(schemas, written, rows)),
        operand_errors(schemas, entities, stored=False).select("type_id", F.concat("path", F.lit(": "), "keyword", F.lit(" "), "reason").alias("error")),
        listed(trait_errors(schemas)),
    )
    names = ("Dialect", "Keywords", "References", "Schema", "Patterns", "Derivation", "Operands", "Traits")
    found = None
    for n, (name, stage) in enumerate(zip(names, stages, strict=True)):
        part = stage.groupBy("type_id").agg(F.min("error").alias("error")).select("type_id", F.struct(F.lit(n).alias("n"), F.lit(name).alias("stage"), "error").alias("e"))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("type_id").agg(F.min("e").alias("e"))
    return ids.join(first, "type_id", "left").select("type_id", "e.stage", "e.error")


@F.pandas_udf(StringType())
def pattern_refusal(texts: pd.Series) -> pd.Series:
    """Why a regular expression isn't admitted; null if it is."""
    return texts.map(lambda t: None if t is None else patterns.refusal(t))


def admitted(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The types of a batch that can be published together: those found wrong go, then those that are wrong without
    them, and so on until all that are left are valid beside what is stored."""
    left = cut(batch)
    while True:
        report = type_report(stored.unionByName(left)).filter("error IS NOT NULL").select(F.col("type_id").alias("entity_key"))
        wrong = cut(left.join(report, "entity_key", "left_semi").select("entity_key").distinct())
        if wrong.isEmpty():
            return left
        left = cut(left.join(wrong, "entity_key", "left_anti"))


def compatibility(schemas: DataFrame) -> DataFrame:
    """old, new, backward, forward, full of all pairs of minor versions: compatible, incompatible or unknown.

    Unknown are pairs of different dialects or with conditions (``if``). Reference keywords count as well: at each place
    the scope of the one version must lie within that of the other (``scopes``), which can be unknown too.
    """
    dialect = dialect_of(jsons.as_string(jsons.member(jsons.variant(F.col("content")), "$schema")))
    facts = schemas.select(F.col("gts_id").alias("id"), dialect.alias("dialect"), jsons.has_keyword(F.col("content"), "if").alias("branches"))
    report = evolution(schemas)
    side = lambda c: facts.select(F.col("id").alias(c), F.struct("dialect", "branches").alias(f"{c}_f"))
    pairs = report.join(side("old"), "old").join(side("new"), "new")
    both = pairs.select("old", "new")
    way = lambda inner, outer: both.select(F.col(outer).alias("base"), F.col(inner).alias("derived"))
    # both ways round in one go: the trees are made once
    found = scopes.relations(way("old", "new").unionByName(way("new", "old")), schemas)
    back = found.select(F.col("base").alias("new"), F.col("derived").alias("old"), F.col("relation").alias("rb"))
    forth = found.select(F.col("base").alias("old"), F.col("derived").alias("new"), F.col("relation").alias("rf"))
    every = pairs.join(back, ["old", "new"], "left").join(forth, ["old", "new"], "left")
    unknown = ~F.col("old_f.dialect").eqNullSafe(F.col("new_f.dialect")) | F.col("old_f.branches") | F.col("new_f.branches")

    def status(found: str, relation: str) -> Column:
        worst = F.coalesce(relation, F.lit(0))
        return F.when(unknown, "unknown").when((F.size(found) > 0) | (worst == scopes.EXCLUDED), "incompatible").when(worst == scopes.UNKNOWN, "unknown").otherwise("compatible")

    out = every.select("old", "new", status("backward", "rb").alias("backward"), status("forward", "rf").alias("forward"))
    either = lambda x: (F.col("backward") == x) | (F.col("forward") == x)
    return out.withColumn("full", F.when(either("incompatible"), "incompatible").when(either("unknown"), "unknown").otherwise("compatible"))


def latest(schemas: DataFrame) -> DataFrame:
    """family and the type of its highest minor version."""
    w = Window.partitionBy("family").orderBy(F.desc("minor"))
    t = schemas.select("gts_id", ident.family(F.col("gts_id")).alias("family"), F.coalesce(ident.last_minor(F.col("gts_id")), F.lit(-1)).alias("minor"))
    return t.withColumn("r", F.row_number().over(w)).filter("r = 1").select("family", "gts_id")
