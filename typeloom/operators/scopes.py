"""Scopes of reference keywords: what identifiers a place of a schema admits, and whether one scope lies within another.

A place's scope is a tree: an atom for each keyword, a union for ``anyOf`` and ``oneOf``, an intersection for ``allOf``,
references and several keywords, a complement for ``not``, and the top where nothing is said. Schemas are walked to
rows (place, place in its tree); references to types are put in place by joins; the rows of a place make its tree, an
array with children before parents. Two trees are compared by one fold over the pairs of their nodes, in the JVM, to
included, unknown or excluded.

Places are those whose values a schema constrains one by one: members, items (of all, by position, beyond the
positions) and further members. What a place says in several branches of ``allOf`` holds together; of one keyword's
operands the narrower stays. A reference that comes back to its own place can't be decided.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructType

from ..functions import ident, jsons
from ..plans.lineage import cut

# The reference keywords.
KEYWORDS = ("x-gts-type-ref", "x-gts-instance-ref", "x-gts-pattern-ref")
PATTERN, INSTANCE = "x-gts-pattern-ref", "x-gts-instance-ref"
INCLUDED, UNKNOWN, EXCLUDED = 0, 1, 2
#: Characters of the shortest segment that an instance adds to a type.
SHORTEST = len("a.b.c.d.v0")
MAX_ROWS = 100_000
STEPS = 16

_TEXTS = ArrayType(StringType())
ROW = StructType().add("path", StringType()).add("at", _TEXTS).add("inner", BooleanType()).add("operands", MapType(StringType(), StringType())).add("texts", _TEXTS).add("ref", StringType()).add("open", BooleanType())
NODE = StructType().add("kind", StringType()).add("keyword", StringType()).add("operand", StringType()).add("empty", BooleanType()).add("below", ArrayType(IntegerType()))


def _row(schema, path: str, at: tuple, inner: bool) -> dict:
    ref = schema.get("$ref") if isinstance(schema, dict) else None
    texts = None
    if isinstance(schema, dict) and ("const" in schema or isinstance(schema.get("enum"), list)):
        texts = [x if isinstance(x, str) else None for x in ([schema["const"]] if "const" in schema else schema["enum"])]
    operands = {k: schema[k] if isinstance(schema[k], str) else "" for k in KEYWORDS if k in schema} if isinstance(schema, dict) else {}
    named = ref.removeprefix("gts://").partition("#")[0] if isinstance(ref, str) and ref.startswith("gts://") else None
    return {"path": path, "at": list(at), "inner": inner, "operands": operands, "texts": texts, "ref": named, "open": False}


def _rows(text):
    """Rows of one schema: ``at`` is the declaration of its place, then the steps below it; ``inner`` rows are alternatives."""
    root = jsons._parsed(text)
    rows, todo = [], [(root, "$", ("",), False, {})]
    while todo and len(rows) < MAX_ROWS:
        schema, path, at, inner, via = todo.pop()
        rows.append(_row(schema, path, at, inner))
        if not isinstance(schema, dict):
            continue
        ref = schema.get("$ref")
        if isinstance(ref, str) and ref.startswith("#"):
            target = (jsons.local_target(root, ref[1:]) or (None,))[0]
            if via.get(ref) == path:
                rows[-1]["open"] = True
            elif target is not None and ref not in via:
                todo.append((target, path, (*at, f"ref:{ref}"), inner, via | {ref: path}))
        todo += [(s, path, (*at, f"all:{i}"), inner, via) for i, s in enumerate(schema.get("allOf") or []) if isinstance(s, dict)]
        for key, name in (("anyOf", "any"), ("oneOf", "one")):
            todo += [(s, path, (*at, f"{name}:{i}"), True, via) for i, s in enumerate(schema.get(key) or [])]
        if isinstance(schema.get("not"), dict):
            todo.append((schema["not"], path, (*at, "not:0"), True, via))
        if inner:
            continue  # an alternative's own members are no places of the schema
        items = schema.get("items")
        listed = lambda key: [x for x in [schema.get(key)] if isinstance(x, dict)]
        below = [(f".{k}", s) for k, s in (schema.get("properties") or {}).items()]
        below += [("[]", x) for x in listed("items")] + [(f"[{i}]", s) for i, s in enumerate(items if isinstance(items, list) else [])]
        below += [(f"[+{i}]", s) for i, s in enumerate(schema.get("prefixItems") or [])]
        below += [("{}", x) for x in listed("additionalProperties")] + [("[]+", x) for x in listed("additionalItems")]
        todo += [(s, path + step, (" ".join((*at, step)),), False, via) for step, s in below]
    return rows


@F.pandas_udf(ArrayType(ROW))
def _walked(content: pd.Series) -> pd.Series:
    return content.map(_rows)


def rows_of(schemas: DataFrame) -> DataFrame:
    """The rows of all schemas (entity_key, content), those of referenced types put in place: a step joins open
    references with the rows of what they name. One that comes back to a type on its way can't be decided; one that
    leads nowhere says nothing."""
    walked = cut(schemas.select(F.col("entity_key").alias("type_id"), F.explode(_walked("content")).alias("n")).select("type_id", "n.*").withColumn("via", F.array("type_id")))
    target = walked.select(F.col("type_id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in ROW.names])
    done, front, step = walked, walked.filter("ref IS NOT NULL"), 0
    while not front.isEmpty():
        step += 1
        back = front.filter(F.array_contains("via", F.col("ref"))).withColumn("ref", F.lit(None).cast("string")).withColumn("open", F.lit(True))
        put = front.filter(~F.array_contains("via", F.col("ref"))).join(target, (F.col("ref") == F.col("target")) & (~F.col("inner") | (F.col("t_path") == "$")))
        tail = F.slice("t_at", 2, F.size("t_at"))
        at = F.when(F.col("t_path") == "$", F.concat("at", F.array(F.concat(F.lit("ref:"), "ref")), tail)).otherwise(F.concat(F.array(F.concat_ws(" ", F.array_join("at", " "), "ref", F.col("t_at")[0])), tail))
        moved = cut(put.select(
            "type_id", F.concat("path", F.expr("substring(t_path, 2)")).alias("path"), at.alias("at"), (F.col("inner") | F.col("t_inner")).alias("inner"),
            *[F.col(f"t_{c}").alias(c) for c in ("operands", "texts", "ref", "open")], F.concat("via", F.array("ref")).alias("via"),
        ))
        done = done.unionByName(moved).unionByName(back)
        done = done if step % STEPS else cut(done)
        front = moved.filter("ref IS NOT NULL")
    return done


def _tree(rows: list[dict], wide: list[dict]) -> dict:
    """The nodes of one place's scope, children first; the last is the whole. ``wide``: operands for which narrower ones stay."""
    out: list[dict] = []
    below = defaultdict(dict)
    for r in rows:
        at = tuple(r["at"])
        held = below[at[:-1]].setdefault(at, {"operands": {}, "open": False})
        held["operands"] |= dict(r["operands"])
        held["open"] |= r["open"]
    dropped = {(w["keyword"], w["operand"]) for w in wide}

    def put(kind: str, keyword=None, operand=None, empty=False, children=()) -> int:
        out.append({"kind": kind, "keyword": keyword, "operand": operand, "empty": empty, "below": list(children)})
        return len(out) - 1

    def whole(parts: list[int]) -> int:
        return put("top") if not parts else parts[0] if len(parts) == 1 else put("inter", children=parts)

    def node(at: tuple, row: dict) -> tuple[int, bool]:
        if row["open"]:
            return put("undecidable"), True
        parts, says = [], bool(row["operands"])
        for keyword, operand in sorted(row["operands"].items()):
            if ident.is_pattern_text(operand) and not (len(at) == 1 and (keyword, operand) in dropped):
                # no instance of so long a type can be written
                empty = keyword == INSTANCE and operand.endswith("~") and len(operand) + SHORTEST > ident.MAX_LENGTH
                parts.append(put("atom", keyword, operand, empty))
        made = {k: node(k, r) for k, r in sorted(below[at].items())}
        group = lambda *names: [x for k, x in made.items() if k[-1].partition(":")[0] in names]
        parts += [i for i, has in group("all", "ref") if has]
        parts += [put("not", children=[i]) for i, has in group("not") if has]
        for name in ("any", "one"):
            if any(has for _, has in group(name)):
                parts.append(put("union", children=[i for i, _ in group(name)]))
        return whole(parts), says or any(has for _, has in made.values())

    made = [node(k, r) for k, r in sorted(below[()].items())]
    last = whole([i for i, has in made if has])
    if last != len(out) - 1:
        put("inter", children=[last])  # never: a whole is made last
    return {"has": any(has for _, has in made), "nodes": out[: last + 1]}


def trees(schemas: DataFrame) -> DataFrame:
    """type_id, path, has, nodes, texts of all places: ``has`` where a keyword speaks of it, ``texts`` the values listed there."""
    rows = rows_of(schemas)
    own = F.transform_values("operands", lambda _, o: F.when(o == "/$id", F.col("type_id")).otherwise(o))
    rows = rows.select("type_id", "path", F.struct("at", own.alias("operands"), "open").alias("r"), F.when(F.size("at") == 1, F.col("texts")).alias("texts"))
    grouped = rows.groupBy("type_id", "path").agg(F.collect_list("r").alias("rows"), F.first("texts", ignorenulls=True).alias("texts"))
    said = F.flatten(F.transform(F.filter("rows", lambda r: F.size(r["at"]) == 1), lambda r: F.transform(F.map_entries(r["operands"]), lambda e: F.struct(e["key"].alias("keyword"), e["value"].alias("operand")))))
    narrower = lambda a, b: (a["keyword"] == b["keyword"]) & (a["operand"] != b["operand"]) & ident.covers(a["operand"], b["operand"])
    wide = ident.let(said, lambda ops: F.filter(ops, lambda a: F.exists(ops, lambda b: narrower(a, b))))

    def made(batches):
        for b in batches:
            found = [_tree(list(r), list(w)) for r, w in zip(b["rows"], b["wide"], strict=True)]
            yield pd.DataFrame({"type_id": b["type_id"], "path": b["path"], "has": [t["has"] for t in found], "nodes": [t["nodes"] for t in found], "texts": b["texts"]})

    out = StructType().add("type_id", StringType()).add("path", StringType()).add("has", BooleanType()).add("nodes", ArrayType(NODE)).add("texts", _TEXTS)
    return grouped.select("type_id", "path", "rows", wide.alias("wide"), "texts").mapInPandas(made, out)


def relation(base: Column, derived: Column) -> Column:
    """Whether the scope ``derived`` lies within ``base``, for two columns of nodes: INCLUDED, UNKNOWN or EXCLUDED.

    All pairs of nodes are judged in turn, both ways round, children before parents; each finds its children's verdicts.
    """
    n, m = F.size(base), F.size(derived)

    def verdict(b: Column, d: Column, down: Column, across: Column, flipped: Column) -> Column:
        any_included = lambda some: F.when(F.array_contains(some, INCLUDED), INCLUDED).otherwise(UNKNOWN)
        worst = lambda some: F.coalesce(F.array_max(some), F.lit(INCLUDED))
        by_pattern = lambda x: x["keyword"] == PATTERN
        atoms = (
            F.when(d["empty"], INCLUDED).when(by_pattern(b) != by_pattern(d), UNKNOWN).when(b["keyword"] != d["keyword"], EXCLUDED)
            .when(ident.covers(b["operand"], d["operand"]), INCLUDED).otherwise(EXCLUDED)
        )
        return (
            F.when((b["kind"] == "undecidable") | (d["kind"] == "undecidable"), UNKNOWN).when(b["kind"] == "top", INCLUDED).when(d["kind"] == "top", EXCLUDED)
            .when(d["kind"] == "union", worst(down)).when(d["kind"] == "inter", any_included(down))
            .when(d["kind"] == "not", F.when(b["kind"] == "not", flipped).otherwise(UNKNOWN))
            .when(b["kind"] == "union", any_included(across)).when(b["kind"] == "inter", worst(across)).when(b["kind"] == "atom", atoms).otherwise(UNKNOWN)
        )

    def step(held: Column, k: Column) -> Column:
        i, j = F.floor(k / m).cast("int"), k % m
        found = lambda way, x, y: F.get(held[way], x * m + y)

        def judged(x: Column) -> Column:
            b, d = x["b"], x["d"]
            first = lambda v: F.get(v["below"], F.lit(0))
            down = lambda way: F.transform(d["below"], lambda c: found(way, i, c))
            across = lambda way: F.transform(b["below"], lambda c: found(way, c, j))
            there = verdict(b, d, down("there"), across("there"), found("back", first(b), first(d)))
            back = verdict(d, b, across("back"), down("back"), found("there", first(b), first(d)))
            return F.struct(F.concat(held["there"], F.array(there)).alias("there"), F.concat(held["back"], F.array(back)).alias("back"))

        return ident.let(F.struct(F.get(base, i).alias("b"), F.get(derived, j).alias("d")), judged)

    none = F.array().cast("array<int>")
    return F.aggregate(F.sequence(F.lit(0), n * m - 1), F.struct(none.alias("there"), none.alias("back")), step, lambda held: F.element_at(held["there"], -1))


def accepts(nodes: Column, value: Column) -> Column:
    """Whether a scope admits a text: what lists its values can lie within a scope without a keyword of its own."""
    type_ref = lambda x: x["keyword"] == KEYWORDS[0]

    def atom(x: Column) -> Column:
        shaped = F.when(x["keyword"] == PATTERN, ident.is_pattern(value)).otherwise(ident.is_valid(value) & (ident.is_type(value) == type_ref(x)))
        return ~x["empty"] & shaped & ident.covers(x["operand"], value)

    def step(held: Column, x: Column) -> Column:
        below = F.transform(x["below"], lambda c: F.get(held, c))
        one = F.when(x["kind"] == "top", True).when(x["kind"] == "not", ~F.get(below, F.lit(0))).when(x["kind"] == "union", F.array_contains(below, True)).when(x["kind"] == "inter", ~F.array_contains(below, False)).when(x["kind"] == "atom", F.coalesce(atom(x), F.lit(False))).otherwise(False)
        return F.concat(held, F.array(one))

    return F.aggregate(nodes, F.array().cast("array<boolean>"), step, lambda held: F.coalesce(F.element_at(held, -1), F.lit(False)))


def relations(pairs: DataFrame, schemas: DataFrame) -> DataFrame:
    """base, derived, relation of all pairs (base, derived): the worst at any place where the base has a keyword."""
    said = F.lit(False)
    for keyword in KEYWORDS:
        said |= F.col("content").contains(keyword)
    if schemas.filter(said).isEmpty():  # most sets of types: nothing to compare
        return pairs.select("base", "derived", F.lit(INCLUDED).alias("relation"))
    found = cut(trees(schemas))
    wide = found.filter("has").select(F.col("type_id").alias("base"), "path", F.col("nodes").alias("b"))
    other = found.select(F.col("type_id").alias("derived"), "path", F.col("nodes").alias("d"), "has", "texts")
    met = pairs.join(wide, "base").join(other, ["derived", "path"], "left")
    listed = F.col("texts").isNotNull() & F.forall("texts", lambda t: F.coalesce(accepts(F.col("b"), t), F.lit(False)))
    at = F.when(F.coalesce("has", F.lit(False)), relation(F.col("b"), F.col("d"))).when(F.coalesce(listed, F.lit(False)), INCLUDED).otherwise(EXCLUDED)
    worst = met.select("base", "derived", at.alias("r")).groupBy("base", "derived").agg(F.max("r").alias("r"))
    return pairs.join(worst, ["base", "derived"], "left").select("base", "derived", F.coalesce("r", F.lit(INCLUDED)).alias("relation"))
