"""The evaluator's keywords by dialect, anchors and dynamic references, formats, patterns in both engines, the normal form."""

import json
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from typeloom.functions import normal, patterns
from typeloom.operators import registry
from typeloom.plans import evaluate

D7, D19, D20 = "http://json-schema.org/draft-07/schema#", "https://json-schema.org/draft/2019-09/schema", "https://json-schema.org/draft/2020-12/schema"


def holds(spark, cases, types=None):
    """Verdicts of all (schema, documents that hold, documents that don't) in one plan."""
    docs = [(i, json.dumps(d), good) for i, (_, yes, no) in enumerate(cases) for good, some in ((True, yes), (False, no)) for d in some]
    verdict = F.lit(None).cast("boolean")
    for i, (schema, *_) in enumerate(cases):
        verdict = F.when(F.col("i") == i, F.size(evaluate.errors(F.when(F.col("i") == i, F.col("t")), schema, types)) == 0).otherwise(verdict)
    got = spark.createDataFrame(docs, "i int, t string, good boolean").withColumn("found", verdict).filter("found <> good").collect()
    assert not got, [(cases[r.i][0], r.t, r.good) for r in got]


def test_members_and_items_not_evaluated(spark):
    low = {"properties": {"a": {"type": "integer"}}, "required": ["a"]}
    holds(spark, [
        ({"unevaluatedProperties": False}, [{}, 5], [{"a": 1}]),
        ({"properties": {"b": {}}, "allOf": [low], "unevaluatedProperties": False}, [{"a": 1, "b": 2}], [{"a": 1, "c": 1}]),
        ({"anyOf": [low, {"properties": {"b": {"type": "string"}}, "required": ["b"]}], "unevaluatedProperties": False}, [{"a": 1}, {"a": 1, "b": "x"}], [{"a": 1, "b": 5}, {"a": 1, "z": 1}]),
        ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"x": {}}}, "else": {"properties": {"y": {}}}, "unevaluatedProperties": False}, [{"k": 1, "x": 1}, {"y": 2}], [{"k": 1, "y": 1}, {"k": 2}, {"x": 1}]),
        ({"patternProperties": {"^p": {}}, "$ref": "#/$defs/r", "$defs": {"r": {"properties": {"q": {}}}}, "unevaluatedProperties": {"type": "null"}}, [{"p1": 1, "q": 2, "z": None}], [{"z": 0}]),
        ({"allOf": [{"additionalProperties": {"type": "integer"}}], "unevaluatedProperties": False}, [{"a": 1}], [{"a": "x"}]),
        ({"allOf": [{"unevaluatedProperties": True}], "unevaluatedProperties": False}, [{"a": 1}], []),
        ({"not": {"properties": {"a": {"const": 2}}, "required": ["a"]}, "unevaluatedProperties": False}, [{}], [{"a": 1}]),
        ({"dependentSchemas": {"a": {"properties": {"a": {}, "b": {}}}}, "unevaluatedProperties": False}, [{"a": 1, "b": 1}, {}], [{"b": 1}]),
        ({"prefixItems": [{}], "unevaluatedItems": False}, [[1], []], [[1, 2]]),
        ({"allOf": [{"prefixItems": [{}, {}]}], "unevaluatedItems": {"type": "string"}}, [[1, 2, "x"]], [[1, 2, 3]]),
        ({"anyOf": [{"prefixItems": [{"const": 1}]}, {"items": {"type": "integer"}}], "unevaluatedItems": False}, [[1], [2, 3]], [[1, "x"], ["x"]]),
        ({"$schema": D20, "contains": {"type": "string"}, "unevaluatedItems": False}, [["a", "b"]], [["a", 1]]),
        ({"$schema": D19, "contains": {"type": "string"}, "unevaluatedItems": False}, [], [["a", "b"]]),
        ({"$schema": D19, "items": [{}], "unevaluatedItems": False}, [[1]], [[1, 2]]),
        ({"$schema": D7, "unevaluatedProperties": False, "dependentSchemas": {"a": False}}, [{"a": 1}], []),
    ])


def test_dependencies_and_counts(spark):
    holds(spark, [
        ({"dependentSchemas": {"a": {"required": ["b"]}, "c": False}}, [{"a": 1, "b": 1}, {"b": 1}, "x"], [{"a": 1}, {"c": 1}]),
        ({"$schema": D7, "dependencies": {"a": ["b"], "c": {"properties": {"d": {"type": "null"}}}}}, [{"a": 1, "b": 1}, {"c": 1, "d": None}, {"d": 1}], [{"a": 1}, {"c": 1, "d": 1}]),
        ({"$schema": D20, "dependencies": {"a": ["b"]}}, [{"a": 1}], []),
        ({"contains": {"type": "string"}}, [["a"], {}], [[], [1]]),
        ({"contains": {"type": "string"}, "minContains": 2, "maxContains": 3}, [["a", "b", 1], ["a"] * 3], [["a"], ["a"] * 4]),
        ({"contains": {"type": "string"}, "minContains": 0, "maxContains": 1}, [[], [1], ["a"]], [["a", "b"]]),
        ({"$schema": D7, "contains": {"type": "string"}, "minContains": 2}, [["a"]], [[]]),
        ({"$schema": D7, "$ref": "#/definitions/i", "minimum": 10, "definitions": {"i": {"type": "integer"}}}, [1], ["x"]),
        ({"$schema": D19, "$ref": "#/definitions/i", "minimum": 10, "definitions": {"i": {"type": "integer"}}}, [11], [1, "x"]),
        ({"$schema": D20, "items": {"type": "integer"}, "prefixItems": [{"type": "string"}]}, [["a", 1]], [["a", "b"], [1]]),
    ])


def test_anchors(spark):
    other = "gts.lab.kit.set.other.v1~"
    types = {other: {"$id": f"gts://{other}", "$defs": {"n": {"$anchor": "num", "type": "integer"}}, "type": "string"}}
    holds(spark, [
        ({"$ref": "#item", "$defs": {"x": {"$anchor": "item", "type": "null"}}}, [None], [{}]),
        ({"$schema": D7, "properties": {"a": {"$ref": "#old"}}, "definitions": {"x": {"$id": "#old", "type": "null"}}}, [{"a": None}], [{"a": 1}]),
        ({"properties": {"a": {"$ref": f"gts://{other}#num"}, "b": {"$ref": f"gts://{other}"}, "c": {"$ref": f"gts://{other}#/$defs/n"}}}, [{"a": 1, "b": "x", "c": 2}], [{"a": "x"}, {"b": 1}, {"c": "x"}]),
        ({"$ref": "#/$defs/a%20b~1c", "$defs": {"a b/c": {"type": "null"}}}, [None], [1]),
        # within an embedded resource its own definitions count
        ({"$ref": "urn:in", "$defs": {"t": {"type": "null"}, "e": {"$id": "urn:in", "$ref": "#/$defs/t", "$defs": {"t": {"type": "string"}}}}}, ["x"], [None]),
        ({"properties": {"const": {"const": {"$anchor": "no"}}, "a": {"$ref": "#yes"}}, "$defs": {"no": {"$anchor": "yes"}}}, [{"a": 1}], []),
    ], types)
    for lost in ({"$ref": "#none"}, {"$ref": "#/$defs/none"}, {"enum": [{"$anchor": "x"}], "$ref": "#x"}, {"$ref": 5}):
        with pytest.raises(evaluate.SchemaError):
            evaluate.errors(F.col("t"), lost)


def test_dynamic_references(spark):
    """A list of any, made strict from outside by the anchor of the same name; a recursive anchor likewise."""
    base = {"$id": "gts://gts.lab.kit.set.list.v1~", "$schema": D20, "type": "array", "items": {"$dynamicRef": "#element"}, "$defs": {"any": {"$dynamicAnchor": "element"}}}
    strict = {"$id": "gts://gts.lab.kit.set.strict.v1~", "$schema": D20, "$ref": "gts://gts.lab.kit.set.list.v1~", "$defs": {"e": {"$dynamicAnchor": "element", "type": "integer"}}}
    plain = {"$id": "gts://gts.lab.kit.set.plain.v1~", "$schema": D20, "$ref": "gts://gts.lab.kit.set.list.v1~", "$defs": {"e": {"$anchor": "element", "type": "integer"}}}
    tree = {"$id": "gts://gts.lab.kit.set.tree.v1~", "$schema": D19, "$recursiveAnchor": True, "properties": {"kids": {"items": {"$recursiveRef": "#"}}}}
    closed = {"$id": "gts://gts.lab.kit.set.closed.v1~", "$schema": D19, "$recursiveAnchor": True, "$ref": "gts://gts.lab.kit.set.tree.v1~", "unevaluatedProperties": False}
    types = {x["$id"].removeprefix("gts://"): x for x in (base, strict, plain, tree, closed)}
    holds(spark, [
        (base, [["x", 1]], [5]), (strict, [[1, 2]], [["x"]]), (plain, [["x"]], []),
        (tree, [{"kids": [{"odd": 1}]}], []), (closed, [{"kids": [{"kids": []}]}], [{"odd": 1}, {"kids": [{"odd": 1}]}]),
    ], types)
    assert evaluate.refers_to_itself(closed, types, "gts.lab.kit.set.closed.v1~")


def test_formats(spark):
    """Texts made from the parts of each format, one part changed at a time."""
    cases = {
        "ipv6": (["::ffff:1.2.3.4", "::", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "fe80::a"], ["::ffff:1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4", "1:2:3:4:5:6:7", "12345::", ":::"]),
        "time": (["00:00:00Z", "23:59:59.5+23:00"], ["24:00:00Z", "00:60:00Z", "00:00:60Z", "00:00:00", "00:00:00+24:00"]),
        "date-time": (["2024-02-29T00:00:00Z", "2023-01-01t00:00:00.25-14:00"], ["2023-02-29T00:00:00Z", "0000-01-01T00:00:00Z", "2023-01-01T00:00:60Z", "2023-01-01T00:00:00+14:30", "2023-01-01 00:00:00Z"]),
        "date": (["2024-02-29"], ["2023-02-29", "0000-01-01", "2024-2-29"]),
        "hostname": (["a.b-c.d"], ["-a", "a-", "a..b", "a" * 64]),
        "uuid": (["0f8fad5b-d9cb-469f-a165-70867728950e"], ["0f8fad5bd9cb469fa16570867728950e", "{0f8fad5b-d9cb-469f-a165-70867728950e}"]),
    }
    holds(spark, [({"format": name}, [*yes, 5, None], no) for name, (yes, no) in cases.items()])


def test_patterns_in_both_engines(spark):
    """Generated expressions of the profile find the same texts by the automaton and by the JVM."""
    draw = random.Random(8)
    atoms = ["a", "b", ".", r"\s", r"\S", r"\d", r"\w", r"\W", "[a-c]", r"[^\s]", r"[\sx]", r"[^ab]", r"\.", r"\/", r"\v", r"[\v]", r"\x41", r"\n", "é", "\U0001f600", r"[\-a]"]

    def made(depth):
        parts = []
        for _ in range(draw.randint(1, 3)):
            atom = draw.choice(atoms) if depth == 0 or draw.random() < 0.7 else f"({draw.choice(['', '?:'])}{made(depth - 1)}|{made(depth - 1)})"
            parts.append(atom + draw.choice(["", "", "", "*", "+", "?", "{1,2}", "*?"]))
        return draw.choice(["", "", "^"]) + "".join(parts) + draw.choice(["", "", "$"])

    found = [p for p in {made(2) for _ in range(400)} if patterns.refusal(p) is None and patterns.for_jvm(p) is not None]
    assert len(found) > 150
    texts = ["", "a", "a\n", "\n", "a\rc", "ab", "x b", "\x0b", "\x1c", "A9", "é", "\U0001f600", "a.b/", " ", "-", "aé b\n", "a\x85b", "ba\t", "\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array(*(F.col("t").rlike(patterns.for_jvm(p)) for p in found)).alias("got"))
    for r in df.collect():
        want = [pc.match_substring_regex(pa.array([r.t]), p)[0].as_py() for p in found]
        assert r.got == want, [(p, r.t) for p, x, y in zip(found, r.got, want, strict=True) if x != y][:3]
    assert all(patterns.for_jvm(p) is None for p in (r"[\S]", r"[^a\S]"))


def test_normal_form(spark):
    t, i = {"x-gts-type-ref": "gts.lab.*"}, {"x-gts-instance-ref": "gts.lab.*"}
    text = {"type": "string"}
    cases = [
        (text | t, text), ({"oneOf": [text | t, text | i]}, {"anyOf": [text, text]}), ({"oneOf": [t, i]}, {}), ({"oneOf": [text | t], "anyOf": [{}, text]}, {"oneOf": [text], "anyOf": [{}, text]}),
        ({"not": text | t, "minLength": 1}, {"minLength": 1}), ({"not": text}, {"not": text}), ({"not": {"properties": {"a": t}}}, {}),
        ({"if": {"properties": {"a": t}}, "then": text, "else": text, "title": "x"}, {"title": "x"}), ({"if": text, "then": t}, {"if": text, "then": {}}),
        ({"properties": {"a": t, "x-gts-type-ref": text}}, {"properties": {"a": {}, "x-gts-type-ref": text}}), ({"const": t}, {"const": t}), ({"$$id": "a", "allOf": [{"$$ref": "b"}]}, {"$id": "a", "allOf": [{"$ref": "b"}]}),
        ({"$schema": D7, "$$id": "a"}, {"$schema": D7, "$$id": "a"}), (True, True),
    ]
    df = spark.createDataFrame([(k, json.dumps(a)) for k, (a, _) in enumerate(cases)] + [(99, "{")], "k int, t string").select("k", normal.normal_form("t").alias("n"))
    got = {r.k: r.n and json.loads(r.n) for r in df.collect()}
    assert got == {k: b for k, (_, b) in enumerate(cases)} | {99: None}


def test_normal_form_in_validation(spark):
    """Branches that differ by reference keywords alone don't exclude each other; a negated reference is for the reference checks."""
    name = "gts.lab.kit.set.item.v1~"
    schema = {"$id": f"gts://{name}", "$schema": D7, "type": "object", "properties": {"r": {"oneOf": [{"type": "string", "x-gts-type-ref": "gts.lab.*"}, {"type": "string", "x-gts-type-ref": "gts.port.*"}]}, "s": {"not": {"type": "string", "x-gts-pattern-ref": "gts.lab.*"}}}}
    rows = [json.dumps(schema), json.dumps({"id": name + "own.a.b.c.v1", "r": name, "s": "gts.port.*"})]
    e = registry.entities_of(spark.createDataFrame(list(enumerate(rows)), "seq long, content string"))
    assert [(r.reason, r.errors) for r in evaluate.validate(e).collect()] == [(None, [])]


def plain_tree(d, low, high, members):
    """Whether a document is a tree of objects with an integer ``n`` within the bounds, by recursion."""
    if not isinstance(d, dict) or not isinstance(d.get("n"), int) or not low <= d["n"] <= high or set(d) - {"n", *members}:
        return False
    return all(plain_tree(d[m], low, high, members) for m in members if m in d)


def grown(r, depth, spoilt):
    """A document of two branches, one of them ``depth`` levels deep; ``spoilt``: what stands at its deepest place."""
    if depth == 0:
        return {"n": r.randrange(10)} if spoilt is None else spoilt
    sides = ["left", "right"]
    r.shuffle(sides)
    return {"n": r.randrange(10), sides[0]: grown(r, depth - 1, spoilt), **({sides[1]: {"n": 1}} if r.random() < 0.5 else {})}


def test_trees_deeper_than_the_plan(spark):
    """Two and more references to itself and any depth: the plan stays small, and verdicts are those of a recursion."""
    r = random.Random(4)
    node = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "left": {"$ref": "#"}, "right": {"$ref": "#"}}, "additionalProperties": False}
    docs = [grown(r, depth, spoilt) for depth in (0, 1, 4, 5, 9, 30) for spoilt in (None, {"n": 10}, {"n": 1, "x": 1}, 5, {})]
    cases = [(node, [d for d in docs if plain_tree(d, 0, 9, ("left", "right"))], [d for d in docs if not plain_tree(d, 0, 9, ("left", "right"))])]
    assert len(cases[0][1]) >= 6 and len(cases[0][2]) >= 20
    holds(spark, cases)


def test_what_is_looked_up_stands_anywhere(spark):
    """Below the written levels a reference may stand in a negation, an alternative, an item, a name or another definition."""
    deep = lambda n, leaf, wrap: leaf if n == 0 else wrap(deep(n - 1, leaf, wrap))
    nots = {"type": "object", "properties": {"not": {"not": {"$ref": "#"}}}, "required": ["k"]}
    flip = lambda x: {"k": 1, "not": x}
    either = {"oneOf": [{"type": "integer"}, {"type": "array", "items": {"$ref": "#"}, "minItems": 1}]}
    two = {"$ref": "#/$defs/a", "$defs": {
        "a": {"type": "object", "properties": {"b": {"$ref": "#/$defs/b"}, "c": {"$ref": "#/$defs/c"}}, "maxProperties": 1},
        "b": {"type": "object", "properties": {"a": {"$ref": "#/$defs/a"}, "c": {"$ref": "#/$defs/c"}}, "required": ["v"]},
        "c": {"anyOf": [{"type": "string", "pattern": "^(a+)+$"}, {"$ref": "#/$defs/a"}, {"$ref": "#/$defs/b"}]},
    }}
    turn = lambda x: {"b": {"v": 1, "c": x}}
    closed = {"allOf": [{"properties": {"v": {}, "next": {"$ref": "#"}}}], "unevaluatedProperties": False}
    names = {"properties": {"in": {"$ref": "#"}}, "propertyNames": {"maxLength": 3}, "additionalProperties": {"$ref": "#"}}
    ends = lambda i: ({}, {"k": 1}) if i % 2 else ({"k": 1}, {})
    item, again, other = (lambda x: [2, x]), (lambda x: {"next": x}), (lambda x: {"in": x, "o": x})
    depths = (1, 3, 6, 7, 11)
    every = lambda *pairs: [deep(i, leaf(i) if callable(leaf) else leaf, wrap) for i in depths for leaf, wrap in pairs]
    holds(spark, [
        (nots, every((lambda i: ends(i)[0], flip)), every((lambda i: ends(i)[1], flip))),
        (either, every((1, item)), every(("s", item), ([], lambda x: [x]))),
        (two, every(("aaa", turn), ({}, turn)), every(("aab", turn), ({"b": {}}, turn), (5, turn))),
        (closed, every(({"v": 1}, again)), every(({"w": 1}, again))),
        (names, every(({"abc": {}}, other)), every(({"abcd": {}}, other))),
    ])


def test_many_definitions_that_refer_to_each_other(spark):
    """A plan that writes all ways out would be endless: 12 definitions, each with a reference to every one."""
    defs = {f"d{i}": {"type": "object", "properties": {"t": {"const": i}, **{f"m{j}": {"$ref": f"#/$defs/d{j}"} for j in range(12)}}, "required": ["t"]} for i in range(12)}
    body = {"$ref": "#/$defs/d0", "$defs": defs}
    good = {"t": 11}
    for i in (3, 7, 2, 2, 9):
        good = {"t": i, f"m{11 if good == {'t': 11} else last}": good}
        last = i
    good = {"t": 0, f"m{last}": good}
    bad = json.loads(json.dumps(good).replace('{"t": 11}', '{"t": 10}'))
    holds(spark, [(body, [good, {"t": 0}], [bad, {"t": 1}, {"t": 0, "m4": {"t": 5}}])])


def test_a_reference_to_itself_at_the_same_value():
    for loop in ({"$ref": "#"}, {"anyOf": [{"type": "null"}, {"$ref": "#"}]}, {"$ref": "#/$defs/a", "$defs": {"a": {"allOf": [{"$ref": "#/$defs/a"}]}}}):
        with pytest.raises(evaluate.SchemaError):
            evaluate.errors(F.lit("{}"), loop)
