"""Keywords at every position, redeclarations and closed branches, traits along chains."""

import json

from pyspark.sql import functions as F

from typeloom.operators import keywords, schemas

D7, D19, D20 = "http://json-schema.org/draft-07/schema#", "https://json-schema.org/draft/2019-09/schema", "https://json-schema.org/draft/2020-12/schema"
KEY = "gts.lab.kit.set.{}.v1~".format


def types(spark, bodies, dialect=D7):
    rows = [(k, k, True, None, i, json.dumps({"$id": f"gts://{k}", "$schema": dialect} | b if isinstance(b, dict) else b)) for i, (k, b) in enumerate(bodies.items())]
    return spark.createDataFrame(rows, "entity_key string, gts_id string, is_schema boolean, schema_id string, seq long, content string")


def test_every_position(spark):
    """One wrong value below each keyword that holds schemas is found, and none below literals."""
    bad = {"minLength": -1}
    places = [{k: {"a": bad}} for k in keywords.BY_NAME] + [{k: [bad]} for k in keywords.LISTED] + [{k: bad} for k in keywords.SINGLE] + [{"items": [bad]}]
    literal = [{"const": bad}, {"enum": [bad]}, {"default": bad}, {"examples": [bad]}, {"x-unknown": bad}, {"dependencies": {"a": ["minLength"]}}]
    t = types(spark, {KEY(f"t{i}"): s for i, s in enumerate(places + literal)}, D19)
    got = {r.type_id for r in keywords.dialect_errors(keywords.facts(t)).filter(F.col("error").contains("minLength")).collect()}
    assert got == {KEY(f"t{i}") for i in range(len(places))}


def test_dialects(spark):
    """Each rule with values it admits and values it doesn't, in the dialects that have it."""
    cases = [
        ({"type": "integer"}, True), ({"type": ["string", "null"]}, True), ({"type": "text"}, False), ({"type": []}, False), ({"type": ["string", "string"]}, False), ({"type": 5}, False),
        ({"required": []}, True), ({"required": ["a", "b"]}, True), ({"required": ["a", "a"]}, False), ({"required": "a"}, False), ({"required": [1]}, False),
        ({"maxItems": 0}, True), ({"maxItems": 2.0}, True), ({"maxItems": 1.5}, False), ({"minimum": "1"}, False), ({"minimum": -1.5}, True), ({"multipleOf": 0}, False), ({"multipleOf": 0.1}, True), ({"uniqueItems": 1}, False),
        ({"allOf": []}, False), ({"anyOf": [True]}, True), ({"oneOf": {}}, False), ({"not": []}, False), ({"not": False}, True), ({"properties": []}, False), ({"properties": {"a": 5}}, False), ({"pattern": 5}, False), ({"enum": "a"}, False),
        ({"dependencies": {"a": ["b"], "c": {}}}, True), ({"dependencies": {"a": [1]}}, False), ({"if": None}, False),
    ]
    for dialect in (D7, D19, D20):
        t = types(spark, {KEY(f"t{i}"): s for i, (s, _) in enumerate(cases)}, dialect)
        wrong = {r.type_id for r in keywords.dialect_errors(keywords.facts(t)).collect()}
        assert [(s, KEY(f"t{i}") not in wrong) for i, (s, _) in enumerate(cases)] == cases
    own = [({"items": [{}]}, (True, True, False)), ({"prefixItems": []}, (True, True, False)), ({"$anchor": "1"}, (True, False, False)), ({"dependentRequired": {"a": ["b", "b"]}}, (True, False, False)), ({"dependentRequired": {"a": ["b"]}}, (True,) * 3), ({"minContains": -1}, (True, False, False))]
    for k, dialect in enumerate((D7, D19, D20)):
        wrong = {r.type_id for r in keywords.dialect_errors(keywords.facts(types(spark, {KEY(f"t{i}"): s for i, (s, _) in enumerate(own)}, dialect))).collect()}
        assert [KEY(f"t{i}") not in wrong for i in range(len(own))] == [ok[k] for _, ok in own]


def test_report_stages(spark):
    bodies = {
        "good": {"properties": {"a": {"$ref": "#x"}}, "definitions": {"x": {"$id": "#x"}}}, "deep": {"anyOf": [{"not": {"x-gts-other": 1}}]}, "placed": {"properties": {"a": {"x-gts-final": True}}},
        "lost": {"if": {"$ref": "#/definitions/none"}}, "anchor": {"contains": {"$ref": "#none"}}, "http": {"patternProperties": {"a": {"$ref": "http://x/y"}}},
        "meta": {"then": {"required": "a"}}, "name": {"patternProperties": {"(?=a)": {}}}, "value": {"dependencies": {"a": {"pattern": "a(?!b)"}}},
    }
    got = {r.type_id: r.stage for r in schemas.type_report(types(spark, {KEY(k): b for k, b in bodies.items()})).collect()}
    want = dict(zip(bodies, [None, "Keywords", "Keywords", "References", "References", "References", "Schema", "Patterns", "Patterns"], strict=True))
    assert got == {KEY(k): s for k, s in want.items()}


def test_redeclarations_and_closed_branches(spark):
    """What a type says of a member anew must narrow it by itself; a closed branch restates what its parent knows."""
    p = KEY("p")
    base = {"properties": {"a": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}, "y": {"type": "object", "properties": {"z": {"type": "string"}}}}}, "l": {"type": "array", "items": {"type": "string"}}}}
    over = lambda body: {"allOf": [{"$ref": f"gts://{p}"}, {"properties": body}]}
    kids = {
        "same": (over({"a": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 2}}}}), True),
        "untyped": (over({"a": {"properties": {"x": {"type": "integer", "minimum": 1}}}}), False),
        "looser": (over({"a": {"type": "object", "properties": {"x": {"type": "integer"}}}}), False),
        "below": (over({"a": {"type": "object", "properties": {"y": {"type": "object"}}}}), False),
        "whole": (over({"a": {"type": "object", "properties": {"y": {"type": "object", "properties": {"z": {"type": "string", "maxLength": 3}}}}}}), True),
        "list": (over({"l": {"type": "array"}}), False),
        "none": ({"allOf": [{"$ref": f"gts://{p}"}]}, True),
        "shut": ({"allOf": [{"$ref": f"gts://{p}"}, {"properties": {"b": {}}, "additionalProperties": False}]}, False),
        "restated": ({"allOf": [{"$ref": f"gts://{p}"}, {"properties": {"a": base["properties"]["a"], "l": base["properties"]["l"], "b": {}}, "additionalProperties": False}]}, True),
    }
    t = types(spark, {p: base} | {p + f"own.a.b.{k}.v1~": b for k, (b, _) in kids.items()})
    got = {r.type_id: r.errors for r in schemas.derivation(t).collect()}
    assert {k: got[p + f"own.a.b.{k}.v1~"] == [] for k in kids} == {k: ok for k, (_, ok) in kids.items()}, got


def test_nested_traits(spark):
    """Objects merge along the chain, nulls take members away, other values replace; declarations are put together through references."""
    a, b, c = KEY("p"), KEY("p") + "own.a.b.c.v1~", KEY("p") + "own.a.b.c.v1~own.a.b.d.v1~"
    declared = {"$ref": f"gts://{KEY('decl')}"}
    t = types(spark, {
        KEY("decl"): {"properties": {"o": {"type": "object"}, "n": {"type": "integer"}}, "required": ["n"], "additionalProperties": False},
        a: {"x-gts-abstract": True, "x-gts-traits-schema": declared, "x-gts-traits": {"o": {"k": 1, "l": {"m": 1}}}},
        b: {"x-gts-traits": {"o": {"l": {"n": 2}, "k": None}, "n": 5}}, c: {"x-gts-traits": {"o": {"l": 7}, "other": 1}},
        KEY("q"): {"x-gts-traits-schema": {"$ref": "gts://gts.lab.kit.set.gone.v1~"}},
    })
    got = {(r.type_id, r.trait): json.loads(r.value) for r in schemas.traits(t).collect()}
    assert got == {(a, "o"): {"k": 1, "l": {"m": 1}}, (b, "o"): {"l": {"m": 1, "n": 2}}, (b, "n"): 5, (c, "o"): {"l": 7}, (c, "n"): 5, (c, "other"): 1}
    errors = {r.type_id: r.errors for r in schemas.trait_errors(t).collect()}
    assert errors[b] == [] and errors[a] == [] and errors[c] == ["trait other: unknown"] and errors[KEY("q")] == ["declaration: missing type: gts.lab.kit.set.gone.v1~"]


def test_merge_patch():
    """The cases of the merge patch: by member, deep, null, arrays and scalars in place of objects."""
    merge = schemas.merge_patched
    assert merge({"a": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3} and merge({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"c": 2}}
    assert merge({"a": [1]}, {"a": {"b": None, "c": 1}}) == {"a": {"c": 1}} and merge(5, {"a": None}) == {} and merge({"a": 1}, [1]) == [1]
