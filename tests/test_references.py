"""Reference keywords on instances, patterns joined with identifiers, validity of what is referred to."""

import json
import random

from pyspark.sql import functions as F

from typeloom.functions import ident
from typeloom.operators import registry, relations, schemas
from typeloom.plans import evaluate, references

D7 = "http://json-schema.org/draft-07/schema#"
T, O = "gts.mill.shop.set.cup.v1~", "gts.port.shop.set.cup.v1~"  # noqa: E741
I = T + "mill.shop._.c.v1"  # noqa: E741
IN, OUT, NAMED, ANY = {"x-gts-type-ref": "gts.mill.*"}, {"x-gts-type-ref": "gts.port.*"}, {"x-gts-instance-ref": T + "*"}, {"x-gts-pattern-ref": "gts.mill.*"}


def test_walk(spark):
    """Each applicator with values that its references admit and that they don't."""
    at = lambda s: {"properties": {"r": s}}
    r = lambda *xs: [{"r": x} for x in xs]
    text, null = {"type": "string"}, {"type": "null"}
    by_kind = {"if": {"properties": {"k": {"const": 1}}}, "then": at(IN), "else": at(NAMED)}
    cases = [
        (at(IN), r(T, 5, None), r(O, I, "x", "gts.mill.*")), (at(NAMED), r(I), r(T, O)), (at(ANY), r(T, I, "gts.mill.shop.*"), r("gts.*", O, "x")),
        (at({"oneOf": [IN, OUT]}), r(T, O), r("gts.lab.a.b.c.v1~", 5)), (at({"oneOf": [IN, {"x-gts-type-ref": "gts.mill.shop.*"}]}), [], r(T)), (at({"anyOf": [IN, {"x-gts-type-ref": "gts.mill.shop.*"}]}), r(T), r(O)),
        (at({"anyOf": [IN, null]}), r(T, None), r(O)), (at({"anyOf": [IN, {}]}), r(O), []), (at({"anyOf": [IN, {"type": ["string", "integer"]}]}), r(O), []), (at({"allOf": [IN, ANY]}), r(T), r(O)),
        (at({"not": IN}), r(O, "x"), r(T)), (at({"not": text | IN}), r(5, O), r(T)), (at({"not": {"not": IN}}), r(T), r(O)),
        (by_kind, [{"k": 1, "r": T}, {"k": 2, "r": I}, {"r": T}], [{"k": 1, "r": I}, {"k": 2, "r": T}]),
        ({"if": at(IN), "then": {"required": ["x"]}}, [{"r": T, "x": 1}, {"r": O}], [{"r": T}]), ({"if": at(IN), "then": False}, [{"r": O}], [{"r": T}]), ({"if": True, "then": at(IN), "else": at(OUT)}, [{"r": T}], [{"r": O}]),
        ({"patternProperties": {"^a": IN}, "additionalProperties": OUT, "properties": {"p": {}}}, [{"ab": T, "z": O, "p": "x"}], [{"ab": O}, {"z": T}]),
        ({"items": IN}, [[T, 5], {}], [[T, O]]), ({"prefixItems": [IN, OUT], "items": NAMED}, [[T, O, I], [T]], [[O], [T, T], [T, O, T]]), ({"items": [IN], "additionalItems": OUT}, [[T, O]], [[T, T]]),
        ({"definitions": {"n": {"properties": {"id": IN, "next": {"$ref": "#/definitions/n"}}}}, "$ref": "#/definitions/n"}, [{"next": {"next": {"id": T}}}], [{"next": {"next": {"id": O}}}]),
        (at({"x-gts-type-ref": "/$id"}), r("gts.lab.kit.set.own.v1~"), r(T)), (at({"$ref": "gts://gts.lab.kit.set.far.v1~"}), r(T), r(O)),
    ]
    docs = [(i, json.dumps(d), good) for i, (_, yes, no) in enumerate(cases) for good, some in ((True, yes), (False, no)) for d in some]
    verdict = F.lit(None).cast("boolean")
    for i, (schema, *_) in enumerate(cases):
        found = references.errors(F.when(F.col("i") == i, F.col("t")), schema, {"gts.lab.kit.set.far.v1~": IN}, "gts.lab.kit.set.own.v1~")
        verdict = F.when(F.col("i") == i, F.size(found) == 0).otherwise(verdict)
    got = spark.createDataFrame(docs, "i int, t string, good boolean").withColumn("found", verdict).filter("found <> good").collect()
    assert not got, [(cases[r.i][0], r.t, r.good) for r in got]


def test_validation_with_references(spark):
    """Alternatives, conditions and stored targets through ``validate``; what is named must be valid where that is asked for."""
    own = "gts.lab.kit.set.own.v1~"
    rule = {"$id": f"gts://{own}", "$schema": D7, "properties": {"r": NAMED, "s": {"anyOf": [IN, OUT]}}}
    cup = {"$id": f"gts://{T}", "$schema": D7, "required": ["size"]}
    rows = [rule, cup, {"id": I, "size": 1}, {"id": T + "mill.shop._.bad.v1"}]
    rows += [{"id": own + f"a.b.c.n{k}.v1", **x} for k, x in enumerate([{"r": I, "s": T}, {"r": T + "mill.shop._.gone.v1"}, {"s": "gts.lab.a.b.c.v1~"}, {"r": T + "mill.shop._.bad.v1"}])]
    e = registry.entities_of(spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(rows)], "seq long, content string"))
    got = {x.entity_key: (x.reason, x.errors) for x in evaluate.validate(e).collect()}
    n = lambda k: got[own + f"a.b.c.n{k}.v1"]
    assert n(0) == (None, []) and n(1) == ("InvalidReference", ["r: x-gts-instance-ref NotStored"]) and n(2) == ("InvalidReference", ["$.s: anyOf of references"]) and n(3) == (None, [])
    assert got[T + "mill.shop._.bad.v1"][0] == "Invalid"
    strict = {x.entity_key: (x.reason, x.errors) for x in evaluate.validate(e, referred=True).collect()}
    assert strict[own + "a.b.c.n3.v1"] == ("InvalidReference", ["r: x-gts-instance-ref NotValid"]) and strict[own + "a.b.c.n0.v1"] == (None, [])


def test_patterns_joined_with_ids(spark):
    """All pairs of generated patterns and ids against the pattern's own test; repeated rows, odd texts, nulls."""
    draw = random.Random(6)
    name = lambda: draw.choice(["a", "b", "_"])
    segment = lambda: f"{name()}.{name()}.{name()}.{name()}.v{draw.randrange(2)}" + draw.choice(["", ".1"])
    ids = ["gts." + segment() + "~" + draw.choice(["", segment(), segment() + "~"]) for _ in range(150)]
    patterns = ["gts.*", "gts.a.*", *ids[:20], *(i.rsplit(".", draw.randrange(1, 4))[0] + ".*" for i in ids[:60] if "~" in i[:-1]), *("gts." + ".".join(name() for _ in range(draw.randrange(1, 5))) + ".*" for _ in range(20)), *(i.partition("~")[0] + "~*" for i in ids[20:40])]
    patterns = [p for p in patterns if ident.is_pattern_text(p)]
    p = spark.createDataFrame([(x, 1) for x in [*patterns, None, "x", "gts.none.*"]], "pattern string, names int").drop("names")
    i = spark.createDataFrame([(x,) for x in [*ids, ids[0], None, "gts.a"]], "id string")
    got = sorted((r.pattern, r.id) for r in relations.selected(p, i).collect())
    both = p.distinct().crossJoin(i.distinct()).filter(ident.covers(F.col("pattern"), F.col("id")) & ident.is_valid(F.col("id"))).collect()
    times = lambda r: patterns.count(r.pattern) * ([*ids, ids[0]].count(r.id))
    assert got == sorted((r.pattern, r.id) for r in both for _ in range(times(r)))
    none = {r.pattern for r in relations.unmatched(p, i).collect()}
    assert none == ({*patterns, None, "x", "gts.none.*"} - {r.pattern for r in both})


def test_operands_are_looked_up(spark):
    body = {"$schema": D7, "properties": {"a": IN, "b": OUT, "c": {"x-gts-type-ref": O}, "d": {"x-gts-pattern-ref": "gts.port.*"}}, "if": {"not": {"x-gts-instance-ref": "gts.none.*"}}}
    e = registry.entities_of(spark.createDataFrame([(0, json.dumps({"$id": f"gts://{T}"} | body))], "seq long, content string"))
    got = sorted((r.path, r.operand, r.reason) for r in schemas.operand_errors(e, e).collect())
    assert got == [("#/if/not", "gts.none.*", "NoMatch"), ("#/properties/b", "gts.port.*", "NoMatch"), ("#/properties/c", O, "NotStored")]
