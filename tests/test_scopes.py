"""Scopes of reference keywords: trees from schemas, and their relation against a plain recursion."""

import json
import random

from pyspark.sql import functions as F

from typeloom.operators import schemas, scopes

D7 = "http://json-schema.org/draft-07/schema#"
TYPE, INSTANCE, PATTERN = scopes.KEYWORDS


def types(spark, **bodies):
    rows = [(f"gts.lab.kit.set.{name}.v1~", {"$schema": D7} | body) for name, body in bodies.items()]
    return spark.createDataFrame([(k, k, json.dumps(b)) for k, b in rows], "entity_key string, gts_id string, content string")


def test_relations_of_schemas(spark):
    wide, narrow, other = {TYPE: "gts.mill.*"}, {TYPE: "gts.mill.shop.*"}, {TYPE: "gts.port.*"}
    either = {"anyOf": [wide, other]}
    ref = lambda name: {"$ref": f"gts://gts.lab.kit.set.{name}.v1~"}
    yes, unknown, no = scopes.INCLUDED, scopes.UNKNOWN, scopes.EXCLUDED
    cases = [
        (wide, narrow, yes), (narrow, wide, no), ({}, wide, yes), (wide, {}, no), (wide, {"type": "string"}, no),
        (either, narrow, yes), (narrow, either, no), (either, {"oneOf": [narrow, other]}, yes), (either, {"anyOf": [narrow, {}]}, no), (either, {"anyOf": [narrow, True]}, no),
        ({"not": narrow}, {"not": wide}, yes), ({"not": wide}, {"not": narrow}, no), ({"not": wide}, other, unknown),
        ({"allOf": [wide, {PATTERN: "gts.mill.*"}]}, narrow, unknown), (wide, {"allOf": [narrow, other]}, yes), (wide, {INSTANCE: "gts.mill.*"}, no), (wide, {PATTERN: "gts.mill.*"}, unknown),
        (wide, {"const": "gts.mill.a.b.c.v1~"}, yes), (wide, {"enum": ["gts.mill.a.b.c.v1~", "gts.port.a.b.c.v1~"]}, no), ({"not": wide}, {"enum": ["gts.port.a.b.c.v1~", "none"]}, yes), (wide, {"const": 5}, no), (wide, {"enum": []}, yes),
        (ref("wide"), ref("narrow"), yes), (ref("narrow"), ref("wide"), no), ({"anyOf": [ref("wide"), other]}, {"oneOf": [ref("narrow")]}, yes), (wide, ref("around"), unknown), (ref("around"), narrow, yes),
    ]
    bodies = {f"{side}{i}": {"properties": {"r": case[k]}} for i, case in enumerate(cases) for k, side in enumerate("bd")}
    t = types(spark, wide=wide, narrow=narrow, around={"anyOf": [ref("around"), wide]}, **bodies)
    key = "gts.lab.kit.set.{}{}.v1~".format
    pairs = spark.createDataFrame([(key("b", i), key("d", i)) for i in range(len(cases))], "base string, derived string")
    got = {r.base: r.relation for r in scopes.relations(pairs, t).collect()}
    for i, (base, derived, want) in enumerate(cases):
        assert got[key("b", i)] == want, (base, derived)


def test_places(spark):
    """Items by kind, further members, local references, the own type, operands of several branches of which the narrower stays."""
    wide, narrow = {TYPE: "gts.mill.*"}, {TYPE: "gts.mill.shop.*"}
    body = {
        "definitions": {"n": {"properties": {"id": narrow, "next": {"$ref": "#/definitions/n"}}}},
        "allOf": [{"properties": {"a": wide, "me": {TYPE: "/$id"}}}, {"properties": {"a": narrow}}],
        "properties": {"l": {"items": wide}, "t": {"items": [wide, narrow], "additionalItems": wide}, "p": {"prefixItems": [narrow]}, "n": {"$ref": "#/definitions/n"}},
        "additionalProperties": wide,
    }
    got = {r.path: r for r in scopes.trees(types(spark, own=body)).filter("has").collect()}
    atoms = {p: [n.operand for n in r.nodes if n.kind == "atom"] for p, r in got.items()}
    assert atoms == {
        "$.a": ["gts.mill.shop.*"], "$.me": ["gts.lab.kit.set.own.v1~"], "$.l[]": ["gts.mill.*"], "$.t[0]": ["gts.mill.*"], "$.t[1]": ["gts.mill.shop.*"], "$.t[]+": ["gts.mill.*"],
        "$.p[+0]": ["gts.mill.shop.*"], "$.n.id": ["gts.mill.shop.*"], "${}": ["gts.mill.*"],
    }


def test_fold_against_recursion(spark):
    """Random trees: the fold over pairs of nodes gives what a recursion over the definitions gives."""
    draw = random.Random(11)
    operands = ["gts.a.*", "gts.a.b.*", "gts.a.b.c.*", "gts.d.*"]

    def tree(depth):
        kind = draw.choice(["atom", "atom", "top", "undecidable"] if depth == 0 else ["atom", "union", "inter", "not", "union", "inter"])
        if kind == "atom":
            return (kind, draw.choice(scopes.KEYWORDS), draw.choice(operands), draw.random() < 0.1)
        return (kind, *(tree(depth - 1) for _ in range({"not": 1, "union": 3, "inter": 2}.get(kind, 0))))

    def flat(t, out):
        below = [flat(c, out) for c in t[1:]] if t[0] != "atom" else []
        out.append((t[0], *(t[1:] if t[0] == "atom" else (None, None, False)), below))
        return len(out) - 1

    def rel(b, d):
        if "undecidable" in (b[0], d[0]):
            return 1
        if b[0] == "top" or d[0] == "top":
            return 0 if b[0] == "top" else 2
        if d[0] == "union":
            return max(rel(b, c) for c in d[1:])
        if d[0] == "inter":
            return 0 if 0 in [rel(b, c) for c in d[1:]] else 1
        if d[0] == "not":
            return rel(d[1], b[1]) if b[0] == "not" else 1
        if b[0] == "union":
            return 0 if 0 in [rel(c, d) for c in b[1:]] else 1
        if b[0] == "inter":
            return max(rel(c, d) for c in b[1:])
        if b[0] == "not":
            return 1
        if d[3]:
            return 0
        if (b[1] == PATTERN) != (d[1] == PATTERN):
            return 1
        return 0 if b[1] == d[1] and d[2].startswith(b[2][:-1]) else 2

    pairs = [(tree(draw.randrange(4)), tree(draw.randrange(4))) for _ in range(150)]
    rows = []
    for i, (b, d) in enumerate(pairs):
        x, y = [], []
        flat(b, x), flat(d, y)
        rows.append((i, x, y))
    kind = "array<struct<kind:string,keyword:string,operand:string,empty:boolean,below:array<int>>>"
    got = spark.createDataFrame(rows, f"i int, b {kind}, d {kind}").select("i", scopes.relation(F.col("b"), F.col("d")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: rel(b, d) for i, (b, d) in enumerate(pairs)}


def test_in_verdicts(spark):
    """Derivation refuses what isn't known to be within the parent's scope; compatibility has it unknown."""
    rows = [
        ("gts.lab.kit.set.p.v1~", {"properties": {"r": {"anyOf": [{TYPE: "gts.mill.*"}, {TYPE: "gts.port.*"}]}}}),
        ("gts.lab.kit.set.p.v1~own.a.b.in.v1~", {"properties": {"r": {TYPE: "gts.port.x.*"}}}),
        ("gts.lab.kit.set.p.v1~own.a.b.out.v1~", {"properties": {"r": {"not": {TYPE: "gts.port.x.*"}}}}),
        ("gts.lab.kit.set.q.v1.0~", {"properties": {"r": {"not": {TYPE: "gts.mill.*"}}}}), ("gts.lab.kit.set.q.v1.1~", {"properties": {"r": {TYPE: "gts.port.*"}}}),
    ]
    t = spark.createDataFrame([(k, k, json.dumps({"$schema": D7} | b)) for k, b in rows], "entity_key string, gts_id string, content string")
    found = {r.type_id: r.errors for r in schemas.derivation(t).collect()}
    assert found[rows[1][0]] == [] and found[rows[2][0]] == ["$: a reference constraint isn't known to be within the parent's"]
    r = schemas.compatibility(t).head()
    assert (r.backward, r.forward, r.full) == ("unknown", "unknown", "unknown")
