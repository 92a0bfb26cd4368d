"""Identifiers, documents, registry, schemas: the cases of the fixtures, and the queries against DuckDB."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from typeloom import queries
from typeloom.functions import ident, jsons, patterns
from typeloom.operators import registry, relations, schemas
from typeloom.plans import evaluate, query
from typeloom.sources import files

DIR = "/root/testdata/sf0.001"
D7 = "http://json-schema.org/draft-07/schema#"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).head()[0]


def number_by_hand(text):
    return text.isascii() and text.isdigit() and (text == "0" or text[0] != "0") and int(text) < 2**32


def segment_by_hand(text):
    *names, version, minor = [*text.split("."), None] if text.count(".") == 4 else text.split(".") if text.count(".") == 5 else ["", "", "", "", "", None]
    named = all(n and set(n) <= set("abcdefghijklmnopqrstuvwxyz0123456789_") and n[0] not in "0123456789" for n in names)
    return named and version[:1] == "v" and number_by_hand(version[1:]) and (minor is None or number_by_hand(minor))


def valid_by_hand(text):
    if text is None or len(text) > 1024 or text[:4] != "gts." or "~" not in text:
        return False
    *types, last = text[4:].split("~")
    hexes = last.split("-")
    tail = [len(h) for h in hexes] == [8, 4, 4, 4, 12] and set("".join(hexes)) <= set("0123456789abcdef")
    return all(map(segment_by_hand, types)) and (last == "" or tail or segment_by_hand(last))


def made_ids(rng, n, minors=("", ".0", ".1", ".7")):
    """Chains of one to three segments over few names, types and instances."""
    name = lambda: rng.choice(["a", "b", "_c", "d0"])
    segment = lambda: f"{name()}.{name()}.{name()}.{name()}.v{rng.choice([0, 1])}{rng.choice(minors)}"
    tails = ["", "", "0a1b2c3d-0000-1111-2222-333344445555"]
    return ["gts." + "".join(segment() + "~" for _ in range(rng.randint(1, 2))) + rng.choice([*tails, segment(), segment()]) for _ in range(n)]


def test_valid(spark):
    """Generated identifiers, with single characters changed, and numbers and lengths around their limits, against a parser by hand."""
    rng = random.Random(1)
    texts = made_ids(rng, 400)
    for t in texts[:]:
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + rng.choice([*"~.v0_-1aG*\n ", ""]) + t[at + rng.randrange(2) :])
    texts += [f"gts.a.b.c.d.v{k}{m}~" for k in (0, "00", 2**32 - 1, 2**32, 10**12, "-1", "") for m in ("", ".0", ".01", f".{2**32 - 1}", f".{2**32}")]
    texts += ["gts." + "a" * (1024 - 4 - len(".b.c.d.v1~") + k) + ".b.c.d.v1~" for k in (-1, 0, 1)] + ["", None, "gts.", "gts.~"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ident.is_valid(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == {t: valid_by_hand(t) for t in texts}
    assert 100 < sum(r.v for r in got) < len(got) - 100


def matched_by_hand(text, pattern, older):
    """By segments: a missing minor version stands for any; of what follows a type, or stands before a wildcard, the text must begin so."""
    *inner, last = pattern.removeprefix("gts.").split("~")
    rest = text.removeprefix("gts.")
    same = lambda p, s: s == p or segment_by_hand(s) and p.count(".") == 4 and s.rpartition(".")[0] == p
    for p in inner:
        s, mark, rest = rest.partition("~")
        if not mark or not same(p, s):
            return False
    if last in ("", "*"):
        return not (older and last == "*" and not rest)
    if last.endswith("*"):
        return rest.startswith(last[:-1])
    return rest == last if older else same(last, rest)


def test_match(spark):
    """Generated patterns against generated identifiers by both matchers."""
    rng = random.Random(2)
    ids = sorted(set(made_ids(rng, 150)))
    patterns = {*rng.sample(ids, 10), *(i.partition("~")[0] + end for i in rng.sample(ids, 10) for end in ("~", "~*"))}
    patterns |= {i.rsplit(".", rng.randrange(1, 4))[0] + ".*" for i in rng.sample(ids, 30) if "-" not in i and not i.endswith("~")}
    patterns = sorted(p for p in patterns if ident.is_pattern_text(p))
    df = spark.createDataFrame([(i,) for i in ids], "t string")
    for older, matches in ((False, ident.matches), (True, ident.matches_legacy)):
        for r in df.select("t", F.array(*(matches(F.col("t"), p) for p in patterns)).alias("m")).collect():
            assert r.m == [matched_by_hand(r.t, p, older) for p in patterns], (r.t, older, [p for p, m in zip(patterns, r.m, strict=True) if m != matched_by_hand(r.t, p, older)])


@pytest.mark.parametrize("text, wrong", [("", True), ("gts.a.b.c.d.v1~*[a=1]", True), ("gts.a.b.c.d.v1~[a=1]", True), ("gts.a.*[a=1", True), ("gts.*.b.*", True), ("gts.a.*[a=1,b,=2]", False)])
def test_parse(text, wrong):
    if wrong:
        with pytest.raises(query.QueryError):
            query.parse(text)
    else:
        assert query.parse(text).filters == {"a": "1"}


def entities(spark, *docs):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return registry.entities_of(spark.createDataFrame(rows, "seq long, content string"))


def schema(name, **k):
    return {"$id": f"gts://{name}", "$schema": D7, "type": "object", **k}


def test_query_attributes(spark):
    t = "gts.acme.order.ns.invoice.v1~acme.x._.{}.v1"
    e = entities(spark, {"id": t.format("a"), "status": "active", "n": 42.0}, {"id": t.format("b"), "status": "", "n": None}, None, "no json", "[1]", "")
    count = lambda q: query.run(e, q).count()
    assert [count(f"gts.acme.order.ns.*[{f}]") for f in ("status=active", "status=*", "n=42", "n=", "m=*")] == [1, 1, 1, 1, 0]
    assert query.run(e, "gts.acme.*", 1).count() == 1 and count(t.format("a")) == 1


def test_attribute_paths(spark):
    doc = json.dumps({"foo": {"bar": 42}, "items": [{"a": 1}, {"a": 2}]})
    value = lambda p: one(spark, jsons.attribute_result(jsons.variant(F.col("t")), p)["value"], t=doc)
    assert [value(p) for p in ("foo.bar", "foo/bar", "items[0].a", "items.1.a", "no", "items[5]")] == ["42", "42", "1", "2", None, None]
    assert json.loads(value("")) == json.loads(doc)


def test_relations(spark):
    base = "gts.x.r.b.base.v1~"
    e = entities(spark, schema(base), schema(f"{base}x.r.b.kid.v1~", allOf=[{"$ref": f"gts://{base}"}]), {"id": f"{base}x.r._.one.v1", "peer": f"{base}x.r._.none.v1", "any": "gts.x.r.*"}, {"id": "gts.x.r.b.gone.v1~x.r._.two.v1"})
    assert {(r.reason, r.referenced_id) for r in relations.broken(e).collect()} == {("MissingInstance", f"{base}x.r._.none.v1"), ("MissingTypeBinding", "gts.x.r.b.gone.v1~")}
    assert relations.counts(e).head() == (4, 2, 2)
    assert {(r.id, r.missing) for r in relations.graph(e, f"{base}x.r._.one.v1").collect()} == {(f"{base}x.r._.none.v1", True), ("gts.x.r.*", True)}
    assert relations.is_consistent(e.limit(0))


def test_graph_by_schema_ids(spark):
    top, base = "gts.x.r.b.top.v1~", "gts.x.r.b.base.v1~"
    one_id = f"{base}x.r._.one.v1"
    e = entities(spark, schema(top), schema(base, allOf=[{"$ref": f"gts://{top}"}]), {"id": one_id})
    assert {(r.source_id, r.id, r.missing) for r in relations.graph(e, one_id).collect()} == {(base, top, False)}
    assert {(r.source_id, r.id) for r in relations.graph(e, one_id, bound=True).collect()} >= {(one_id, base), (base, top)}


def test_long_chains(spark):
    many = 67
    keys = [f"gts.x.r.b.base.v1~x.r._.n{k}.v1" for k in range(many)]
    e = entities(spark, *({"id": k, "peer": p} for k, p in zip(keys, keys[1:] + [None], strict=True)))
    found = relations.reachable(e, spark.createDataFrame([(keys[0],)], "id string")).collect()
    assert {r.id: r.distance for r in found if r.id in keys} == {k: n for n, k in enumerate(keys)}


def test_long_reference_chain_of_types(spark):
    types = [f"gts.x.r.b.t{k}.v1~" for k in range(36)]
    e = entities(spark, *(schema(t, **{"$ref": f"gts://{u}"}) for t, u in zip(types, types[1:], strict=False)), schema(types[-1], properties={"deep": {"type": "string"}}))
    rows = schemas.resolved(schemas.positions(e))
    assert {r.type_id for r in rows.filter("path = '$.deep'").collect()} == set(types)


def test_validation(spark):
    t = "gts.x.v.b.t.v1~"
    body = schema(t, required=["id", "items"], properties={"id": {"type": "string"}, "code": {"pattern": "(a+)+$"}, "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["q"], "properties": {"q": {"type": "integer"}}}}, "at": {"format": "date-time"}})
    good = {"id": f"{t}x.v._.g.v1", "items": [{"q": 1.0}], "at": "2024-02-29T10:00:00Z"}
    bad = {"id": f"{t}x.v._.b.v1", "items": [{"q": 1}, {"q": "x"}], "at": "2023-02-29T10:00:00Z", "code": "a" * 40_000 + "!"}
    found = {r.entity_key: r for r in evaluate.validate(entities(spark, body, good, bad, {"id": "k", "type": "gts.x.v.b.none.v1~"}, {"id": "z"})).collect()}
    assert found[good["id"]].reason is None and found["k"].reason == "SchemaNotFound" and found["z"].reason == "NoSchemaId"
    assert {e.split(":")[0] for e in found[bad["id"]].errors} == {"$.items", "$.at", "$.code"}


def test_combined_schemas(spark):
    held = lambda s, doc, types=None: one(spark, F.size(evaluate.errors(F.col("t"), s, types)) == 0, t=json.dumps(doc))
    tree = {"type": "object", "properties": {"kid": {"$ref": "#"}}, "additionalProperties": False}
    assert held(tree, {"kid": {"kid": {}}}) and not held(tree, {"kid": {"x": 1}})
    assert held({"oneOf": [{"type": "string"}, {"minimum": 5}]}, 7) and not held({"oneOf": [{"type": "number"}, {"minimum": 5}]}, 7)
    assert held({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"c": 1}) and not held({"not": {"type": "null"}}, None)
    assert held({"additionalProperties": {"type": "integer"}}, {"a": 1}) and not held({"patternProperties": {"^a": {"type": "integer"}}}, {"ab": "x"})
    with pytest.raises(evaluate.SchemaError):
        evaluate.errors(F.col("t"), {"$ref": "https://example.com/x.json"})
    with pytest.raises(evaluate.SchemaError):
        evaluate.errors(F.col("t"), {"pattern": "(?=a)b"})


def test_regex_limits():
    """Each limit of the profile: what lies at it is admitted, what lies one beyond isn't."""
    good = lambda p: evaluate.profile_error(p) is None
    most, deep, product = patterns.MAX_LENGTH, patterns.MAX_NESTING, patterns.MAX_REPEAT
    assert good("k" * most) and not good("k" * (most + 1))
    assert good("(" * deep + "k" + ")" * deep) and not good("(" * (deep + 1) + "k" + ")" * (deep + 1))
    for inner in (1, 2, 5, 25, 100, product):
        outer = product // inner
        if outer * (inner + 10) <= most:  # else it is too long when written out
            assert good(f"(?:k{{{inner}}}){{{outer}}}")
        assert not good(f"(?:k{{{inner}}}){{{outer + 1}}}")
    # written out, a group of n characters repeated k times must fit
    for n in (10, 50, 400):
        k = (most - 8) // (n + 4)
        assert good(f"(?:{'k' * n}){{{k}}}") and not good(f"(?:{'k' * n}){{{most // n + 1}}}")
    for a in "ajz059":
        for b in "ajz059":
            assert good(f"[{a}-{b}]") == (a <= b)


@pytest.mark.parametrize(
    "pattern", ["[a&&b]", "[[a]b]", r"\A", r"\z", r"\Qa\E", r"\C", "[[:alpha:]]", "(" * 40 + "a" + ")" * 40, "(?=a)b", "(?P<n>a)", r"(a)\1", "a++", "^*", "a|*", "]", "a{2", "[]", "[z-a]", r"[\d-z]", "(a", "a)", "(?:a{40}){40}", "a{3,2}", "a{4097}", "\\"]
)
def test_regex_refused(pattern):
    assert evaluate.profile_error(pattern)


def test_schema_pairs(spark):
    a, b = "gts.x.p.b.w.v1.0~", "gts.x.p.b.w.v1.1~"
    s = entities(spark, schema(a), schema(b), schema("gts.x.p.b.other.v1.0~"), schema("gts.x.p.b.fin.v1~", **{"x-gts-final": True}), schema("gts.x.p.b.fin.v1~x.p.b.k.v1~"), schema("gts.x.p.b.no.v1~x.p.b.k.v1~"))
    assert [tuple(r) for r in schemas.structural_report(s).collect()] == [("gts.x.p.b.w.v1~", a, b, True)]
    found = {r.type_id: r.errors for r in schemas.derivation(s).collect()}
    assert found["gts.x.p.b.fin.v1~x.p.b.k.v1~"] == ["$: the parent is final"] and found["gts.x.p.b.no.v1~x.p.b.k.v1~"] == ["$: the parent is missing"]
    assert {r.family: r.gts_id for r in schemas.latest(s).collect()}["gts.x.p.b.w.v1~"] == b


def test_cyclic_reference_is_an_error(spark):
    a, b = "gts.x.c.b.a.v1~", "gts.x.c.b.b.v1~"
    rows = schemas.resolved(schemas.positions(entities(spark, schema(a, **{"$ref": f"gts://{b}"}), schema(b, **{"$ref": f"gts://{a}"}))))
    assert rows.filter("error like 'cyclic%'").count() >= 2


def test_cast(spark):
    a, b = "gts.x.k.b.i.v1.0~", "gts.x.k.b.i.v1.1~"
    types = {a: schema(a), b: schema(b, additionalProperties=False, required=["id", "b"], properties={"id": {}, "b": {"type": "string", "default": "d"}, "n": {"type": "object", "properties": {"x": {"default": 1}}}})}
    e = entities(spark, {"id": f"{a}x.k._.o.v1", "old": 1, "n": {}}, {"id": "gts.x.k.b.other.v1.0~x.k._.o.v1"})
    found = {r.entity_key: r for r in evaluate.cast_and_validate(e, b, types).collect()}
    assert json.loads(found[f"{a}x.k._.o.v1"].content) == {"id": f"{a}x.k._.o.v1", "b": "d", "n": {"x": 1}} and not found[f"{a}x.k._.o.v1"].errors
    assert found["gts.x.k.b.other.v1.0~x.k._.o.v1"].errors == ["NotMinorVariantPair"]


def test_cast_objects_in_arrays(spark):
    const = "gts.x.k.b.i.v1.1~"
    item = {"type": "object", "additionalProperties": False, "properties": {"x": {"default": 1}, "t": {"const": const}, "deep": {"type": "array", "items": {"type": "object", "properties": {"y": {"default": 2}}}}}}
    target = schema(const, properties={"list": {"type": "array", "items": item}})
    doc = {"list": [{"old": 0, "t": "gts.x.k.b.i.v1.0~", "deep": [{}, 5]}, "text", None, {"x": 7}], "same": []}
    got = json.loads(one(spark, evaluate.cast(F.col("t"), target), t=json.dumps(doc)))
    assert got["same"] == [] and got["list"][1:3] == ["text", None]
    assert got["list"][0] == {"x": 1, "t": const, "deep": [{"y": 2}, 5]} and got["list"][3]["x"] == 7


def test_registry_sessions(spark):
    t = "gts.x.s.b.t.v1~x.s._.{}.v1"
    r = registry.Registry(entities(spark, {"id": t.format("a"), "title": "a"}))
    r = r.stage(entities(spark, {"id": t.format("a"), "title": "b"}, {"id": t.format("b")}), "one").stage(entities(spark, {"title": "a", "id": t.format("a")}, {"id": t.format("c")}), "two")
    assert r.visible("one").count() == 2 and r.visible().count() == 1
    assert r.commit("one").count() == 1 and r.commit("two").count() == 2
    assert r.get(t.format("a")).count() == 1 and r.get("none").count() == 0


def test_texts_that_are_no_json(spark):
    df = spark.createDataFrame([(1, "{a"), (2, "{b"), (3, '{"x": 1, "y": 2.0}'), (4, '{"y": 2, "x": 1}')], "seq long, t string")
    keys = [r.k for r in df.orderBy("seq").select(jsons.content_key(F.col("t")).alias("k")).collect()]
    assert keys[0] != keys[1] and keys[2] == keys[3]


def test_single_tokens(spark):
    t = "gts.x.s.b.t.v1~x.s._.{}.v1"
    stored = entities(spark, {"id": t.format("a"), "n": 1})
    staged = spark.createDataFrame([("t1", "s", 0, t.format("a"), t.format("a"), False, None, '{"n": 2}'), ("t2", "s", 1, t.format("b"), t.format("b"), False, None, "{}")], "token string, session string, seq long, entity_key string, gts_id string, is_schema boolean, schema_id string, content string")
    outcomes, now, left = registry.commit_tokens(stored, staged, spark.createDataFrame([("t1",), ("t2",), ("t9",)], "token string"))
    assert {tuple(x) for x in outcomes.collect()} == {("t1", "Conflict"), ("t2", "Added"), ("t9", "Conflict")}
    assert now.count() == 2 and left.count() == 0


def test_attribute_access(spark):
    key = "gts.x.s.b.t.v1~x.s._.a.v1"
    e = entities(spark, {"id": key, "n": {"m": [1]}})
    row = lambda selector: query.attribute_access(e, selector).head()
    assert (row(f"{key}@n.m[0]").value, row(f"{key}@n").error) == ("1", None)
    assert row(f"{key}@x").available == ["id", "n", "n.m", "n.m[0]"]
    assert row("none@x").error == "Entity not found." and "@path" in row(key).error and "before" in row("@x").error


def test_segment_text(spark):
    for text in ("gts.a.b.c.d.v1.2~x.y.z.w.v3", "gts.a.b.c.d.v1~0f8fad5b-d9cb-469f-a165-70867728950e", "gts.a.b.*"):
        assert one(spark, F.array_join(F.transform(ident.segments(F.col("t")), ident.segment_text), "~"), t=text) == text.removeprefix("gts.")


def test_batches_to_a_fix_point(spark):
    a, b, c = "gts.x.f.b.a.v1~", "gts.x.f.b.b.v1~", "gts.x.f.b.c.v1~"
    batch = entities(spark, schema(a, **{"$ref": f"gts://{b}"}), schema(b, **{"$ref": "https://example.com/x"}), schema(c))
    assert {r.entity_key for r in schemas.admitted(batch, batch.limit(0)).collect()} == {c}


def test_verdicts_with_unknown(spark):
    name = "gts.x.u.b.{}.v1.{}~".format
    s = entities(spark, schema(name("a", 0)), schema(name("a", 1)), schema(name("b", 0)), schema(name("b", 1), **{"if": {"required": ["k"]}}), schema(name("c", 0), properties={"p": {"x-gts-type-ref": "gts.x.*"}}), schema(name("c", 1), properties={"p": {"x-gts-type-ref": "gts.x.y.*"}}))
    found = {r.old: (r.backward, r.forward, r.full) for r in schemas.compatibility(s).collect()}
    assert found == {name("a", 0): ("compatible",) * 3, name("b", 0): ("unknown",) * 3, name("c", 0): ("incompatible", "compatible", "incompatible")}


def test_cast_leaves_what_is_no_identifier(spark):
    const = "gts.x.k.b.i.v1.1~"
    target = schema(const, additionalProperties=False, properties={"a": {"const": const}, "b": {"const": const}, "c": {"const": const}})
    got = json.loads(one(spark, evaluate.cast(F.col("t"), target), t=json.dumps({"a": "plain text", "b": "gts.x.k.b.i.v1.0~"})))
    assert got == {"a": "plain text", "b": const}
    assert json.loads(one(spark, evaluate.cast(F.col("t"), schema(const, additionalProperties=False)), t='{"a": 1}')) == {}


def test_files(spark, tmp_path):
    (tmp_path / "dist").mkdir()
    (tmp_path / "a.json").write_text('[{"$$id": "x", "u": "http://y"}, 5, {"b": 1,},] // end')
    (tmp_path / "b.gts").write_text('{"c": 2 /* no */}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "dist" / "c.json").write_text('{"d": 3}')
    rows = files.json_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, json.loads(r.content)) for r in rows] == [(0, {"$id": "x", "u": "http://y"}), (1, {"b": 1}), (2, {"c": 2})]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(cols).collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall()))


def test_depth_comes_from_the_instances(spark):
    name, other = "gts.x.deep.b.t.v1~", "gts.x.deep.b.o.v1~"
    tree = schema(name, properties={"id": {}, "n": {"type": "integer"}, "all": {"type": "array", "items": {"$ref": "#"}}})
    list_ = schema(other, properties={"id": {}, "n": {"type": "integer"}, "next": {"$ref": "#"}})

    def deep(depth, leaf, member):
        below = deep(depth - 1, leaf, member) if depth else None
        return {"n": leaf} if depth == 0 else {"next": below} if member == "next" else {"all": [{}, below]}

    docs = {"a": deep(6, 1, "all"), "b": deep(6, "no", "all"), "c": {"n": '}{"['}, "d": {}}
    lists = {"e": deep(12, 1, "next"), "f": deep(12, "no", "next")}
    rows = [{"id": f"{t}x.deep._.{k}.v1", **d} for t, some in ((name, docs), (other, lists)) for k, d in some.items()]
    found = {r.entity_key[-4]: r.reason for r in evaluate.validate(entities(spark, tree, list_, *rows)).collect()}
    assert found == {"a": None, "b": "Invalid", "c": "Invalid", "d": None, "e": None, "f": "Invalid"}
    assert evaluate.refers_to_itself(tree, {name: tree}, name) and not evaluate.refers_to_itself(schema(name), {}, name)
    for text, deep in (('{"a": [1, {"b": "]}\\\\"}]}', 3), ('"\\\\\\"{"', 0), ("[[[]]]", 3), ("{}", 1), ("1", 0)):
        assert one(spark, evaluate.nesting(F.col("t")), t=text) == deep, text


def test_patterns_within_items_and_members(spark):
    held = lambda s, doc: one(spark, F.size(evaluate.errors(F.col("t"), s)) == 0, t=json.dumps(doc))
    two, nested = "^[a-z]+-[a-z]+$", "^(a+)+$"
    assert held({"items": {"pattern": two}}, ["ab-c", "x-y"]) and not held({"items": {"pattern": two}}, ["ab-c", "x"])
    assert held({"additionalProperties": {"pattern": nested}}, {"k": "aaa", "n": 5}) and not held({"additionalProperties": {"pattern": nested}}, {"k": "aab"})
    named = {"patternProperties": {two: {"type": "string"}}, "additionalProperties": False}
    assert held(named, {"a-b": "x"}) and not held(named, {"a-b": 1}) and not held(named, {"ab": "x"})
    assert held({"propertyNames": {"pattern": two}}, {"a-b": 1}) and not held({"propertyNames": {"pattern": two}}, {"ab": 1})
    assert held({"items": {"format": "regex"}}, ["a+"]) and not held({"items": {"format": "regex"}}, ["a+", "("])
    assert not held({"pattern": nested}, "a" * 40_000 + "!") and not held({"items": {"pattern": nested}}, ["a" * 40_000 + "!"])


def test_edges_of_flat_and_nested(spark):
    """Flat documents, walked in the JVM, and nested ones give the same edges as a walk of every document."""
    a, b = "gts.x.r.b.t.v1~x.r._.a.v1", "gts.x.r.b.t.v1~x.r._.b.v1"
    texts = [f'{{"id":"{a}","to":"{b}","n":5,"none":null}}', f'{{"id":"{a}","to":["{b}",{{"p":"gts.x.*"}}]}}', f'{{"to":"gts://{b}","again":"{b}"}}', f'{{"to":"\\u0067ts{b[3:]}"}}', f'{{"t":"{{ {b}"}}', f'"{b}"', f"{{broken {b}", "", None, '{"v":"gts.x.r.b.t.v01"}', "{}"]
    rows = spark.createDataFrame([(f"k{i}", False, t) for i, t in enumerate(texts)], "entity_key string, is_schema boolean, content string")
    walked = rows.select("entity_key", F.explode(jsons.references(jsons.strings(F.col("content")))).alias("r")).select("entity_key", "r.id", "r.source_path")
    assert sorted(map(tuple, relations.edges(rows).select("source_id", "id", "source_path").collect())) == sorted(map(tuple, walked.collect()))
    assert {(r.source_id, r.referenced_id, r.reason) for r in relations.broken(rows.withColumn("schema_id", F.lit(None).cast("string"))).collect()} >= {("k0", a, "MissingInstance"), ("k3", b, "MissingInstance")}


def test_patterns_joined_with_ids(spark):
    """The join by paths finds what comparing every pattern with every identifier finds."""
    draw = random.Random(5)
    versions = ["v1", "v1.0", "v1.2", "v2", "v12.2"]
    segment = lambda: f"{draw.choice('av')}.p.{draw.choice(['_', 'v1'])}.t.{draw.choice(versions)}"
    ids = {"gts." + "~".join([segment() for _ in range(draw.randint(1, 2))] + draw.choice([[""], [segment()]])) for _ in range(60)} | {"gts.a.p._.t.v1~x.y._.z", "no id"}
    drawn = sorted(ids)
    cuts = {f"{x[: draw.choice([i for i, c in enumerate(x) if c in '.~']) + 1]}*" for x in drawn if x.startswith("gts.") for _ in range(2)}
    every = sorted(cuts | set(drawn[::2]) | {"gts.*", "gts.a.p._.t.v*", "gts.a.p._.t.v1.*", "*"})
    p, i = spark.createDataFrame([(x,) for x in every], "pattern string"), spark.createDataFrame([(x,) for x in drawn], "id string")
    pairs = p.crossJoin(i).filter(ident.is_valid(F.col("id")) & ident.covers(F.col("pattern"), F.col("id")))
    wanted = {tuple(r) for r in pairs.collect()}
    found = [tuple(r) for r in relations.selected(p, i).collect()]
    assert set(found) == wanted and len(found) == len(wanted) > 100
    assert {r.pattern for r in relations.unmatched(p, i).collect()} == set(every) - {x for x, _ in wanted}
