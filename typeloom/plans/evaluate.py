"""JSON Schemas compiled to Column expressions over variants.

A schema is small and becomes part of the plan; instances by the million are then evaluated in the JVM. Each check is
a pair (failed, message), so verdicts and messages come from the same expression. A schema that refers to itself is
written out some levels deep; below, a reference is looked up among the values that break what it leads to. These are
found by one fold over all values of the document, the deepest first (``_Compiler.broken``), so documents may nest as
deep as they like, and the plan grows with the schema's length only.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import ident, jsons, normal, patterns
from ..operators import registry, schemas

#: Levels of a schema that refers to itself that are written out, with messages for each place.
UNROLL = 4
#: Places of a schema above which fewer levels are written out.
MOST_CHECKS = 100
# JSON kinds by type name; formats as regular expressions.
KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    "email": r"^[^@\s]+@[^@\s]+\z",
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z",
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([zZ]|[+-]([01][0-9]|2[0-3]):[0-9]{2})\z",
    "date-time": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[tT]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([zZ]|[+-]((0[0-9]|1[0-3]):[0-5][0-9]|14:00))\z",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*\z",
    "hostname": r"^(?=.{1,253}\z)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\z",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(?!\z)|\z)){4}\z",
    "ipv6": r"^(?=.*:)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:\z)(?=(?:[^:]*:){2,7}[^:]*\z)(?:(?=.*::)|(?=(?:[^:]*:){7}[^:]*\z))[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}\z",
}


class SchemaError(ValueError):
    """A schema that can't be compiled."""


def format_holds(text: Column, name: str) -> Column:
    """Whether a text has a format; dates must exist. Unknown formats hold."""
    if name == "regex":
        return is_regex(text)
    if name not in FORMATS:
        return F.lit(True)
    if name == "ipv6":  # an address of version 4 at the end stands for two groups
        text = F.regexp_replace(text, r":(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z", ":0:0")
    held = text.rlike(FORMATS[name])
    return held & F.substring(text, 1, 10).try_cast("date").isNotNull() & ~text.startswith("0000") if name.startswith("date") else held


@F.pandas_udf(BooleanType())
def is_regex(texts: pd.Series) -> pd.Series:
    """Whether a text is an admitted regular expression; null for null."""
    return texts.map(lambda t: None if t is None else patterns.refusal(t) is None)


profile_error = patterns.refusal


def linear_match(text: Column, pattern: str) -> Column:
    """Search by an automaton in linear time, in Arrow batches: for patterns on which the JVM's engine may backtrack."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pc.match_substring_regex(pa.array(texts, pa.string()), pattern).to_pandas()

    return found(text)


def _backtracks(pattern: str) -> bool:
    """Repetition of what repeats or branches, or several unbounded repetitions: the JVM may need more than linear time."""
    unbounded = re.findall(r"(?<!\\)[*+]|\{\d+,\}", pattern)
    return len(unbounded) > 1 or bool(re.search(r"\)(?:[*+]|\{)", pattern)) or any(int(x) > 50 for x in re.findall(r"\{(\d+)", pattern))


def _texts(content: str | None) -> set[str]:
    """All strings of a JSON text, names of members included; none if it isn't JSON."""
    out, open_ = set(), []
    try:
        open_.append(json.loads(content))
    except (ValueError, TypeError, RecursionError):
        pass
    while open_:
        node = open_.pop()
        if isinstance(node, str):
            out.add(node.encode("utf-8", "replace").decode())
        elif isinstance(node, dict):
            open_ += [*node, *node.values()]
        elif isinstance(node, list):
            open_ += node
    return out


def matching(content: Column, tests: list[str | None]) -> Column:
    """For each pattern the strings of a JSON text that it finds, by an automaton in linear time, in Arrow batches; for
    None those that are admitted regular expressions. Checks within items and members then look a string up."""

    @F.pandas_udf("array<array<string>>")
    def found(contents: pd.Series) -> pd.Series:
        rows = [_texts(c) for c in contents]
        texts = pa.array(sorted(set().union(*rows)), pa.string())
        held = [
            {t for t in texts.to_pylist() if patterns.refusal(t) is None} if p is None else set(texts.filter(pc.match_substring_regex(texts, p)).to_pylist())
            for p in tests
        ]
        return pd.Series([[sorted(row & h) for h in held] for row in rows])

    return found(content)


def nesting(content: Column) -> Column:
    """How deep objects and arrays of a JSON text nest."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)\\.", ""), r'"[^"]*"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "")

    def step(held: Column, c: Column) -> Column:
        at = held["at"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(held["most"], at).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda held: held["most"])


def refers_to_itself(schema, types: dict[str, dict], name: str = "", root: dict | None = None) -> bool:
    """Whether a chain of references of a schema (within a document ``root``) comes back to one of them."""
    compiler, done = _Compiler(types), set()

    def refs(node) -> set[str]:
        out, open_ = set(), [node]
        while open_:
            x = open_.pop()
            if isinstance(x, dict):
                # a dynamic reference can lead back: it does as far as this asks
                out |= {x[k] for k in ("$ref", "$dynamicRef", "$recursiveRef") if isinstance(x.get(k), str)}
            open_ += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
        return out

    def returns(node, root: dict, home: str, via: frozenset) -> bool:
        for ref in refs(node):
            if (home, ref) in via:
                return True
            if (home, ref) in done:
                continue
            try:
                target = compiler.target(ref, root, home)
            except SchemaError:
                continue
            if returns(*target, via | {(home, ref)}):
                return True
            done.add((home, ref))
        return False

    return returns(schema, schema if root is None else root, name, frozenset())


class _TooLarge(Exception):
    """More checks than a plan should hold while fewer levels would do."""


# Dialects by a part of their name; keywords by the dialects that know them, where not all do.
DRAFTS = (("draft-07", 7), ("2019-09", 2019), ("2020-12", 2020))
KNOWN_BY = {
    "dependencies": (7,), "additionalItems": (7, 2019), "$recursiveRef": (2019,), "prefixItems": (2020,), "$dynamicRef": (2020,),
    **dict.fromkeys(("dependentRequired", "dependentSchemas", "minContains", "maxContains", "unevaluatedItems", "unevaluatedProperties"), (2019, 2020)),
}


def identified(root) -> dict[str, dict]:
    """The resources within a document, by their ids."""
    out, open_ = {}, [root]
    while open_:
        node = open_.pop()
        if jsons.is_resource(node) and node is not root:
            out[node["$id"].removesuffix("#")] = node
        open_ += node.values() if isinstance(node, dict) else node if isinstance(node, list) else []
    return out


def _as_value(text: Column) -> Column:
    """A text as a JSON value."""
    listed = F.to_json(F.array(text))
    return F.parse_json(listed.substr(F.lit(2), F.length(listed) - 2))


class _Compiler:
    def __init__(self, types: dict[str, dict], levels: int = UNROLL, matched: Column | None = None):
        """``levels``: how often a reference is written out within itself; 0: not at all, where it leads to a smaller value."""
        self.types, self.levels = types, levels
        self.made, self.most = 0, None
        #: What references that aren't written out lead to: (number, schema, root, home, the reference, scope), by all that its meaning depends on.
        self.units: dict[tuple, tuple] = {}
        #: The broken ones among smaller values, as texts "number:value"; None where they aren't known.
        self.lost: Column | None = None
        #: The value that a unit is applied to, and the references that are open with the values that they were read at.
        self.at: Column | None = None
        self.open: list[tuple[tuple, Column]] = []
        self.cyclic: dict[tuple, bool] = {}
        #: The resources that the place at hand was reached through: (schema, name, draft), outermost first.
        self.scope: list[tuple[dict, str, int]] = []
        #: Patterns for an automaton (None: format regex), and the strings that each of them finds.
        self.tests: list[str | None] = []
        self.matched = F.lit(None).cast("array<array<string>>") if matched is None else matched

    def draft(self, root) -> int:
        """Year of a document's dialect (7 for draft-07); that of the document it is in, or 0, which knows all keywords."""
        named = root.get("$schema") if isinstance(root, dict) else None
        return next((n for text, n in DRAFTS if isinstance(named, str) and text in named), self.scope[-1][2] if self.scope else 0)

    def target(self, ref: str, root: dict, home: str) -> tuple[object, dict, str]:
        """What a reference names: schema, the document or resource it is in, and that one's name."""
        where, _, fragment = ref.partition("#")
        if where:
            name = where.removeprefix("gts://")
            inner = identified(self.types.get(home, root)).get(where) or identified(root).get(where)
            if inner is not None:
                root = inner
            elif not where.startswith("gts://"):
                raise SchemaError(f"unsupported $ref: {ref}")
            elif name not in self.types:
                raise SchemaError(f"missing type: {name}")
            else:
                root, home = self.types[name], name
        found = jsons.local_target(root, fragment)
        if found is None:
            raise SchemaError(f"$ref leads nowhere: {ref}")
        return *found, home

    def dynamic(self, ref: str, root: dict, home: str) -> tuple[object, dict, str]:
        """What a dynamic reference names: if it leads to a dynamic anchor, the outermost one of this name on the way here."""
        found = self.target(ref, root, home)
        name = unquote(ref.partition("#")[2])
        at = found[1]
        if name not in jsons.anchors(at) or not jsons.anchors(at)[name][1]:
            return found
        return next(((jsons.anchors(r)[name][0], r, h) for r, h, _ in self.scope if jsons.anchors(r).get(name, (None, False))[1]), found)

    def recursive(self, root: dict, home: str) -> tuple[object, dict, str]:
        """What ``$recursiveRef`` names: its resource, or the outermost one on the way here that allows it too."""
        on = lambda r: isinstance(r, dict) and r.get("$recursiveAnchor") is True
        found = (root, root, home)
        for r, h, _ in reversed(self.scope) if on(root) else ():
            if not on(r):
                break
            found = (r, r, h)
        return found

    def checks(self, s, v: Column, path: str, root: dict, home: str, via: tuple = ()) -> list[tuple[Column, str]]:
        """(failed, message) of a value that is there."""
        self.made += 1
        if self.most is not None and self.made > self.most and self.levels:
            raise _TooLarge
        if isinstance(s, bool):
            return [] if s else [(F.lit(True), f"{path}: nothing is admitted")]
        if not isinstance(s, dict):
            raise SchemaError(f"{path}: a schema must be an object or boolean")
        root = s if jsons.is_resource(s) else root
        if not self.scope or self.scope[-1][0] is not root:
            self.scope.append((root, home, self.draft(root)))
            try:
                return self.own_checks(s, v, path, root, home, via)
            finally:
                self.scope.pop()
        return self.own_checks(s, v, path, root, home, via)

    def known(self, s: dict) -> dict:
        """The keywords that count: draft-07 reads nothing beside a reference, and each dialect knows its own."""
        year = self.scope[-1][2]
        if year == 7 and "$ref" in s:
            return {"$ref": s["$ref"]}
        return {k: x for k, x in s.items() if not year or year in KNOWN_BY.get(k, (year,))}

    def led(self, s: dict, path: str, root: dict, home: str, via: tuple) -> list[tuple[object, dict, str, tuple]]:
        """What the references of a schema lead to, and the way there."""
        found = []
        for key, find in (("$ref", self.target), ("$dynamicRef", self.dynamic), ("$recursiveRef", lambda _, r, h: self.recursive(r, h))):
            if key in s:
                if not isinstance(s[key], str):
                    raise SchemaError(f"{path}: {key} must be a text")
                node, r2, h2 = find(s[key], root, home)
                found.append((node, r2, h2, (*via, (home, s[key]) if key == "$ref" else (h2, id(node)))))
        return found

    def is_cut(self, node, v: Column, root: dict, home: str, way: tuple) -> bool:
        """Whether a reference is looked up, and not written out at this value."""
        if self.levels:
            return way.count(way[-1]) > self.levels
        if v is self.at:
            return False
        key = (way[-1], id(node))
        if key not in self.cyclic:
            self.cyclic[key] = refers_to_itself(node, self.types, home, root)
        return self.cyclic[key]

    def looked_up(self, node, v: Column, path: str, root: dict, home: str, ref: tuple) -> tuple[Column, str]:
        if self.lost is None:
            return F.lit(True), f"{path}: nested too deeply"
        # dynamic references depend on the resources passed, by first pass, and on the last run of those that allow it
        run = len(self.scope)
        while run and isinstance(self.scope[run - 1][0], dict) and self.scope[run - 1][0].get("$recursiveAnchor") is True:
            run -= 1
        passed = tuple(dict.fromkeys((id(r), h) for r, h, _ in self.scope))
        key = (ref, id(node), passed, id(self.scope[run][0]) if run < len(self.scope) else None, self.scope[-1][1:])
        number = self.units.setdefault(key, (len(self.units), node, root, home, ref, list(self.scope)))[0]
        return F.array_contains(self.lost, F.concat(F.lit(f"{number}:"), F.to_json(v))), f"{path}: does not hold"

    def broken_units(self, v: Column, lost: Column) -> Column:
        """array<string>: ``lost`` and the units that a value breaks; all smaller values that break any are in ``lost``."""
        was = self.levels, self.at, self.lost, self.scope, self.open
        tests, done = [], 0
        try:
            self.levels, self.at, self.lost = 0, v, lost
            while done < len(self.units):  # writing a unit out may bring others
                number, node, root, home, ref, scope = list(self.units.values())[done]
                self.scope, self.open, done = list(scope), [(ref, v)], done + 1
                failed = self.failed(self.checks(node, v, "", root, home, (ref,)))
                tests.append(F.when(failed, F.lit(f"{number}:")))
        finally:
            self.levels, self.at, self.lost, self.scope, self.open = was
        new = F.filter(F.array(*tests), lambda t: t.isNotNull())
        return jsons.let(new, lambda n: F.when(F.size(n) > 0, F.concat(lost, F.transform(n, lambda t: F.concat(t, F.to_json(v))))).otherwise(lost))

    def broken(self, v: Column, content: Column, levels: int) -> Column:
        """array<string> of the units that any value of a document breaks, the deepest first; none if it nests too little
        for a reference to be looked up."""
        none, nothing = F.array().cast("array<string>"), F.array().cast("array<variant>")

        def within(x: Column) -> Column:
            members = F.try_variant_get(x, "$", "map<string,variant>")
            # names are values too: propertyNames may refer to what is looked up
            return F.coalesce(F.concat(F.map_values(members), F.transform(F.map_keys(members), _as_value)), F.try_variant_get(x, "$", "array<variant>"), nothing)

        def wider(held: Column, _: Column) -> Column:
            return jsons.let(F.flatten(F.transform(held["last"], within)), lambda found: F.struct(found.alias("last"), F.concat(held["all"], found).alias("all")))

        def fold(deep: Column) -> Column:
            start = F.struct(F.array(v).alias("last"), F.array(v).alias("all"))
            values = F.aggregate(F.sequence(F.lit(1), deep), start, wider, lambda held: held["all"])
            return F.aggregate(F.reverse(values), none, lambda lost, x: self.broken_units(x, lost))

        return jsons.let(nesting(content), lambda deep: F.when(v.isNotNull() & (deep >= max(1, levels)), fold(deep)).otherwise(none))

    def own_checks(self, s: dict, v: Column, path: str, root: dict, home: str, via: tuple) -> list[tuple[Column, str]]:
        s = self.known(s)
        out: list[tuple[Column, str]] = []
        kind = jsons.kind(v)
        is_ = lambda name: kind.isin(*KINDS[name])
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        fails = lambda s2, v2=v, p=path: self.failed(self.checks(s2, v2, p, root, home, via))

        def add(test: Column, message: str):
            out.append((F.coalesce(test, F.lit(False)), f"{path}: {message}"))

        for node, r2, h2, way in self.led(s, path, root, home, via):
            if any(key == way[-1] and at is v for key, at in self.open):
                raise SchemaError(f"{path}: a reference leads back to itself at the same value")
            if self.is_cut(node, v, r2, h2, way):
                out.append(self.looked_up(node, v, path, r2, h2, way[-1]))
                continue
            self.open.append((way[-1], v))
            try:
                out += self.checks(node, v, path, r2, h2, way)
            finally:
                self.open.pop()
        if "type" in s:
            names = [s["type"]] if isinstance(s["type"], str) else s["type"]
            held = F.lit(False)
            for name in names:
                held |= is_("number") & (number == F.floor(number)) if name == "integer" else is_(name) if name in KINDS else F.lit(False)
            add(~held, f"must be {' or '.join(names)}")
        same = lambda x: F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(x))))
        if "const" in s:
            add(~same(s["const"]), "must be the constant")
        if "enum" in s:
            held = F.lit(False)
            for x in s["enum"]:
                held |= same(x)
            add(~held, "must be a listed value")
        for key, test in (("minimum", lambda b: number < b), ("maximum", lambda b: number > b), ("exclusiveMinimum", lambda b: number <= b), ("exclusiveMaximum", lambda b: number >= b), ("multipleOf", lambda b: F.abs(number / b - F.round(number / b)) > 1e-9)):
            if key in s:
                add(is_("number") & test(float(s[key])), key)
        if "minLength" in s:
            add(is_("string") & (F.length(text) < int(s["minLength"])), "minLength")
        if "maxLength" in s:
            add(is_("string") & (F.length(text) > int(s["maxLength"])), "maxLength")
        if "pattern" in s:
            add(is_("string") & ~self.search(text, s["pattern"]), "pattern")
        if "format" in s:
            held = self.found(text, None) if s["format"] == "regex" else format_holds(text, s["format"])
            add(is_("string") & ~held, f"format {s['format']}")
        if {"required", "properties", "additionalProperties", "patternProperties", "propertyNames", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "dependencies", "unevaluatedProperties"} & s.keys():
            out += self.object_checks(s, v, path, root, home, via, is_("object"))
        if {"items", "prefixItems", "minItems", "maxItems", "uniqueItems", "contains", "unevaluatedItems"} & s.keys():
            items = F.try_variant_get(v, "$", "array<variant>")
            if "minItems" in s:
                add(is_("array") & (F.size(items) < int(s["minItems"])), "minItems")
            if "maxItems" in s:
                add(is_("array") & (F.size(items) > int(s["maxItems"])), "maxItems")
            if s.get("uniqueItems"):
                texts = F.transform(items, lambda x: F.to_json(x))
                add(is_("array") & (F.size(F.array_distinct(texts)) < F.size(texts)), "uniqueItems")
            first = s.get("prefixItems") or (s["items"] if isinstance(s.get("items"), list) else [])
            for i, sub in enumerate(first):
                add(is_("array") & (F.size(items) > i) & fails(sub, F.get(items, F.lit(i)), f"{path}[{i}]"), f"item {i} does not hold")
            rest = s.get("additionalItems") if isinstance(s.get("items"), list) else s.get("items")
            if rest is not None and rest is not True:
                tail = F.slice(items, len(first) + 1, F.greatest(F.size(items), F.lit(0))) if first else items
                add(is_("array") & F.exists(tail, lambda x: fails(rest, x, f"{path}[]")), "an item does not hold")
            if "contains" in s:
                held = F.size(F.filter(items, lambda x: ~fails(s["contains"], x, f"{path}[]")))
                add(is_("array") & (held < int(s.get("minContains", 1))), "contains")
                if "maxContains" in s:
                    add(is_("array") & (held > int(s["maxContains"])), "maxContains")
            if s.get("unevaluatedItems", True) is not True:
                # an item that no keyword has looked at
                left = F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~self.item_seen(s, v, e["i"], e["x"], path, root, home, via, own=True))
                add(is_("array") & F.exists(left, lambda e: fails(s["unevaluatedItems"], e["x"], f"{path}[]")), "unevaluatedItems")
        for sub in s.get("allOf") or []:
            out += self.checks(sub, v, path, root, home, via)
        if "anyOf" in s:
            add(self.count(s["anyOf"], fails) == 0, "anyOf")
        if "oneOf" in s:
            add(self.count(s["oneOf"], fails) != 1, "oneOf")
        if "not" in s:
            add(~fails(s["not"]), "not")
        if "if" in s:
            held = ~fails(s["if"])
            if "then" in s:
                add(held & fails(s["then"]), "then")
            if "else" in s:
                add(~held & fails(s["else"]), "else")
        return out

    def branches(self, s: dict, v: Column, path: str, root: dict, home: str, via: tuple, here: tuple):
        """The schemas that speak of the same value as ``s``, with when they do: (condition or None, schema, root, home,
        way). ``here``: the references that were followed at this value."""
        fails = lambda sub: self.failed(self.checks(sub, v, path, root, home, via))
        for node, r2, h2, way in self.led(s, path, root, home, via):
            if way[-1] not in here:
                yield None, node, r2, h2, way
        for sub in s.get("allOf") or []:
            yield None, sub, root, home, via
        for key in ("anyOf", "oneOf"):
            for sub in s.get(key) or []:
                yield ~fails(sub), sub, root, home, via
        if "if" in s:
            holds = ~fails(s["if"])
            yield holds, s["if"], root, home, via
            if "then" in s:
                yield holds, s["then"], root, home, via
            if "else" in s:
                yield ~holds, s["else"], root, home, via
        for key in ("dependentSchemas", "dependencies"):
            for name, sub in (s.get(key) or {}).items():
                if not isinstance(sub, list):
                    yield jsons.member(v, name).isNotNull(), sub, root, home, via

    def seen(self, s, v: Column, path: str, root: dict, home: str, via: tuple, direct, own: bool, here: tuple = ()) -> Column:
        """Whether ``direct`` says that a keyword of the schema, or of one that holds for the same value, has looked at a member or item."""
        if not isinstance(s, dict):
            return F.lit(False)
        root = s if jsons.is_resource(s) else root
        self.scope.append((root, home, self.draft(root)))
        try:
            s = self.known(s)
            out = direct({k: x for k, x in s.items() if not own or k not in ("unevaluatedItems", "unevaluatedProperties")}, root, home)
            for condition, sub, r2, h2, way in self.branches(s, v, path, root, home, via, here):
                inner = self.seen(sub, v, path, r2, h2, way, direct, False, (*here, *way[len(via) :]))
                out |= inner if condition is None else condition & inner
            return out
        finally:
            self.scope.pop()

    def member_seen(self, s, v: Column, key: Column, path: str, root: dict, home: str, via: tuple, own: bool = False) -> Column:
        def direct(s: dict, root: dict, home: str) -> Column:
            if "additionalProperties" in s or "unevaluatedProperties" in s:
                return F.lit(True)
            out = key.isin(*s["properties"]) if s.get("properties") else F.lit(False)
            for pattern in s.get("patternProperties") or {}:
                out |= self.search(key, pattern)
            return out

        return self.seen(s, v, path, root, home, via, direct, own)

    def item_seen(self, s, v: Column, i: Column, item: Column, path: str, root: dict, home: str, via: tuple, own: bool = False) -> Column:
        def direct(s: dict, root: dict, home: str) -> Column:
            listed = s["items"] if isinstance(s.get("items"), list) else s.get("prefixItems") or []
            rest = "additionalItems" in s if isinstance(s.get("items"), list) else "items" in s
            if rest or "unevaluatedItems" in s:
                return F.lit(True)
            out = i < len(listed)
            if "contains" in s and self.scope[-1][2] in (0, 2020):
                out |= ~self.failed(self.checks(s["contains"], item, f"{path}[]", root, home, via))
            return out

        return self.seen(s, v, path, root, home, via, direct, own)

    def search(self, text: Column, pattern: str) -> Column:
        if error := profile_error(pattern):
            raise SchemaError(f"pattern {pattern!r}: {error}")
        plain = None if _backtracks(pattern) else patterns.for_jvm(pattern)
        return text.rlike(plain) if plain is not None else self.found(text, pattern)

    def found(self, text: Column, test: str | None) -> Column:
        if test not in self.tests:
            self.tests.append(test)
        return F.array_contains(F.get(self.matched, F.lit(self.tests.index(test))), text)

    def object_checks(self, s, v, path, root, home, via, is_object) -> list[tuple[Column, str]]:
        out = []
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        known, named = s.get("properties") or {}, s.get("patternProperties") or {}
        for name in s.get("required") or []:
            out.append((is_object & jsons.member(v, name).isNull(), f"{path}.{name}: required"))
        for name, sub in known.items():
            at = jsons.member(v, name)
            out += [(at.isNotNull() & test, message) for test, message in self.checks(sub, at, f"{path}.{name}", root, home, via)]
        members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        def breaks(pattern: str, sub):
            return lambda e: self.search(e["key"], pattern) & self.failed(self.checks(sub, e["value"], path, root, home, via))

        for pattern, sub in named.items():
            out.append((is_object & F.exists(members, breaks(pattern, sub)), f"{path}: patternProperties {pattern}"))

        def extra(key: Column) -> Column:
            free = ~key.isin(*known) if known else F.lit(True)
            for pattern in named:
                free &= ~self.search(key, pattern)
            return free

        rest = s.get("additionalProperties", True)
        if rest is False:
            out.append((is_object & F.exists(keys, extra), f"{path}: additional properties"))
        elif rest is not True:
            out.append((is_object & F.exists(members, lambda e: extra(e["key"]) & self.failed(self.checks(rest, e["value"], path, root, home, via))), f"{path}: an additional property does not hold"))
        for key, test in (("minProperties", lambda n: F.size(keys) < n), ("maxProperties", lambda n: F.size(keys) > n)):
            if key in s:
                out.append((is_object & test(int(s[key])), f"{path}: {key}"))
        for key in ("dependentRequired", "dependentSchemas", "dependencies"):
            for name, needs in (s.get(key) or {}).items():
                there = is_object & jsons.member(v, name).isNotNull()
                if isinstance(needs, list):
                    out += [(there & jsons.member(v, need).isNull(), f"{path}.{need}: required by {name}") for need in needs]
                else:
                    out += [(there & test, message) for test, message in self.checks(needs, v, path, root, home, via)]
        rest = s.get("unevaluatedProperties", True)
        if rest is not True:
            # a member that no keyword has looked at
            left = F.filter(members, lambda e: ~self.member_seen(s, v, e["key"], path, root, home, via, own=True))
            out.append((is_object & F.exists(left, lambda e: self.failed(self.checks(rest, e["value"], path, root, home, via))), f"{path}: unevaluatedProperties"))
        if "propertyNames" in s:
            out.append((is_object & F.exists(keys, lambda k: self.failed(self.checks(s["propertyNames"], _as_value(k), path, root, home, via))), f"{path}: propertyNames"))
        return [(F.coalesce(test, F.lit(False)), message) for test, message in out]

    @staticmethod
    def failed(checks: list[tuple[Column, str]]) -> Column:
        out = F.lit(False)
        for test, _ in checks:
            out |= test
        return out

    @staticmethod
    def count(subs: list, fails) -> Column:
        out = F.lit(0)
        for sub in subs:
            out += F.when(fails(sub), 0).otherwise(1)
        return out


def errors(content: Column, schema: dict, types: dict[str, dict] | None = None, name: str = "", levels: int = UNROLL) -> Column:
    """array<string> of what a JSON text breaks; empty if it holds. A text that isn't JSON breaks everything.

    ``levels``: how often a reference is written out within itself, fewer times where the plan would hold more than
    ``MOST_CHECKS`` places. Below, places that break what a reference leads to are named by one message. Verdicts don't
    depend on it.
    """

    def found(compiler: _Compiler, v: Column, lost: Column) -> Column:
        compiler.at, compiler.lost = v, lost
        broken = [F.when(test, message) for test, message in compiler.checks(schema, v, "$", schema, name)]
        texts = F.filter(F.array(F.lit(None).cast("string"), *broken), lambda e: e.isNotNull())
        return F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(texts)

    none = F.array().cast("array<string>")
    while True:
        # all patterns, and all that is looked up, are met first
        known = _Compiler(types or {}, levels)
        known.most = MOST_CHECKS
        try:
            plain = jsons.let(jsons.variant(content), lambda v: found(known, v, none))  # the text is parsed once
            if known.units:
                known.broken_units(F.lit(None).cast("variant"), none)
            break
        except _TooLarge:
            levels //= 2
    if not known.units and not known.tests:
        return plain

    def judged(matched: Column | None = None) -> Column:
        compiler = _Compiler(types or {}, levels, matched)
        compiler.units, compiler.tests, compiler.cyclic = known.units, known.tests, known.cyclic

        def whole(v: Column) -> Column:
            if not known.units:
                return found(compiler, v, none)
            return jsons.let(compiler.broken(v, content, levels), lambda lost: found(compiler, v, lost))

        return jsons.let(jsons.variant(content), whole)

    # functions in Arrow batches can't stand within a lambda: what they find is bound outside
    return jsons.let(matching(content, known.tests), judged) if known.tests else judged()


def levels_of(instances: DataFrame, types: dict[str, dict]) -> dict[str, int]:
    """Levels by type for the instances (schema_id, content) of types that refer to themselves."""
    names = [n for n, body in types.items() if isinstance(body, dict) and refers_to_itself(body, types, n)]
    if not names:
        return {}
    deepest = instances.filter(F.col("schema_id").isin(*names)).groupBy("schema_id").agg(F.max(nesting(F.col("content"))).alias("most"))
    return {r.schema_id: max(UNROLL, (r.most or 0) + 1) for r in deepest.toLocalIterator()}


#: Types that one plan judges: a scan of the instances for each so many types.
TOGETHER = 32


def validate(entities: DataFrame, types: DataFrame | None = None, referred: bool = False) -> DataFrame:
    """entity_key, reason, errors of every instance.

    Types are judged first (``schemas.type_report``): an instance of a type that isn't valid isn't either. Schemas become
    part of the plan, so their texts are read on the driver; instances are judged by one scan for each ``TOGETHER``
    types. Values that break a reference keyword come before all other errors. Reasons, in order: NoSchemaId,
    InvalidSchemaId, SchemaNotFound, AbstractType, SchemaInvalid, MixedDialects, InvalidReference, Invalid; null if valid.
    ``referred``: what is referred to must be valid itself, not only stored (``valid_entities``).
    """
    types = entities.filter("is_schema") if types is None else types
    instances = entities.filter("NOT is_schema")
    raw = {r.gts_id: json.loads(r.content) for r in types.filter("gts_id IS NOT NULL").select("gts_id", "content").toLocalIterator()}
    bodies = {name: normal.normalised(body) for name, body in raw.items()}
    wrong = {r.type_id: f"{r.stage}: {r.error}" for r in schemas.type_report(types).filter("error IS NOT NULL").toLocalIterator()}
    mixed = {r.type_id for r in schemas.mixed_dialects(types).toLocalIterator()}
    known = F.col("schema_id").isin(*bodies) if bodies else F.lit(False)
    none = F.array().cast("array<string>")
    unbound = F.when(F.col("schema_id").isNull() | (F.col("schema_id") == ""), "NoSchemaId").when(~ident.is_valid_legacy(F.col("schema_id")), "InvalidSchemaId").otherwise("SchemaNotFound")
    judged = instances.filter(~F.coalesce(known, F.lit(False))).select("entity_key", unbound.alias("reason"), none.alias("errors"))

    def verdict(name: str) -> Column:
        """struct(reason, errors) of an instance of this type."""
        fixed = lambda reason, *texts: F.struct(F.lit(reason).alias("reason"), (F.array(*map(F.lit, texts)) if texts else none).alias("errors"))
        if bodies[name].get("x-gts-abstract") is True:
            return fixed("AbstractType")
        if name in mixed:
            return fixed("MixedDialects")
        if name in wrong:
            return fixed("SchemaInvalid", wrong[name])
        try:
            mine = F.when(F.col("schema_id") == name, F.col("content"))
            found = errors(mine, bodies[name], bodies, name)
            if bearing:
                named = references.errors(mine, raw[name], raw, name, levels.get(name, UNROLL))
                return F.when(F.size(named) > 0, F.struct(F.lit("InvalidReference").alias("reason"), named.alias("errors"))).otherwise(F.struct(F.when(F.size(found) > 0, "Invalid").alias("reason"), found.alias("errors")))
        except SchemaError as e:
            return fixed("SchemaInvalid", str(e))
        return F.struct(F.when(F.size(found) > 0, "Invalid").alias("reason"), found.alias("errors"))

    from . import references  # which compiles by this module

    bearing = any(map(normal.bears, raw.values()))
    names, levels = sorted(bodies), levels_of(instances, bodies) if bearing else {}
    for at in range(0, len(names), TOGETHER):
        some = names[at : at + TOGETHER]
        choice = F.lit(None).cast("struct<reason:string,errors:array<string>>")
        for name in some:
            choice = F.when(F.col("schema_id") == name, verdict(name)).otherwise(choice)
        rows = instances.filter(F.col("schema_id").isin(*some)).select("entity_key", choice.alias("v")).select("entity_key", "v.reason", "v.errors")
        judged = judged.unionByName(rows)
    if not bearing:
        return judged
    # what is named must be stored; shapes and scopes were judged above
    text = F.concat("path", F.lit(": "), "keyword", F.lit(" "), "reason")
    everything = instances.unionByName(types.select(*instances.columns))
    valid = valid_entities(everything) if referred else None
    refs = schemas.reference_errors(types, everything, valid).filter(F.col("reason").isin("NotStored", "NotValid"))
    refs = refs.groupBy("entity_key").agg(F.sort_array(F.collect_set(text)).alias("refs"))
    lost = F.col("refs").isNotNull() & (F.col("reason").isNull() | F.col("reason").isin("Invalid", "InvalidReference"))
    every = F.when(F.col("reason") == "InvalidReference", F.concat("errors", "refs")).otherwise(F.col("refs"))
    return judged.join(refs, "entity_key", "left").select("entity_key", F.when(lost, "InvalidReference").otherwise(F.col("reason")).alias("reason"), F.when(lost, every).otherwise(F.col("errors")).alias("errors"))


def valid_entities(entities: DataFrame) -> DataFrame:
    """entity_key of what a reference may name where it must be valid: types whose derivation and traits hold, and
    instances that their types admit, references aside."""
    types = entities.filter("is_schema")
    broken = schemas.derivation(types).filter(F.size("errors") > 0).select("type_id").unionByName(schemas.trait_errors(types).filter(F.size("errors") > 0).select("type_id"))
    own = types.select("entity_key").join(broken.select(F.col("type_id").alias("entity_key")), "entity_key", "left_anti")
    return own.unionByName(validate(entities).filter(F.col("reason").isNull() | (F.col("reason") == "InvalidReference")).select("entity_key")).distinct()


def validate_entities(entities: DataFrame) -> DataFrame:
    """entity_key, reason, errors of all that is stored: types by their report, everything else as an instance."""
    report = schemas.type_report(entities.filter("is_schema"))
    none = F.array().cast("array<string>")
    own = report.select(F.col("type_id").alias("entity_key"), F.when(F.col("error").isNotNull(), F.col("stage")).alias("reason"), F.when(F.col("error").isNotNull(), F.array("error")).otherwise(none).alias("errors"))
    return own.unionByName(validate(entities))


def _flat(schema: dict, types: dict[str, dict], via: tuple = ()) -> dict:
    """Properties, required names and closedness of a schema, its references to types and allOf put together."""
    ref = str(schema.get("$ref", "")).removeprefix("gts://")
    parts = [types[ref]] if ref in types and ref not in via else []
    parts += schema.get("allOf") or []
    out: dict = {"properties": {}, "required": [], "closed": False}
    for part in [*(_flat(p, types, (*via, ref)) for p in parts), {"properties": schema.get("properties") or {}, "required": schema.get("required") or [], "closed": schema.get("additionalProperties") is False}]:
        out["properties"] |= part["properties"]
        out["required"] += [x for x in part["required"] if x not in out["required"]]
        out["closed"] |= part["closed"]
    return out


def cast(content: Column, schema: dict, types: dict[str, dict] | None = None, levels: int = UNROLL) -> Column:
    """A JSON object moved to another minor version: defaults filled in, constant identifiers replaced, and what a
    closed version doesn't know taken out; nested objects and objects in arrays likewise, a schema within itself so many ``levels`` deep. Null for anything but
    an object."""
    v = jsons.variant(content)
    return F.when(jsons.kind(v) == "OBJECT", F.to_json(_moved(v, schema, types or {}, levels)))


def _moved(v: Column, schema: dict, types: dict[str, dict], levels: int, via: tuple = ()) -> Column:
    flat = _flat(schema, types)
    old = F.try_variant_get(v, "$", "map<string,variant>")
    kept = F.map_filter(old, lambda k, _: k.isin(*flat["properties"]) if flat["properties"] else F.lit(False)) if flat["closed"] else old
    put: dict[str, Column] = {}
    for name, sub in flat["properties"].items():
        if not isinstance(sub, dict):
            continue
        at, const = jsons.member(v, name), sub.get("const")
        if "default" in sub:
            put[name] = F.coalesce(at, F.parse_json(F.lit(json.dumps(sub["default"]))))
        if isinstance(const, str) and ident.is_legacy_text(const):
            # one identifier takes another's place; other values, and none, stay for the validation to judge
            now = put.get(name, at)
            put[name] = F.when(ident.is_valid_legacy(jsons.as_string(now)), F.parse_json(F.lit(json.dumps(const)))).otherwise(now)
        # a schema within itself comes by references
        way = (*via, json.dumps(sub, sort_keys=True))
        if way.count(way[-1]) > levels:
            continue
        nested = _flat(sub, types)
        if nested["properties"] or nested["closed"]:
            put[name] = F.when(jsons.kind(at) == "OBJECT", _moved(at, sub, types, levels, way)).otherwise(put.get(name, at))
        items = sub.get("items")
        if isinstance(items, dict) and (inner := _flat(items, types)) and (inner["properties"] or inner["closed"]):
            each = F.transform(F.try_variant_get(at, "$", "array<variant>"), lambda x: F.when(jsons.kind(x) == "OBJECT", _moved(x, items, types, levels, way)).otherwise(x))
            put[name] = F.when(jsons.kind(at) == "ARRAY", F.to_variant_object(each)).otherwise(put.get(name, at))
    if not put:
        return F.to_variant_object(kept)
    rest = F.map_filter(kept, lambda k, _: ~k.isin(*put))
    new = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, put)), F.array(*put.values())), lambda _, x: x.isNotNull())
    return F.to_variant_object(F.map_concat(rest, new))


def cast_and_validate(instances: DataFrame, target: str, types: dict[str, dict]) -> DataFrame:
    """entity_key, content, errors of instances of the target's family, moved to it and judged there; others are
    refused. Constant identifiers are judged as texts only. Whether versions are compatible plays no part."""
    def loose(x):
        if isinstance(x, dict):
            c = x.get("const")
            return {k: loose(y) for k, y in x.items() if k != "const"} | {"type": "string"} if isinstance(c, str) and c.startswith("gts.") else {k: loose(y) for k, y in x.items()}
        return [loose(y) for y in x] if isinstance(x, list) else x

    levels = UNROLL
    if refers_to_itself(types[target], types, target):
        levels = max(UNROLL, (instances.agg(F.max(nesting(F.col("content")))).first()[0] or 0) + 1)
    moved = instances.select("entity_key", ident.are_minor_variants(F.col("schema_id"), F.lit(target)).alias("kin"), cast(F.col("content"), types[target], types, levels).alias("content"))
    tolerant = {k: loose(s) for k, s in types.items()}
    held = errors(F.col("content"), tolerant[target], tolerant, target)
    return moved.select("entity_key", F.when(F.col("kin"), F.col("content")).alias("content"), F.when(F.coalesce(F.col("kin"), F.lit(False)), held).otherwise(F.array(F.lit("NotMinorVariantPair"))).alias("errors"))
