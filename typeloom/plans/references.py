"""Reference keywords checked on instances: schema and instance walked together, compiled to Column expressions.

Keywords constrain texts only. Of the alternatives of ``oneOf`` and ``anyOf`` those that bear a keyword are counted; one
that doesn't rescues a value that its type admits. ``not`` fails where its keywords hold and the rest of it accepts the
value; a condition holds likewise, and the branch that it selects is checked, its structure too if the condition bears
a keyword, for then the validator sees nothing of the conditional (``normal``). Whether what is named is stored is
another question (``schemas.reference_errors``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ident, jsons, normal
from . import evaluate

PATTERN, TYPE = "x-gts-pattern-ref", "x-gts-type-ref"


def candidate(v: Column, keyword: str, operand: str) -> Column:
    """Whether a value breaks a keyword: no reference of its kind, or outside the operand's scope."""
    text, scope = jsons.as_string(v), F.lit(operand)
    shaped = ident.is_pattern(text) if keyword == PATTERN else ident.is_valid(text) & (ident.is_type(text) if keyword == TYPE else ~ident.is_type(text))
    return text.isNotNull() & ~(shaped & ident.covers(scope, text))


def admits(branch, v: Column) -> Column:
    """Whether a branch's ``type``, if it has one, admits the value."""
    names = branch.get("type") if isinstance(branch, dict) else None
    if names is None:
        return F.lit(True)
    kind, number = jsons.kind(v), F.try_variant_get(v, "$", "double")
    out = F.lit(False)
    for name in [names] if isinstance(names, str) else names:
        out |= kind.isin(*evaluate.KINDS["number"]) & (number == F.floor(number)) if name == "integer" else kind.isin(*evaluate.KINDS.get(name, ()))
    return out


class Walker:
    """Checks of one type's reference keywords. ``compiler`` judges structure; ``own`` is the type that ``/$id`` means."""

    def __init__(self, compiler: evaluate._Compiler, own: str):
        self.compiler, self.own = compiler, own
        #: As the evaluator's: keywords may stand in documents of several dialects.
        self.scope = compiler.scope

    def failed(self, checks: list[tuple[Column, str]]) -> Column:
        return self.compiler.failed(checks)

    def bears(self, node, root: dict, home: str, seen: tuple = ()) -> bool:
        """Whether a reference keyword stands in a schema, or in what its references lead to."""
        if normal.bears(node):
            return True
        open_ = [node]
        while open_:
            x = open_.pop()
            ref = x.get("$ref") if isinstance(x, dict) else None
            if isinstance(ref, str) and (home, ref) not in seen:
                seen = (*seen, (home, ref))
                target, r2, h2 = self.compiler.target(ref, root, home)
                if self.bears(target, r2, h2, seen):
                    return True
            open_ += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
        return False

    def accepts(self, s, v: Column, path: str, at: tuple) -> Column:
        """Whether a schema without its reference keywords accepts the value; one that can't be read does."""
        root, home, via = at
        try:
            return ~self.failed(self.compiler.checks(normal.stripped(s), v, path, root, home, via))
        except evaluate.SchemaError:
            return F.lit(True)

    def checks(self, s, v: Column, path: str, root: dict, home: str, via: tuple = ()) -> list[tuple[Column, str]]:
        """(failed, message) of a value that is there."""
        if not isinstance(s, dict):
            return []
        if not self.scope:
            self.scope.append((root, home, self.compiler.draft(root)))
            try:
                return self.checks(s, v, path, root, home, via)
            finally:
                self.scope.pop()
        out: list[tuple[Column, str]] = []
        at = (root, home, via)
        bears = lambda sub: self.bears(sub, root, home)
        below = lambda sub: self.checks(sub, v, path, *at)
        if isinstance(s.get("$ref"), str):
            way = (*via, (home, s["$ref"]))
            if via.count(way[-1]) < self.compiler.levels:
                node, r2, h2 = self.compiler.target(s["$ref"], root, home)
                out += self.checks(node, v, path, r2, h2, way)
        for keyword in normal.KEYWORDS:
            operand = self.own if s.get(keyword) == "/$id" else s.get(keyword)
            if isinstance(operand, str) and ident.is_pattern_text(operand):  # others are errors of the schema
                out.append((candidate(v, keyword, operand), f"{path}: {keyword} {operand}"))
        for key in ("oneOf", "anyOf"):
            bearing = [b for b in s.get(key) or [] if bears(b)]
            if bearing:
                held = sum((F.when(self.failed(below(b)), 0).otherwise(1) for b in bearing), F.lit(0))
                rescued = F.lit(False)
                for b in s[key]:
                    rescued |= F.lit(False) if bears(b) else admits(b, v)
                out.append(((held == 0) & ~rescued | ((held > 1) if key == "oneOf" else F.lit(False)), f"{path}: {key} of references"))
        for sub in s.get("allOf") or []:
            out += below(sub)
        if isinstance(s.get("not"), dict) and bears(s["not"]):
            out.append((~self.failed(below(s["not"])) & self.accepts(s["not"], v, path, at), f"{path}: not of references"))
        if "if" in s and any(bears(s.get(k)) for k in normal.CONDITION):
            condition = s["if"]
            holds = ~self.failed(below(condition)) & self.accepts(condition, v, path, at) if isinstance(condition, dict) else F.lit(condition is True)
            for key, when in (("then", holds), ("else", ~holds)):
                if key in s:
                    out += [(when & test, message) for test, message in below(s[key])]
                    if bears(condition):
                        out.append((when & ~self.accepts(s[key], v, path, at), f"{path}: {key} of a condition on references"))
        if any(bears(s.get(k)) for k in ("properties", "patternProperties", "additionalProperties", "unevaluatedProperties")):
            out += self.members(s, v, path, at)
        if any(bears(s.get(k)) for k in ("prefixItems", "items", "additionalItems")):
            out += self.items(s, v, path, at)
        return [(F.coalesce(test, F.lit(False)), message) for test, message in out]

    def members(self, s: dict, v: Column, path: str, at: tuple) -> list[tuple[Column, str]]:
        known, named = s.get("properties") or {}, s.get("patternProperties") or {}
        entries = F.when(jsons.kind(v) == "OBJECT", F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
        out = []
        for name, sub in known.items():
            member = jsons.member(v, name)
            out += [(member.isNotNull() & test, message) for test, message in self.checks(sub, member, f"{path}.{name}", *at)]
        breaks = lambda sub, when: lambda e: when(e["key"]) & self.failed(self.checks(sub, e["value"], path, *at))
        finds = lambda pattern: lambda key: self.compiler.search(key, pattern)
        for pattern, sub in named.items():
            out.append((F.exists(entries, breaks(sub, finds(pattern))), f"{path}: references of members {pattern}"))

        def free(key: Column) -> Column:
            covered = key.isin(*known) if known else F.lit(False)
            for pattern in named:
                covered |= self.compiler.search(key, pattern)
            return ~covered

        for key in ("additionalProperties", "unevaluatedProperties"):
            if isinstance(s.get(key), dict):
                out.append((F.exists(entries, breaks(s[key], free)), f"{path}: references of further members"))
        return out

    def items(self, s: dict, v: Column, path: str, at: tuple) -> list[tuple[Column, str]]:
        items = F.try_variant_get(v, "$", "array<variant>")
        first = s.get("prefixItems") or (s["items"] if isinstance(s.get("items"), list) else [])
        rest = s.get("additionalItems") if isinstance(s.get("items"), list) and "prefixItems" not in s else s.get("items")
        out = [(F.coalesce(F.size(items) > i, F.lit(False)) & self.failed(self.checks(sub, F.get(items, F.lit(i)), f"{path}[{i}]", *at)), f"{path}[{i}]: references") for i, sub in enumerate(first)]
        if isinstance(rest, dict):
            tail = F.slice(items, len(first) + 1, F.greatest(F.size(items), F.lit(0))) if first else items
            out.append((F.exists(tail, lambda x: self.failed(self.checks(rest, x, f"{path}[]", *at))), f"{path}[]: references"))
        return out


def errors(content: Column, schema: dict, types: dict[str, dict] | None = None, name: str = "", levels: int = evaluate.UNROLL) -> Column:
    """array<string> of the reference keywords that a JSON text breaks; empty if none, or if it isn't JSON."""
    def judged(matched: Column | None = None) -> tuple[Column, list[str | None]]:
        compiler = evaluate._Compiler(types or {}, levels, matched)
        walker = Walker(compiler, name)

        def found(v: Column) -> Column:
            broken = [F.when(test, message) for test, message in walker.checks(schema, v, "$", schema, name)]
            return F.filter(F.array(F.lit(None).cast("string"), *broken), lambda e: e.isNotNull())

        return jsons.let(jsons.variant(content), lambda v: F.when(v.isNull(), F.array().cast("array<string>")).otherwise(found(v))), compiler.tests

    plain, tests = judged()
    return jsons.let(evaluate.matching(content, tests), lambda m: judged(m)[0]) if tests else plain
