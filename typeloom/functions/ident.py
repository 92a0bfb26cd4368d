"""Typed identifiers as Column expressions.

An identifier is ``gts.`` and a chain of segments; a segment is vendor.package.namespace.type.vMAJOR[.MINOR], those
of types end in ``~``. All functions here stay in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 1024
# Fixed grammar: a name, an unsigned 32-bit number without leading zeros, a UUID.
NAME = "[a-z_][a-z0-9_]*"
U32 = "(?:0|[1-9][0-9]{0,8}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}|4294967[01][0-9]{2}|42949672[0-8][0-9]|429496729[0-5])"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
SEGMENT = rf"{NAME}\.{NAME}\.{NAME}\.{NAME}\.v{U32}(?:\.{U32})?"
ID = rf"^gts\.(?:{SEGMENT}~)+(?:{SEGMENT}|{UUID})?\z"
#: The older grammar also admits an instance of a single segment.
LEGACY_ID = rf"^gts\.(?:{SEGMENT}~)*(?:{SEGMENT}~?|{UUID})\z"
_PARTIAL = rf"(?:{NAME}\.){{0,4}}\*|{NAME}\.{NAME}\.{NAME}\.{NAME}\.v(?:\*|{U32}\.\*)"
PATTERN = rf"^gts\.(?:{SEGMENT}~)*(?:{_PARTIAL})\z"
_LEGACY_PART = rf"(?:(?:{NAME}\.){{0,4}}\*|{NAME}\.{NAME}\.{NAME}\.{NAME}\.v[0-9]+(?:\.[0-9]+)?)"
LEGACY_PATTERN = rf"^gts\.{_LEGACY_PART}(?:~{_LEGACY_PART})*~?\z"
# Fixed namespace of identifier UUIDs: version 5 of the URL namespace and the text "gts".
NAMESPACE = "63b062805dd6517dabc65a2127e843c3"


def _short(c: Column) -> Column:
    return F.length(c) <= MAX_LENGTH


def is_valid(c: Column) -> Column:
    """A concrete identifier. Null is not valid."""
    return F.coalesce(c.rlike(ID) & _short(c), F.lit(False))


def is_valid_legacy(c: Column) -> Column:
    return F.coalesce(c.rlike(LEGACY_ID) & _short(c), F.lit(False))


def is_pattern(c: Column) -> Column:
    """A concrete identifier or one with a single trailing wildcard."""
    return F.coalesce((c.rlike(ID) | c.rlike(PATTERN)) & _short(c), F.lit(False))


def is_wildcard(c: Column) -> Column:
    return F.coalesce(c.rlike(PATTERN) & _short(c), F.lit(False))


def is_legacy_pattern(c: Column) -> Column:
    return F.coalesce(c.rlike(LEGACY_PATTERN), F.lit(False))


def is_type(c: Column) -> Column:
    return c.endswith("~")


def strip_uri(c: Column) -> Column:
    return F.regexp_replace(c, "^gts://", "")


def parent_type(c: Column) -> Column:
    """The type that a type derives from; null for a base type or an instance."""
    found = F.regexp_extract(c, r"^(gts\..*~)[^~]+~\z", 1)
    return F.when(found != "", found)


def type_of(c: Column) -> Column:
    """The chain up to the last ``~`` before the end: an instance's type, or a type's parent."""
    found = F.regexp_extract(c, r"^(gts\..*~)[^~]+~?\z", 1)
    return F.when(found != "", found)


def family(c: Column) -> Column:
    """A type without the minor version of its last segment; null for an instance."""
    return F.when(is_type(c), F.regexp_replace(c, r"\.v([0-9]+)\.[0-9]+~\z", ".v$1~"))


def last_minor(c: Column) -> Column:
    return F.regexp_extract(c, r"\.v[0-9]+\.([0-9]+)~\z", 1).try_cast("bigint")


def are_minor_variants(a: Column, b: Column) -> Column:
    """Types of the same family that both give a minor version."""
    return (family(a) == family(b)) & last_minor(a).isNotNull() & last_minor(b).isNotNull()


def uuid(c: Column) -> Column:
    """The UUID tail of an identifier, or the version-5 UUID of its text."""
    tail = F.regexp_extract(c, rf"~({UUID})\z", 1)
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(c, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*map(F.lit, "89ab")), nibble % 4 + 1)
    part = lambda start, n: F.substring(digest, start, n)
    made = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
    return F.when(tail != "", tail).otherwise(made)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(c: Column) -> Column:
    """array<struct> of an identifier's or pattern's segments: raw, names, versions, kind. Null where it isn't valid."""
    parts = F.filter(F.split(F.regexp_replace(c, r"^gts\.", ""), "~"), lambda p: p != "")

    def one(p: Column, open_: Column) -> Column:
        uuid_tail = p.rlike(rf"^{UUID}\z")
        # of a segment the tokens before one with a wildcard count; a UUID has none
        fixed = F.split(F.regexp_replace(p, r"(^|\.)[^.]*\*\z", ""), r"\.")
        held = F.struct(uuid_tail.alias("uuid"), F.when(uuid_tail, F.array().cast("array<string>")).otherwise(fixed).alias("t"))

        def described(x: Column) -> Column:
            name = lambda k: F.when(F.get(x["t"], F.lit(k)) != "", F.get(x["t"], F.lit(k)))
            return F.struct(
                p.alias("raw"), name(0).alias("vendor"), name(1).alias("package"), name(2).alias("namespace"), name(3).alias("type"),
                F.substring(F.get(x["t"], F.lit(4)), 2, 20).try_cast("bigint").alias("ver_major"), F.get(x["t"], F.lit(5)).try_cast("bigint").alias("ver_minor"),
                open_.alias("is_type"), p.endswith("*").alias("is_wildcard"), F.when(x["uuid"], p).alias("uuid_tail"),
            )

        return let(held, described)

    def all_(ps: Column) -> Column:
        return F.transform(ps, lambda p, i: one(p, (i < F.size(ps) - 1) | is_type(c)))

    return F.when(is_pattern(c), let(parts, all_))


def segment_text(s: Column) -> Column:
    """The text of a segment struct: its names and version, ``*`` where no major version is given, or its UUID."""
    version = F.when(s["ver_major"].isNull(), "*").otherwise(F.concat_ws(".", F.concat(F.lit("v"), s["ver_major"].cast("string")), s["ver_minor"].cast("string")))
    return F.coalesce(s["uuid_tail"], F.concat_ws(".", s["vendor"], s["package"], s["namespace"], s["type"], version))


def described(c: Column) -> Column:
    """struct(valid, is_wildcard, error) of an identifier or pattern."""
    valid = is_pattern(c)
    why = (
        F.when(valid, None)
        .when(c.isNull() | (c == ""), "it is empty")
        .when(~_short(c), f"it is longer than {MAX_LENGTH}")
        .when(~c.startswith("gts."), "it doesn't begin with gts.")
        .when(c != F.lower(c), "it has capital letters")
        .when(c.rlike(r"\*.") | c.rlike(r"\*.*\*"), "a wildcard must be the last character")
        .otherwise("a segment is malformed")
    )
    return F.struct(valid.alias("valid"), F.coalesce(valid & c.endswith("*"), F.lit(False)).alias("is_wildcard"), why.alias("error"))


def match_or_cover(candidate: Column, pattern: str) -> Column:
    """struct(matched, error): an identifier is matched by a literal pattern, a candidate pattern is covered by it."""
    if not is_pattern_text(pattern):
        return F.struct(F.lit(False).alias("matched"), F.lit(f"not an identifier pattern: {pattern}").alias("error"))
    fits = F.when(candidate.endswith("*"), covers(F.lit(pattern), candidate)).otherwise(matches(candidate, pattern))
    valid = is_pattern(candidate)
    wrong = F.when(~valid, F.concat(F.lit("candidate: "), described(candidate)["error"]))
    return F.struct((valid & fits).alias("matched"), wrong.alias("error"))


@dataclass(frozen=True)
class Pattern:
    """A pattern that is compiled on the driver into a prefix, which scans can push down, and a regular expression."""

    text: str

    def __post_init__(self):
        if not is_pattern_text(self.text):
            raise ValueError(f"not an identifier pattern: {self.text}")

    @property
    def wildcard(self) -> bool:
        return self.text.endswith("*")

    def regex(self) -> str:
        *inner, last = self.text.removeprefix("gts.").split("~")
        flexible = lambda s: re.escape(s) + ("" if re.search(r"\.v\d+\.\d+$", s) else r"(?:\.[0-9]+)?")
        head = "^gts\\." + "".join(flexible(s) + "~" for s in inner)
        if last == "" or last == "*":
            return head
        if last.endswith("*"):
            return head + re.escape(last[:-1])
        return head + (re.escape(last) if re.fullmatch(UUID, last) else flexible(last)) + r"\z"

    def prefix(self) -> str:
        """The text before the first place that a candidate may vary."""
        first, sep, _ = self.text.partition("~")
        if sep:
            return first if not re.search(r"\.v\d+\.\d+$", first) else first + "~"
        return self.text.removesuffix("*")

    def matches(self, c: Column) -> Column:
        return c.startswith(self.prefix()) & c.rlike(self.regex())


def is_pattern_text(text: str) -> bool:
    py = lambda rx: re.compile(rx.replace(r"\z", r"\Z"))
    return len(text) <= MAX_LENGTH and bool(py(ID).match(text) or py(PATTERN).match(text))


def is_legacy_text(text: str) -> bool:
    return len(text) <= MAX_LENGTH and bool(re.match(LEGACY_ID.replace(r"\z", r"\Z"), text))


def matches(c: Column, pattern: str) -> Column:
    """Segment-wise match of identifiers by a literal pattern; ``X~*`` also matches ``X~`` itself."""
    return F.coalesce(Pattern(pattern).matches(c), F.lit(False))


def matches_legacy(c: Column, pattern: str) -> Column:
    """The older matcher: a type's minor version is optional, and ``X~*`` does not match ``X~`` itself."""
    quoted = re.sub(r"(\.v\d+)~", r"\1(?:\\.[0-9]+)?~", re.escape(pattern).replace(r"\*", ".*").replace(r"\~", "~").replace("~.*", "~.+"))
    return F.coalesce(c.rlike(f"^{quoted}" + ("" if pattern.endswith(("~", "*")) else r"\z")), F.lit(False))


def covers(a: Column, b: Column) -> Column:
    """Every identifier that pattern ``b`` selects is also selected by pattern ``a``, for two pattern columns.

    ``a`` is cut to what it fixes: a final wildcard fixes the text before it, a type fixes itself and selects all
    below it; a missing minor version stands for any.
    """
    return F.coalesce(is_pattern(a) & is_pattern(b) & covers_valid(a, b), F.lit(False))


def covers_valid(a: Column, b: Column) -> Column:
    """``covers`` of two columns that are known to be patterns."""
    fixed = lambda c: F.regexp_replace(c, r"\*\z", "")

    quoted = F.regexp_replace(fixed(a), r"\.", r"\\.")
    flexible = F.regexp_replace(quoted, r"(\\\.v[0-9]+)(~|\z)", r"$1(?:\\.[0-9]+)?$2")
    open_end = a.endswith("*") | is_type(a)
    exact = ~open_end
    reached = F.regexp_like(fixed(b), F.concat(F.lit("^"), flexible, F.when(exact, F.lit(r"\z")).otherwise(F.lit(""))))
    selects_many = b.endswith("*") | is_type(b)
    return reached & (open_end | ~selects_many)
