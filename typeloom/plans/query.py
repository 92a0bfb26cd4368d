"""The query language ``base[key=value,...]`` as DataFrame plans.

A query becomes one filter: the base's fixed beginning and its regular expression (an exact base: equality), which
scans can push down, and a comparison per attribute. Results follow the entities' order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident, jsons


class QueryError(ValueError):
    """A query that can't be parsed."""


@dataclass(frozen=True)
class Query:
    base: str
    wildcard: bool
    filters: dict[str, str] = field(default_factory=dict)

    def selects(self, gts_id: Column) -> Column:
        """Wildcards match by segments, anything else by equality. A base that no identifier can match selects none."""
        if not self.wildcard:
            return gts_id == self.base
        return ident.matches(gts_id, self.base) if ident.is_pattern_text(self.base) else F.lit(False)

    def holds(self, content: Column) -> Column:
        v, found = jsons.variant(content), F.lit(True)
        for key, value in self.filters.items():
            text = jsons.leaf_text(jsons.member(v, key))
            found &= F.coalesce(text != "" if value == "*" else text == value, F.lit(False))
        return found


def parse(text: str | None) -> Query:
    text = (text or "").strip()
    if not text:
        raise QueryError("Invalid query: it is empty")
    base, bracket, rest = text.partition("[")
    base = base.strip()
    if bracket and not rest.endswith("]"):
        raise QueryError("Invalid query: ']' is missing")
    if bracket and base.endswith(("~", "~*")):
        raise QueryError("Invalid query: attribute filters need a base that selects instances")
    wildcard = "*" in base
    if wildcard and (base.count("*") > 1 or not base.endswith((".*", "~*"))):
        raise QueryError("Invalid query: a wildcard must be the last part")
    if not wildcard and not (ident.is_pattern_text(base) or ident.is_legacy_text(base)):
        raise QueryError("Invalid query: not an identifier")
    return Query(base, wildcard, _filters(rest[:-1]) if bracket else {})


def _filters(text: str) -> dict[str, str]:
    """Entries without ``=`` or key are passed over; the last of equal keys counts."""
    pairs = (entry.strip().partition("=") for entry in text.split(","))
    return {key.strip(): value.strip().strip('"').strip("'") for key, equals, value in pairs if equals and key.strip()}


def limit_of(limit: int) -> int:
    return limit if 1 <= limit <= 1000 else 100


def matching(entities: DataFrame, text: str) -> DataFrame:
    """All entities that a query selects: no limit."""
    query = parse(text)
    return entities.filter(F.col("gts_id").isNotNull() & query.selects(F.col("gts_id")) & query.holds(F.col("content")))


def run(entities: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """The first matching entities in their order."""
    return matching(entities, text).orderBy("seq").limit(limit_of(limit))


def filter_ids(ids: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """A query over bare identifiers (seq, gts_id), which have no attributes to filter by."""
    query = parse(text)
    if query.filters:
        raise QueryError("Invalid query: identifiers have no attributes")
    return ids.filter(query.selects(F.col("gts_id"))).orderBy("seq").limit(limit_of(limit))


def listing(entities: DataFrame, limit: int = 100) -> DataFrame:
    """Identifier, schema and kind of the first entities that have an identifier."""
    return entities.filter(F.col("gts_id").isNotNull()).orderBy("seq").limit(limit_of(limit)).select("gts_id", "schema_id", "is_schema")


def attribute_access(entities: DataFrame, selector: str) -> DataFrame:
    """``id@path`` for one entity: id, path, resolved, value (JSON text), error, and the available paths where it leads nowhere.

    Always one row: a missing ``@``, a blank id and an unknown entity are errors of their own.
    """
    left, at, right = selector.partition("@")
    key, path = left.strip(), right.strip()
    wrong = "Attribute selector requires '@path' in the identifier." if not at else "Missing identifier before '@'." if not key else None
    asked = entities.sparkSession.createDataFrame([(key, path if at else None)], "id string, path string")
    if wrong:
        nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
        return asked.select("id", "path", F.lit(False).alias("resolved"), nothing("string", "value"), F.lit(wrong).alias("error"), nothing("array<string>", "available"))
    mine = entities.filter((F.col("gts_id") == key) | (F.col("entity_key") == key)).orderBy(F.col("gts_id").isNull()).limit(1)
    found = mine.select(F.lit(key).alias("id"), "content", jsons.attribute_result(jsons.variant(F.col("content")), path).alias("r"))
    resolved = F.coalesce("r.resolved", F.lit(False))
    return asked.join(found, "id", "left").select(
        "id", "path", resolved.alias("resolved"), "r.value",
        F.when(F.col("content").isNull(), "Entity not found.").otherwise(F.col("r.error")).alias("error"),
        F.when(~resolved, jsons.available_fields("content")).alias("available"),
    )
