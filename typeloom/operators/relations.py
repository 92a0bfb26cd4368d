"""References between entities: edges, broken ones, reachable graphs.

Edges are a table; what is broken comes from anti joins on identifiers, so a relation of any size is shuffled by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident, jsons
from ..plans.lineage import cut

#: After so many steps what a search has found is checkpointed as a whole.
STEPS = 16


def _tagged(entities: DataFrame) -> DataFrame:
    """``edges`` with whether the end is concrete. Only documents with nested members are walked in Python, and those
    without any identifier in their text nowhere."""
    content = F.col("content")
    likely = entities.select(F.col("entity_key").alias("source_id"), F.col("is_schema").alias("source_is_schema"), "content")
    row = lambda df, strings: df.select("source_id", "source_is_schema", F.explode(jsons.references(strings)).alias("r"))
    nested = row(likely.filter(~jsons.is_flat(content) & jsons.may_refer(content)), jsons.strings(content))
    return row(likely, jsons.flat_strings(content)).unionByName(nested).select("source_id", "source_is_schema", "r.*")


def edges(entities: DataFrame) -> DataFrame:
    """source_id, source_is_schema, id, source_path: every identifier or pattern in a document, its own id included."""
    return _tagged(entities).drop("concrete")


def counts(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("entities"), F.count_if("is_schema").alias("schemas"), F.count_if(~F.col("is_schema")).alias("instances"))


def broken(entities: DataFrame) -> DataFrame:
    """source_id, source_is_schema, referenced_id, source_path, reason of each reference that leads nowhere.

    Types must be stored as types, instances under their key; patterns are passed over. An instance whose type is
    neither stored nor referred to in its text misses its type binding. Identifiers are made distinct before they meet
    the stored keys, so one that many refer to is a row; edges are joined with the missing ones alone.
    """
    found = _tagged(entities)
    of_type = ident.is_type(F.col("id"))
    stored = entities.groupBy(F.col("entity_key").alias("id")).agg(F.bool_or("is_schema").alias("as_type"))
    # a document is stored under its own key, so its own id leads somewhere
    others = found.filter(F.col("concrete") & ((F.col("id") != F.col("source_id")) | (of_type & ~F.col("source_is_schema"))))
    met = others.select("id").distinct().join(stored, "id", "left")
    missing = met.filter(F.when(of_type, ~F.coalesce("as_type", F.lit(False))).otherwise(F.col("as_type").isNull())).select("id")
    lost = others.join(missing, "id").withColumn("reason", F.when(of_type, "MissingSchema").otherwise("MissingInstance"))
    bound = entities.filter(~F.col("is_schema") & ident.is_valid_legacy(F.col("schema_id")))
    bound = bound.select(F.col("entity_key").alias("source_id"), F.col("is_schema").alias("source_is_schema"), F.col("schema_id").alias("id"), F.lit("(type binding)").alias("source_path"))
    unbound = bound.join(stored.filter("as_type"), "id", "left_anti").join(found.select("source_id", "id").distinct(), ["source_id", "id"], "left_anti")
    row = lambda df: df.select("source_id", "source_is_schema", F.col("id").alias("referenced_id"), "source_path", "reason")
    return row(lost).unionByName(row(unbound.withColumn("reason", F.lit("MissingTypeBinding"))))


def _path(c: Column) -> Column:
    """What an identifier or a pattern fixes, as names and major versions with dots between them; minor versions, which
    some patterns leave open, are left out."""
    plain = F.regexp_replace(c, r"(\.v[0-9]+)\.[0-9]+", "$1")
    return F.translate(F.regexp_replace(F.regexp_replace(plain, r"(?:(?<=[.])v)?\*\z", ""), r"[.~]\z", ""), "~", ".")


def _keyed(patterns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and ids with the path that they have in common: a pattern's whole path, and of an id the beginnings of
    as many names as some pattern has (identifiers have at most 1024 characters, which bounds their number)."""
    depth = lambda c: F.size(F.split(c, r"\."))
    named = patterns.filter(ident.is_pattern(F.col("pattern"))).withColumn("path", _path(F.col("pattern")))
    depths = [r["n"] for r in named.select(depth(F.col("path")).alias("n")).distinct().collect()]
    cuts = F.array(*map(F.lit, depths)).cast("array<int>")
    own = ids.filter(ident.is_valid(F.col("id"))).withColumn("own", _path(F.col("id")))
    spread = own.withColumn("n", F.explode(F.filter(cuts, lambda n: n <= depth(F.col("own"))))).withColumn("path", F.expr("substring_index(own, '.', n)"))
    return named, spread.drop("own", "n")


def selected(patterns: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows of ``patterns`` (a column pattern) with those of ``ids`` (a column id) that they select.

    An equi-join on all names that a pattern fixes; only minor versions are left to a filter on what meets.
    """
    named, spread = _keyed(patterns, ids)
    return named.join(spread, "path").filter(ident.covers_valid(F.col("pattern"), F.col("id"))).drop("path")


def unmatched(patterns: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``patterns`` that select none of the ids; ids are compared once each."""
    named, spread = _keyed(patterns, ids.select("id").distinct())
    found = named.alias("p").join(spread.alias("i"), (F.col("p.path") == F.col("i.path")) & ident.covers_valid(F.col("p.pattern"), F.col("i.id")), "left_semi")
    return patterns.join(found.select("pattern").distinct(), "pattern", "left_anti")


def is_consistent(entities: DataFrame) -> bool:
    return broken(entities).isEmpty()


def bindings(entities: DataFrame) -> DataFrame:
    """source_id, source_is_schema, id, source_path: from each entity to its type by its schema id."""
    bound = entities.filter(F.col("schema_id").isNotNull() & (F.col("schema_id") != "") & ~F.col("schema_id").rlike("^https?://json-schema[.]org"))
    return bound.select(F.col("entity_key").alias("source_id"), F.col("is_schema").alias("source_is_schema"), F.col("schema_id").alias("id"), F.lit("(type binding)").alias("source_path"))


def reachable(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, distance: what each root (a column ``id``) leads to by references and schema ids, nearest first.

    A breadth-first search over all roots at once; each step joins the new front with the edges. The search ends
    when nothing new is found. Fronts are checkpointed, so plans don't grow with the distance.
    """
    every = edges(entities).select("source_id", "id").unionByName(bindings(entities).select("source_id", "id"))
    own = cut(every.filter(F.col("source_id") != F.col("id")).select("source_id", F.col("id").alias("to")).distinct())
    seen = front = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("distance")).distinct())
    step = 0
    while not front.isEmpty():
        step += 1
        found = front.join(own, front.id == own.source_id).select("root", F.col("to").alias("id"), F.lit(step).alias("distance")).distinct()
        front = cut(found.join(seen, ["root", "id"], "left_anti").select("root", "id", "distance"))
        seen = seen.unionByName(front)
        seen = seen if step % STEPS else cut(seen)
    return seen


def graph(entities: DataFrame, root: str, bound: bool = False) -> DataFrame:
    """The references of what one identifier leads to, with whether each end is stored: source_id, source_path, id, missing.

    Types named by schema ids alone are followed as well; ``bound`` also gives these edges as rows.
    """
    spark = entities.sparkSession
    nodes = reachable(entities, spark.createDataFrame([(root,)], "id string")).select(F.col("id").alias("source_id")).distinct()
    keys = entities.select(F.col("entity_key").alias("id"), F.lit(True).alias("stored")).distinct()
    every = edges(entities).unionByName(bindings(entities)) if bound else edges(entities)
    mine = every.join(nodes, "source_id", "left_semi").filter((F.col("id") != F.col("source_id")) & ~F.col("id").contains("json-schema.org"))
    return mine.join(keys, "id", "left").select("source_id", "source_path", "id", F.col("stored").isNull().alias("missing"))
