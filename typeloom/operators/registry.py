"""A registry of types and instances as immutable DataFrames.

``entities`` has a row per stored document: seq, entity_key, gts_id, is_schema, schema_id, content. Writes return new
DataFrames; ``snapshot`` writes a version as Parquet and reads it back. All writes go by set: outcomes of a whole
batch come from one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ident, jsons

COLUMNS = ("seq", "entity_key", "gts_id", "is_schema", "schema_id", "content")


def entities_of(documents: DataFrame, id_fields=jsons.ID_FIELDS, schema_fields=jsons.SCHEMA_FIELDS) -> DataFrame:
    """Documents (seq, content) with what extraction finds. Rows without any id, and texts that are no object, go.

    The key is the identifier, or the plain text id of an anonymous instance.
    """
    x = jsons.extract(F.col("content"), id_fields, schema_fields)
    return (
        documents.select("seq", "content", x.alias("x"))
        .filter(F.col("x.id").isNotNull())
        .select("seq", F.col("x.id").alias("entity_key"), F.when(ident.is_valid_legacy(F.col("x.id")), F.col("x.id")).alias("gts_id"), F.col("x.is_schema").alias("is_schema"), F.col("x.schema_id").alias("schema_id"), "content")
    )


def ingest_errors(entities: DataFrame) -> DataFrame:
    """entity_key and what admission finds wrong first: instances of a single segment, types without a URI as id, types
    of an unknown dialect; null where it is admitted."""
    v = jsons.variant(F.col("content"))
    uri = F.coalesce(jsons.as_string(jsons.member(v, "$id")), jsons.as_string(jsons.member(v, "$$id")))
    dialect = F.coalesce(jsons.as_string(jsons.member(v, "$schema")), jsons.as_string(jsons.member(v, "$$schema")))
    single = F.col("gts_id").isNotNull() & ~F.col("gts_id").contains("~")
    return entities.select(
        "seq", "entity_key",
        F.when(~F.col("is_schema") & single, "SingleSegmentInstance")
        .when(F.col("is_schema") & ~F.coalesce(uri.startswith("gts://"), F.lit(False)), "InvalidSchemaId")
        .when(F.col("is_schema") & ~ident.is_type(F.col("entity_key")), "NotATypeId")
        .when(F.col("is_schema") & dialect_of(dialect).isNull(), "UnsupportedDialect")
        .alias("error"),
    )


def dialect_of(url):
    """draft-07, 2019-09 or 2020-12; null for other URLs."""
    plain = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"#?\z", "")
    # The three known dialects.
    return F.when(plain == "json-schema.org/draft-07/schema", "draft-07").when(plain == "json-schema.org/draft/2019-09/schema", "2019-09").when(plain == "json-schema.org/draft/2020-12/schema", "2020-12")


def save(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the last document of each key stays. ``new`` comes after all that is stored."""
    rank = F.row_number().over(Window.partitionBy("entity_key").orderBy(F.desc("new"), F.desc("seq")))
    both = entities.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    return both.withColumn("rank", rank).filter("rank = 1").drop("rank", "new")


def save_outcomes(entities: DataFrame, new: DataFrame) -> DataFrame:
    """seq, entity_key and outcome of a batch written in its order: Added, Unchanged (equal content) or Conflict.

    The first document of a key decides; a stored one comes first. One window over both, so no join.
    """
    both = entities.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1))).withColumn("same", jsons.content_key(F.col("content")))
    w = Window.partitionBy("entity_key").orderBy("new", "seq")
    outcome = F.when(F.row_number().over(w) == 1, "Added").when(F.first("same").over(w) == F.col("same"), "Unchanged").otherwise("Conflict")
    return both.withColumn("outcome", outcome).filter("new = 1").select("seq", "entity_key", "outcome")


def try_save(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with the documents that were Added; stored ones stay as they are."""
    added = save_outcomes(entities, new).filter("outcome = 'Added'").select("seq", "entity_key")
    return entities.unionByName(new.join(added, ["seq", "entity_key"], "left_semi"))


def commit_batches(entities: DataFrame, staged: DataFrame) -> DataFrame:
    """session, seq, entity_key, outcome: a session with any conflict publishes nothing, and all its rows conflict.

    ``staged`` has the columns of entities and session. Sessions are judged against what is stored and their own rows.
    """
    # stored documents are copied to each session that names their key
    mine = staged.select("session", "entity_key").distinct().join(entities, "entity_key").withColumn("new", F.lit(0))
    both = mine.unionByName(staged.withColumn("new", F.lit(1))).withColumn("same", jsons.content_key(F.col("content")))
    w = Window.partitionBy("session", "entity_key").orderBy("new", "seq")
    judged = both.withColumn("outcome", F.when(F.row_number().over(w) == 1, "Added").when(F.first("same").over(w) == F.col("same"), "Unchanged").otherwise("Conflict")).filter("new = 1")
    broken = judged.groupBy("session").agg(F.bool_or(F.col("outcome") == "Conflict").alias("broken"))
    return judged.join(broken, "session").select("session", "seq", "entity_key", F.when(F.col("broken"), "Conflict").otherwise(F.col("outcome")).alias("outcome"))


def commit_tokens(entities: DataFrame, staged: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publish single staged documents: (token, outcome) of each token, the entities, and what is left staged.

    Each token is judged by itself, in the order of its document's ``seq``; one that isn't staged is a Conflict. Tokens
    are used up whatever comes of them.
    """
    asked = tokens.select("token").distinct()
    mine = staged.join(asked, "token", "left_semi")
    outcomes = save_outcomes(entities, mine.select(*COLUMNS)).join(mine.select("token", "seq", "entity_key"), ["seq", "entity_key"])
    known = outcomes.select("token", "outcome")
    every = asked.join(known, "token", "left").select("token", F.coalesce("outcome", F.lit("Conflict")).alias("outcome"))
    added = mine.join(known.filter("outcome = 'Added'"), "token", "left_semi").select(*COLUMNS)
    return every, entities.unionByName(added), discard(staged, asked)


def session_snapshot(entities: DataFrame, staged: DataFrame, session: str) -> DataFrame:
    """What a session sees: stored entities, overlaid by its own staged ones."""
    own = staged.filter(F.col("session") == session).select(*COLUMNS)
    return entities.join(own.select("entity_key"), "entity_key", "left_anti").select(*COLUMNS).unionByName(own)


def discard(staged: DataFrame, tokens: DataFrame) -> DataFrame:
    return staged.join(tokens.select("token"), "token", "left_anti")


class Registry:
    """A value: each write gives a new one. Reads are plans over ``entities``."""

    def __init__(self, entities: DataFrame, staged: DataFrame | None = None):
        self.entities, self.staged = entities.select(*COLUMNS), staged

    @classmethod
    def of(cls, documents: DataFrame) -> Registry:
        return cls(entities_of(documents))

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def save(self, new: DataFrame) -> Registry:
        return Registry(save(self.entities, new), self.staged)

    def try_save(self, new: DataFrame) -> Registry:
        return Registry(try_save(self.entities, new), self.staged)

    def stage(self, new: DataFrame, session: str) -> Registry:
        """Each row gets a token of its own."""
        rows = new.select(F.expr("uuid()").alias("token"), F.lit(session).alias("session"), *COLUMNS)
        return Registry(self.entities, rows if self.staged is None else self.staged.unionByName(rows))

    def commit(self, session: str) -> Registry:
        """Publish a session whole, or nothing of it if anything conflicts; its rows then stay staged."""
        own = self.staged.filter(F.col("session") == session)
        outcomes = commit_batches(self.entities, own.select("session", *COLUMNS))
        added = own.select(*COLUMNS).join(outcomes.filter("outcome = 'Added'").select("seq", "entity_key"), ["seq", "entity_key"], "left_semi")
        broken = outcomes.filter("outcome = 'Conflict'").select("session").distinct()
        left = self.staged.filter(F.col("session") != session).unionByName(own.join(broken, "session", "left_semi").select(*self.staged.columns))
        return Registry(self.entities.unionByName(added), left)

    def visible(self, session: str | None = None) -> DataFrame:
        return self.entities if session is None or self.staged is None else session_snapshot(self.entities, self.staged, session)

    def get(self, key: str) -> DataFrame:
        """By identifier, or else by the plain id of an anonymous instance."""
        key = key.strip()
        return self.entities.filter((F.col("gts_id") == key) | (F.col("entity_key") == key)).orderBy(F.col("gts_id").isNull()).limit(1)

    def count(self) -> int:
        return self.entities.count()

    def snapshot(self, path: str) -> Registry:
        """Write this version, sorted so that scans by identifier skip row groups, and go on from the written table."""
        self.entities.repartitionByRange("entity_key").sortWithinPartitions("entity_key").write.parquet(path)
        return Registry(self.spark.read.parquet(path), self.staged)
