"""Publishing a session's staged documents: judged against what the session sees, and made visible whole.

Conflicts are told first; types are then admitted to a fix-point, for one that falls can take others with it, and
instances judged beside the types that stay. Versions of a registry are folders: one is there when Spark's committer has
written its last file, so readers never see half of a publication, and of two writers of a version one fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import evaluate
from ..plans.lineage import cut
from . import registry, schemas


def publication(stored: DataFrame, staged: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """(seq, entity_key, outcome, error) of each of the session's documents, and the entities that publishing gives.

    Outcomes: Added, Unchanged, Conflict, or Invalid with what was found first. A document of another session counts
    as little as one that isn't there.
    """
    own = cut(staged.filter(F.col("session") == session).select(*registry.COLUMNS))
    saved = cut(registry.save_outcomes(stored, own))
    fresh = own.join(saved.filter("outcome = 'Added'").select("seq", "entity_key"), ["seq", "entity_key"], "left_semi").select(*registry.COLUMNS)
    known = stored.filter("is_schema").select(*registry.COLUMNS)
    kept = schemas.admitted(fresh.filter("is_schema"), known)
    types = cut(known.unionByName(kept))
    instances = fresh.filter("NOT is_schema")
    verdicts = cut(evaluate.validate(instances.unionByName(stored.filter("NOT is_schema").select(*registry.COLUMNS)), types).select("entity_key", "reason", F.get("errors", F.lit(0)).alias("error")))
    wrong = verdicts.filter("reason IS NOT NULL").select("entity_key", F.concat_ws(": ", "reason", "error").alias("error"))
    # why a type fell: beside all that was staged, or else with what fell before it
    fallen = fresh.filter("is_schema").join(kept.select("entity_key"), "entity_key", "left_anti")
    report = schemas.type_report(known.unionByName(fresh.filter("is_schema"))).filter("error IS NOT NULL")
    why = fallen.select("entity_key").join(report.select(F.col("type_id").alias("entity_key"), F.concat_ws(": ", "stage", "error").alias("found")), "entity_key", "left")
    refused = cut(why.select("entity_key", F.coalesce("found", F.lit("it needs a type that was refused")).alias("error")).unionByName(instances.select("entity_key").join(wrong, "entity_key")).groupBy("entity_key").agg(F.min("error").alias("error")))
    outcomes = saved.join(refused, "entity_key", "left").select("seq", "entity_key", F.when(F.col("error").isNotNull() & (F.col("outcome") == "Added"), "Invalid").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("outcome") == "Added", F.col("error")).alias("error"))
    added = fresh.join(refused, "entity_key", "left_anti").select(*registry.COLUMNS)
    return outcomes, stored.select(*registry.COLUMNS).unionByName(added)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there whole, by the committer's mark."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(f.getPath().getParent().getName().removeprefix("v=")) for f in found or [])


def current(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and entities of the newest whole version; 0 and None where there is none."""
    found = _versions(spark, path)
    return (found[-1], spark.read.parquet(f"{path}/v={found[-1]}")) if found else (0, None)


def write(entities: DataFrame, path: str, after: int) -> int:
    """Write the version that follows ``after``, sorted so that scans by identifier skip row groups. It fails if it is there."""
    entities.repartitionByRange("entity_key").sortWithinPartitions("entity_key").write.mode("error").parquet(f"{path}/v={after + 1}")
    return after + 1
