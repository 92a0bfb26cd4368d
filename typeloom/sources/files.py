"""Documents from JSON files, and the driver's tables as typed documents."""

from __future__ import annotations

import json
import os
import re
import tempfile
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# File endings that are read, folders that are not.
ENDINGS = ("json", "jsonc", "gts")
SKIPPED = ("node_modules", "dist", "build")


def roots(paths: str) -> list[str]:
    """A comma-separated list of files and folders; ``~/`` is the home folder."""
    return [os.path.expanduser(p.strip()) for p in paths.split(",") if p.strip()]


def config(text: str | None) -> dict[str, list[str]]:
    """entity_id_fields and schema_id_fields of a JSON text; nothing for what can't be read."""
    try:
        found = json.loads(text or "")
        return {k: found[k] for k in ("entity_id_fields", "schema_id_fields") if isinstance(found.get(k), list)}
    except (ValueError, AttributeError):
        return {}


@F.pandas_udf(ArrayType(StringType()))
def _objects(texts: pd.Series) -> pd.Series:
    """The objects of a file that is one or an array of them; comments and trailing commas are passed over, ``$$`` at the start of keys is ``$``."""
    def plain(x):
        if isinstance(x, dict):
            return {k[1:] if k.startswith("$$") else k: plain(y) for k, y in x.items()}
        return [plain(y) for y in x] if isinstance(x, list) else x

    def read(text: str) -> list[str]:
        strings = r'("(?:[^"\\]|\\.)*")'
        text = re.sub(strings + r"|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
        text = re.sub(strings + r"|,(?=\s*[}\]])", lambda m: m[1] or "", text)
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            return []
        return [json.dumps(plain(x), ensure_ascii=False) for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]

    return texts.map(read)


def json_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """seq, content, path of the objects in all JSON files below the paths. Files that can't be read as JSON give none.

    ``seq`` grows by path and place in the file; ranks are counted per file, so files are never gathered in one task.
    """
    files = spark.read.option("recursiveFileLookup", True).text(roots(paths) if isinstance(paths, str) else paths, wholetext=True)
    path = F.col("_metadata.file_path")
    wanted = F.lower(path).rlike(rf"\.({'|'.join(ENDINGS)})\z") & ~path.rlike(rf"/({'|'.join(SKIPPED)})/")
    each = files.select(path.alias("path"), "value").filter(wanted).select("path", F.posexplode(_objects("value")).alias("at", "content"))
    sizes = each.groupBy("path").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)))
    return each.join(before, "path").select((F.coalesce("before", F.lit(0)) + F.col("at")).alias("seq"), "content", "path")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context: Python workers may start where it isn't."""
    sc = spark.sparkContext
    if not any(f.rpartition("/")[2] == "typeloom.zip" for f in sc.listFiles):
        root, folder = Path(__file__).resolve().parents[2], tempfile.mkdtemp(prefix="typeloom-")
        with zipfile.ZipFile(f"{folder}/typeloom.zip", "w") as packed:
            for f in sorted((root / "typeloom").rglob("*.py")):
                packed.write(f, f.relative_to(root))
        sc.addPyFile(f"{folder}/typeloom.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_id() -> Column:
    return F.concat(F.lit("gts.acme.shop.events."), "event_type", F.lit(".v1~acme.shop._.e"), "event_id", F.lit(".v1.0"))


def order_id(key: str = "o_orderkey") -> Column:
    return F.concat(F.lit("gts.acme.sales.orders.order.v1."), F.col(key) % 3, F.lit("~acme.sales._.o"), key, F.lit(".v1"))


def part_id(key: str = "p_partkey") -> Column:
    return F.concat(F.lit("gts.acme.sales.catalog.part.v1~acme.sales._.p"), key, F.lit(".v1"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entities: the attributes user_id, event_type and value, and props as they are."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(event_id().alias("id"), "user_id", "event_type", "value"))
    return e.select(F.col("event_id").alias("seq"), event_id().alias("entity_key"), event_id().alias("gts_id"), F.lit(False).alias("is_schema"), F.concat(F.lit("gts.acme.shop.events."), "event_type", F.lit(".v1~")).alias("schema_id"), body.alias("content"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the parts, so that some references lead nowhere."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0")
    return p.select(F.col("p_partkey").alias("seq"), part_id().alias("entity_key"), part_id().alias("gts_id"), F.lit(False).alias("is_schema"), F.lit("gts.acme.sales.catalog.part.v1~").alias("schema_id"), F.to_json(F.struct(part_id().alias("id"), "p_name", "p_size")).alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as instances that refer to a part."""
    own = F.concat(F.lit("gts.acme.sales.orders.line.v1~acme.sales._.l"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit(".v1"))
    rows = table(spark, sf_dir, "lineitem")
    body = F.to_json(F.struct(own.alias("id"), part_id("l_partkey").alias("part")))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), own.alias("entity_key"), own.alias("gts_id"), F.lit(False).alias("is_schema"), F.lit("gts.acme.sales.orders.line.v1~").alias("schema_id"), body.alias("content"))
