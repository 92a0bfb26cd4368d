"""The driver's queries over its tables, by name, and the same in SQL where that can say it.

The tables hold no typed identifiers; both sides make them by the same expressions (``sources.files``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ident, jsons
from .operators import registry, relations, schemas, scopes
from .plans import evaluate, query
from .sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_EVENT = "('gts.acme.shop.events.'||event_type||'.v1~acme.shop._.e'||event_id||'.v1.0')"
_ORDER = "('gts.acme.sales.orders.order.v1.'||(o_orderkey%3)||'~acme.sales._.o'||o_orderkey||'.v1')"
_PART = "('gts.acme.sales.catalog.part.v1~acme.sales._.p'||{}||'.v1')"
_SQL_ID = ident.ID.replace("\\z", "$")
# How seven kinds of identifiers differ from valid ones, in Spark's and DuckDB's SQL alike.
_MUTATED = "CASE event_id % 7 WHEN 0 THEN {id} WHEN 1 THEN upper({id}) WHEN 2 THEN substr({id}, 5) WHEN 3 THEN replace({id}, '.v1', '.v01') WHEN 4 THEN replace({id}, '~', '.') WHEN 5 THEN replace({id}, '.v1.0', '.v4294967296') ELSE replace({id}, '.v1.0', '.v4294967295') END"


def _register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _events(spark, sf_dir) -> DataFrame:
    return files.table(spark, sf_dir, "events").withColumn("id", files.event_id())


def _orders(spark, sf_dir) -> DataFrame:
    return files.table(spark, sf_dir, "orders").withColumn("id", files.order_id())


@_register(f"SELECT event_id, m AS candidate, regexp_matches(m, '{_SQL_ID}') AS valid FROM (SELECT event_id, {_MUTATED.format(id=_EVENT)} AS m FROM events)")
def id_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _events(spark, sf_dir).select("event_id", F.expr(_MUTATED.format(id="id")).alias("candidate"))
    return m.select("event_id", "candidate", ident.is_valid(F.col("candidate")).alias("valid"))


@_register(f"""SELECT o_orderkey, n, raw, split_part(raw,'.',1) AS vendor, split_part(raw,'.',4) AS type, CAST(substr(split_part(raw,'.',5),2) AS BIGINT) AS ver_major,
 TRY_CAST(nullif(split_part(raw,'.',6),'') AS BIGINT) AS ver_minor, n=0 AS is_type FROM (SELECT o_orderkey, CAST(unnest([0,1]) AS INT) AS n, unnest(string_split(substr({_ORDER},5),'~')) AS raw FROM orders)""")
def id_parse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", F.posexplode(ident.segments(F.col("id"))).alias("n", "s"))
    return rows.select("o_orderkey", "n", "s.raw", "s.vendor", "s.type", "s.ver_major", "s.ver_minor", "s.is_type")


@_register(f"SELECT event_id, id FROM (SELECT event_id, {_EVENT} AS id FROM events) WHERE starts_with(id, 'gts.acme.shop.events.purchase.v1~')")
def id_match_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.filter(ident.matches(F.col("id"), "gts.acme.shop.events.purchase.v1~*")).select("event_id", "id")


@_register(f"SELECT o_orderkey, true AS any_minor, o_orderkey%3=1 AS one_minor FROM (SELECT o_orderkey, {_ORDER} AS id FROM orders)")
def id_match_minor_flex(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = _orders(spark, sf_dir), F.col("id")
    return o.select("o_orderkey", ident.matches(i, "gts.acme.sales.orders.order.v1~").alias("any_minor"), ident.matches_legacy(i, "gts.acme.sales.orders.order.v1.1~").alias("one_minor"))


@_register(f"""SELECT event_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab',(instr('0123456789abcdef',substr(h,17,1))-1)%4+1,1)||substr(h,18,3)||'-'||substr(h,21,12) AS uuid
 FROM (SELECT event_id, sha1(unhex('{ident.NAMESPACE}')||encode({_EVENT})) AS h FROM events)""")
def id_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", ident.uuid(F.col("id")).alias("uuid"))


@_register("SELECT o_orderkey, 'gts.acme.sales.orders.order.v1~' AS family, CAST(o_orderkey%3 AS BIGINT) AS minor, 'gts.acme.sales.orders.order.v1.'||(o_orderkey%3)||'~' AS type_id FROM orders")
def id_family_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir).select("o_orderkey", ident.type_of(F.col("id")).alias("type_id"))
    return t.select("o_orderkey", ident.family(F.col("type_id")).alias("family"), ident.last_minor(F.col("type_id")).alias("minor"), "type_id")


@_register(f"""SELECT o_orderkey, CASE WHEN o_orderkey%3=2 THEN 'k'||o_orderkey ELSE {_ORDER} END AS id, CASE o_orderkey%3 WHEN 0 THEN 'gtsId' ELSE 'id' END AS id_field,
 'gts.acme.sales.orders.order.v1.'||(o_orderkey%3)||'~' AS schema_id, CASE WHEN o_orderkey%3=2 THEN 'type' END AS schema_field, false AS is_schema FROM orders""")
def extract_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    body = F.to_json(F.struct(F.when(k == 0, F.col("id")).when(k == 1, "not an id").alias("gtsId"), F.when(k == 0, "x").when(k == 1, F.col("id")).otherwise(F.concat(F.lit("k"), "o_orderkey")).alias("id"), F.concat(F.lit("gts.acme.sales.orders.order.v1."), k, F.lit("~")).alias("type")))
    return _orders(spark, sf_dir).select("o_orderkey", jsons.extract(body).alias("x")).select("o_orderkey", "x.*")


_LINE = "('gts.acme.sales.orders.line.v1~acme.sales._.l'||l_orderkey||'_'||l_linenumber||'.v1')"


@_register(f"SELECT {_LINE} AS source_id, false AS source_is_schema, {_LINE} AS id, 'id' AS source_path FROM lineitem UNION ALL SELECT {_LINE}, false, {_PART.format('l_partkey')}, 'part' FROM lineitem")
def refs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(files.lines(spark, sf_dir))


@_register(f"SELECT {_LINE} AS source_id, false AS source_is_schema, {_PART.format('l_partkey')} AS referenced_id, 'part' AS source_path, 'MissingInstance' AS reason FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 10 <> 0)")
def broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.broken(files.lines(spark, sf_dir).unionByName(files.parts(spark, sf_dir))).filter("reason <> 'MissingTypeBinding'")


@_register(f"SELECT {_PART.format('p_partkey')} AS source_id, 'gts.acme.sales.catalog.part.v1~' AS referenced_id FROM part WHERE p_partkey % 10 <> 0")
def type_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.broken(files.parts(spark, sf_dir)).filter("reason = 'MissingTypeBinding'").select("source_id", "referenced_id")


_DRAFT = "http://json-schema.org/draft-07/schema#"


def _schema_rows(types: DataFrame) -> DataFrame:
    """Entities of the types in a table with columns key and body (a struct column of what follows ``$id`` and ``$schema``)."""
    body = F.to_json(F.struct(F.concat(F.lit("gts://"), "key").alias("$id"), F.lit(_DRAFT).alias("$schema"), F.lit("object").alias("type"), "body.*"))
    return types.select(F.xxhash64("key").alias("seq"), F.col("key").alias("entity_key"), F.col("key").alias("gts_id"), F.lit(True).alias("is_schema"), F.lit(None).cast("string").alias("schema_id"), body.alias("content"))


_BRAND = "replace(p_brand, 'Brand#', '')"


@_register(f"""SELECT e + t AS entities, t AS schemas, e AS instances FROM (SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM part WHERE p_partkey % 10 <> 0) AS e, (SELECT count(DISTINCT p_brand) FROM part) AS t)""")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = files.table(spark, sf_dir, "part").select("p_brand").distinct()
    types = brands.select(F.expr(f"'gts.acme.sales.catalog.b' || {_BRAND} || '.v1~'").alias("key"), F.struct(F.lit(True).alias("x-gts-abstract")).alias("body"))
    return relations.counts(files.events(spark, sf_dir).unionByName(files.parts(spark, sf_dir)).unionByName(_schema_rows(types)))


def _writes(spark, sf_dir) -> DataFrame:
    """Orders written under a key of their customer and status: many writes of a key, some equal."""
    key = F.concat(F.lit("gts.acme.sales.orders.order.v1~acme.sales._.c"), "o_custkey", F.lit(".v1"))
    return files.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), key.alias("entity_key"), key.alias("gts_id"), F.lit(False).alias("is_schema"), F.lit(None).cast("string").alias("schema_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("content"))


_WRITES = "SELECT o_orderkey AS seq, 'gts.acme.sales.orders.order.v1~acme.sales._.c'||o_custkey||'.v1' AS entity_key, o_orderstatus AS s FROM orders"


# urgent orders are stored already, the others are new
_STORED = f"SELECT * FROM ({_WRITES.replace(' FROM', ', o_orderpriority AS p FROM')}) WHERE p = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY seq) = 1"
_NEW = f"SELECT * FROM ({_WRITES.replace(' FROM', ', o_orderpriority AS p FROM')}) WHERE p <> '1-URGENT'"
_BOTH = f"SELECT *, 0 AS n FROM ({_STORED}) UNION ALL SELECT *, 1 FROM ({_NEW})"


def _stored_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    urgent = files.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("seq"))
    writes = _writes(spark, sf_dir)
    first = writes.join(urgent, "seq", "left_semi").select(*writes.columns)
    return registry.try_save(first.limit(0), first), writes.join(urgent, "seq", "left_anti").select(*writes.columns)


@_register(f"""SELECT seq, entity_key, outcome FROM (SELECT seq, entity_key, n, CASE WHEN row_number() OVER w = 1 THEN 'Added' WHEN first_value(s) OVER w = s THEN 'Unchanged' ELSE 'Conflict' END AS outcome
 FROM ({_BOTH}) WINDOW w AS (PARTITION BY entity_key ORDER BY n, seq)) WHERE n = 1""")
def save_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.save_outcomes(*_stored_and_new(spark, sf_dir))


@_register(f"SELECT entity_key, seq, '{{\"s\":\"'||s||'\"}}' AS content FROM ({_BOTH}) QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY n DESC, seq DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.save(*_stored_and_new(spark, sf_dir)).select("entity_key", "seq", "content")


_JUDGED = f"""SELECT 's'||(n.seq%50) AS session, n.seq AS seq, n.entity_key AS entity_key, CASE WHEN coalesce(o.s, first_value(n.s) OVER w) = n.s THEN CASE WHEN o.s IS NULL AND row_number() OVER w = 1 THEN 'Added' ELSE 'Unchanged' END ELSE 'Conflict' END AS outcome
 FROM ({_NEW}) n LEFT JOIN (SELECT entity_key AS k, s FROM ({_STORED})) o ON k = n.entity_key WINDOW w AS (PARTITION BY n.seq%50, n.entity_key ORDER BY n.seq)"""


@_register(f"SELECT session, seq, entity_key, CASE WHEN bool_or(outcome='Conflict') OVER (PARTITION BY session) THEN 'Conflict' ELSE outcome END AS outcome FROM ({_JUDGED})")
def batch_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored_and_new(spark, sf_dir)
    return registry.commit_batches(stored, new.withColumn("session", F.concat(F.lit("s"), F.col("seq") % 50)))


@_register(f"SELECT entity_key, p_partkey+0 AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'staged' ELSE 'stored' END AS origin FROM (SELECT p_partkey, {_PART.format('p_partkey')} AS entity_key FROM part) WHERE p_partkey % 10 <> 0 OR p_partkey % 3 = 0")
def session_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = files.table(spark, sf_dir, "part")
    staged = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("seq"), files.part_id().alias("entity_key"), files.part_id().alias("gts_id"), F.lit(False).alias("is_schema"), F.lit(None).cast("string").alias("schema_id"), F.lit('{"new":1}').alias("content"), F.lit("a").alias("session"))
    other = staged.withColumn("session", F.lit("b")).withColumn("content", F.lit("{}"))
    return registry.session_snapshot(files.parts(spark, sf_dir), staged.unionByName(other), "a").select("entity_key", "seq", F.when(F.col("content") == '{"new":1}', "staged").otherwise("stored").alias("origin"))


_EVENTS = f"SELECT event_id AS seq, {_EVENT} AS gts_id, user_id, value FROM events WHERE event_type = 'purchase'"


@_register(f"SELECT seq, gts_id FROM ({_EVENTS}) WHERE user_id = 7")
def query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.matching(files.events(spark, sf_dir), 'gts.acme.shop.events.*[event_type="purchase", user_id=7]').select("seq", "gts_id")


@_register(f"SELECT o_orderkey AS seq, {_ORDER} AS gts_id FROM orders WHERE o_orderkey = 1")
def query_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("seq"), F.col("id").alias("gts_id"), F.lit("{}").alias("content"))
    return query.run(o, "gts.acme.sales.orders.order.v1.1~acme.sales._.o1.v1").select("seq", "gts_id")


@_register(f"SELECT seq, gts_id FROM ({_EVENTS}) ORDER BY seq LIMIT 25")
def query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.run(files.events(spark, sf_dir), "gts.acme.shop.events.purchase.v1~*", 25).select("seq", "gts_id")


@_register("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS resolved, json_extract_string(props, '$.k') AS value FROM events")
def attr_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = files.table(spark, sf_dir, "events")
    return e.select("event_id", jsons.attribute_result(jsons.variant(F.col("props")), "k").alias("r")).select("event_id", "r.resolved", "r.value")


@_register("SELECT 'gts.acme.sales.catalog.b'||lower(replace(p_brand,'Brand#',''))||'.v1~' AS family, 'gts.acme.sales.catalog.b'||lower(replace(p_brand,'Brand#',''))||'.v1.'||a||'~' AS old, 'gts.acme.sales.catalog.b'||lower(replace(p_brand,'Brand#',''))||'.v1.'||b||'~' AS new FROM (SELECT x.p_brand, x.p_size AS a, y.p_size AS b FROM (SELECT DISTINCT p_brand, p_size FROM part) x JOIN (SELECT DISTINCT p_brand, p_size FROM part) y ON x.p_brand = y.p_brand AND x.p_size < y.p_size)")
def minor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("gts.acme.sales.catalog.b"), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(".v1."), "p_size", F.lit("~"))
    return schemas.minor_pairs(files.table(spark, sf_dir, "part").select(t.alias("gts_id")))


_EVENT_TYPE = {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["id", "user_id", "value"], "additionalProperties": False,
    "properties": {"id": {"type": "string"}, "user_id": {"type": "integer", "minimum": 5}, "value": {"type": "number", "maximum": 100}, "event_type": {"enum": ["click", "error", "purchase"]}}}


@_register(f"SELECT {_EVENT} AS entity_key, coalesce(user_id >= 5, false) AND coalesce(value <= 100, false) AND event_type IN ('click','error','purchase') AS valid FROM events")
def validate_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = files.events(spark, sf_dir)
    return e.select("entity_key", (F.size(evaluate.errors(F.col("content"), _EVENT_TYPE)) == 0).alias("valid"))


@_register("SELECT event_id, regexp_matches(t, '^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$') AS is_date, regexp_matches(t, '^[^@\\s]+@[^@\\s]+$') AS is_email FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'u'||user_id||'@example.com' ELSE event_type END AS t FROM events)")
def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    t = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("u"), "user_id", F.lit("@example.com"))).otherwise(F.col("event_type"))
    return files.table(spark, sf_dir, "events").select("event_id", evaluate.format_holds(t, "date").alias("is_date"), evaluate.format_holds(t, "email").alias("is_email"))


@_register("SELECT p_partkey, regexp_matches(p_name, '(?:[a-m]+)+ [^w]+$') AS found FROM part")
def regex_profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark, sf_dir, "part").select("p_partkey", evaluate.linear_match(F.col("p_name"), "(?:[a-m]+)+ [^w]+$").alias("found"))


@_register("SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN o_orderpriority ELSE 'none' END AS priority, NULL::VARCHAR AS dropped, o_orderstatus AS status FROM orders")
def cast_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = {"type": "object", "additionalProperties": False, "properties": {"status": {"type": "string"}, "priority": {"type": "string", "default": "none"}}}
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.lit(1).alias("extra")))
    moved = files.table(spark, sf_dir, "orders").select("o_orderkey", evaluate.cast(body, target).alias("c"))
    part = lambda k: F.get_json_object("c", f"$.{k}")
    return moved.select("o_orderkey", part("priority").alias("priority"), part("extra").alias("dropped"), part("status").alias("status"))


@_register("""SELECT o_orderkey, 'gts.acme.sales.orders.order.v1.2~' AS type_id, CASE WHEN o_orderkey%3=0 THEN 'plain text' ELSE 'gts.acme.sales.orders.status.v1.1~' END AS status, CASE WHEN o_orderkey%2=0 THEN 7 ELSE 5 END AS first_n,
 o_orderpriority AS second_text, NULL::VARCHAR AS dropped FROM orders""")
def cast_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within an object and an array: defaults, identifiers for identifiers, and what a closed version doesn't know."""
    status = "gts.acme.sales.orders.status.v1.1~"
    item = {"type": "object", "additionalProperties": False, "properties": {"n": {"default": 5}, "text": {}}}
    target = {"properties": {"type": {"const": "gts.acme.sales.orders.order.v1.2~"}, "head": {"type": "object", "additionalProperties": False, "properties": {"status": {"const": status}}}, "list": {"type": "array", "items": item}}}
    k = F.col("o_orderkey")
    head = F.struct(F.when(k % 3 == 0, "plain text").otherwise("gts.acme.sales.orders.status.v1.0~").alias("status"), F.lit(1).alias("old"))
    listed = F.array(F.struct(F.when(k % 2 == 0, 7).alias("n"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("old")), F.struct(F.lit(1).alias("n"), F.col("o_orderpriority").alias("text"), F.lit(1).alias("old")))
    body = F.to_json(F.struct(F.lit("gts.acme.sales.orders.order.v1.0~").alias("type"), head.alias("head"), listed.alias("list")))
    moved = files.table(spark, sf_dir, "orders").select("o_orderkey", evaluate.cast(body, target).alias("c"))
    part = lambda p: F.get_json_object("c", f"$.{p}")
    dropped = F.coalesce(part("head.old"), part("list[0].old"), part("list[1].old"))
    return moved.select("o_orderkey", part("type").alias("type_id"), part("head.status").alias("status"), part("list[0].n").cast("int").alias("first_n"), part("list[1].text").alias("second_text"), dropped.alias("dropped"))


_KIND = f"('gts.acme.sales.catalog.b'||{_BRAND}||'.v1~')"
_OTHER = f"(CASE p_size % 4 WHEN 0 THEN 'gts.acme.sales.catalog.b'||{_BRAND}||'.v1~x.y.*' WHEN 1 THEN 'gts.acme.sales.*' WHEN 2 THEN 'gts.acme.sales.catalog.other.v1~*' ELSE 'gts.acme.sales.catalog.b'||{_BRAND}||'.v1~acme.sales._.p'||p_partkey||'.v1' END)"


@_register(f"SELECT p_partkey, p_size % 4 IN (0, 3) AS covered FROM part")
def pattern_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = files.table(spark, sf_dir, "part").select("p_partkey", F.expr(f"{_KIND} || '*'").alias("pattern"), F.expr(_OTHER).alias("other"))
    return p.select("p_partkey", ident.covers(F.col("pattern"), F.col("other")).alias("covered"))


# types of parts: a version for each size of a brand, whose rules follow from the size
_VERSIONS = f"(SELECT DISTINCT {_BRAND} AS b, p_size AS s FROM part)"


def _versions(spark, sf_dir, key: str, body) -> DataFrame:
    sizes = files.table(spark, sf_dir, "part").select(F.expr(_BRAND).alias("b"), F.col("p_size").alias("s")).distinct()
    return sizes.select(F.expr(key).alias("key"), body.alias("body"))


def _number(minimum: str, kind=None):
    return F.struct(F.struct((F.lit("integer") if kind is None else kind).alias("type"), F.expr(minimum).alias("minimum")).alias("n")).alias("properties")


@_register(f"""SELECT old, new, f AS is_backward, g AS is_forward, f AND g AS is_full FROM (SELECT 'gts.acme.sales.catalog.b'||x.b||'.v1.'||x.s||'~' AS old, 'gts.acme.sales.catalog.b'||y.b||'.v1.'||y.s||'~' AS new,
 NOT (y.s%2=0 AND x.s%2=1) AND y.s%3 <= x.s%3 AS f, NOT (x.s%2=0 AND y.s%2=1) AND x.s%3 <= y.s%3 AS g FROM {_VERSIONS} x JOIN {_VERSIONS} y ON x.b = y.b AND x.s < y.s)""")
def evolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = F.when(F.col("s") % 2 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("required")
    types = _versions(spark, sf_dir, "'gts.acme.sales.catalog.b' || b || '.v1.' || s || '~'", F.struct(needs, _number("s % 3"), F.lit(False).alias("additionalProperties")))
    return schemas.verdicts(schemas.evolution(_schema_rows(types)))


@_register(f"SELECT 'gts.acme.sales.catalog.b'||b||'.v1~acme.sales.kind.k'||s||'.v1~' AS type_id, s%3 >= CAST(b AS INT)%3 AND s%5 <> 0 AND s%7 <> 0 AS derives FROM {_VERSIONS}")
def derivation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.lit("n")).alias("required")
    base = _versions(spark, sf_dir, "'gts.acme.sales.catalog.b' || b || '.v1~'", F.struct(one, _number("cast(b as int) % 3"))).distinct()
    needs = F.when(F.col("s") % 7 != 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("required")
    kind = F.when(F.col("s") % 5 == 0, "number").otherwise("integer")
    kids = _versions(spark, sf_dir, "'gts.acme.sales.catalog.b' || b || '.v1~acme.sales.kind.k' || s || '.v1~'", F.struct(needs, _number("s % 3", kind)))
    found = schemas.derivation(_schema_rows(base).unionByName(_schema_rows(kids)))
    return found.select("type_id", (F.size("errors") == 0).alias("derives"))


@_register(f"""SELECT 'gts.acme.sales.catalog.b'||b||'.v1~acme.sales.kind.k'||s||'.v1~' AS type_id, CASE WHEN s%2=0 THEN 0 ELSE 1 END + CASE WHEN s%5=0 THEN 1 ELSE 0 END AS n_errors FROM {_VERSIONS}
 UNION ALL SELECT DISTINCT 'gts.acme.sales.catalog.b'||b||'.v1~', 0 FROM {_VERSIONS}""")
def traits_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstract brands declare a text ``topic`` that is needed; kinds give a text, a number or nothing, and some an unknown trait."""
    text = F.struct(F.lit("string").alias("type"))
    declared = F.struct(F.lit("object").alias("type"), F.array(F.lit("topic")).alias("required"), F.struct(text.alias("topic")).alias("properties"), F.lit(False).alias("additionalProperties"))
    base = _versions(spark, sf_dir, "'gts.acme.sales.catalog.b' || b || '.v1~'", F.struct(F.lit(True).alias("x-gts-abstract"), declared.alias("x-gts-traits-schema"))).distinct()
    s = F.col("s")
    texts = F.array_compact(F.array(F.when(s % 2 == 0, F.lit('"topic":"k"')).when(s % 3 == 0, F.lit('"topic":5')), F.when(s % 5 == 0, F.lit('"other":1'))))
    given = F.parse_json(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")))
    kids = _versions(spark, sf_dir, "'gts.acme.sales.catalog.b' || b || '.v1~acme.sales.kind.k' || s || '.v1~'", F.struct(given.alias("x-gts-traits")))
    found = schemas.trait_errors(_schema_rows(base).unionByName(_schema_rows(kids)))
    return found.select("type_id", F.size("errors").alias("n_errors"))


@_register(f"""SELECT {_EVENT} AS entity_key, CASE WHEN event_type = 'error' THEN 'SchemaInvalid' WHEN event_type = 'view' THEN 'SchemaNotFound' WHEN event_type = 'signup' THEN 'AbstractType'
 WHEN coalesce(user_id < 5, false) OR coalesce(value > 100, false) THEN 'Invalid' END AS reason FROM events""")
def validate_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of stored types: one type derives from nothing that is stored, one is abstract, one isn't stored."""
    body = {"type": "object", "$schema": _DRAFT, "properties": {"user_id": {"minimum": 5}, "value": {"maximum": 100}}}
    key = "gts.acme.shop.events.{}.v1~".format
    stored = [(key(k), json.dumps(body | {"$id": f"gts://{key(k)}"} | more)) for k, more in (("click", {}), ("purchase", {}), ("signup", {"x-gts-abstract": True}), ("error", {"$ref": "https://example.com/x"}))]
    types = spark.createDataFrame([(0, k, k, True, None, c) for k, c in stored], "seq long, entity_key string, gts_id string, is_schema boolean, schema_id string, content string")
    return evaluate.validate(files.events(spark, sf_dir), types).select("entity_key", "reason")


@_register(f"SELECT event_id, m AS candidate, regexp_matches(m, '{_SQL_ID}') OR (m LIKE '%*') AS valid, m LIKE '%*' AS is_wildcard, coalesce(event_id%7=0 AND event_type='click', false) OR m = 'gts.acme.shop.*' AS matched FROM (SELECT event_id, event_type, CASE WHEN event_id % 14 = 8 THEN 'gts.acme.shop.*' ELSE {_MUTATED.format(id=_EVENT)} END AS m FROM events)")
def id_match_or_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _events(spark, sf_dir).select("event_id", F.expr(f"CASE WHEN event_id % 14 = 8 THEN 'gts.acme.shop.*' ELSE {_MUTATED.format(id='id')} END").alias("candidate"))
    d = m.select("*", ident.described(F.col("candidate")).alias("d"), ident.match_or_cover(F.col("candidate"), "gts.acme.shop.events.click.v1~*").alias("x"), ident.match_or_cover(F.col("candidate"), "gts.acme.*").alias("y"))
    return d.select("event_id", "candidate", "d.valid", "d.is_wildcard", (F.col("x.matched") & (F.col("event_id") % 7 == 0) | F.col("y.matched") & F.col("d.is_wildcard")).alias("matched"))


@_register(f"SELECT {_LINE} AS entity_key, 'part' AS path, 'x-gts-instance-ref' AS keyword, {_PART.format('l_partkey')} AS value, 'NotStored' AS reason FROM lineitem WHERE l_partkey % 10 = 0")
def ref_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = {"$id": "gts://gts.acme.sales.orders.line.v1~", "$schema": _DRAFT, "type": "object", "properties": {"part": {"type": "string", "x-gts-instance-ref": "gts.acme.sales.catalog.part.v1~*"}}}
    key = "gts.acme.sales.orders.line.v1~"
    t = spark.createDataFrame([(0, key, key, True, None, json.dumps(line))], "seq long, entity_key string, gts_id string, is_schema boolean, schema_id string, content string")
    return schemas.reference_errors(t, files.lines(spark, sf_dir).unionByName(files.parts(spark, sf_dir)))


# Scopes by the remainder of a size: two types' names, one of them, what isn't in a scope, and instances.
_SCOPES = [
    {"anyOf": [{"x-gts-type-ref": "gts.acme.*"}, {"x-gts-type-ref": "gts.port.*"}]},
    {"x-gts-type-ref": "gts.acme.sales.*"},
    {"not": {"x-gts-type-ref": "gts.acme.*"}},
    {"not": {"x-gts-type-ref": "gts.acme.sales.*"}},
    {"x-gts-instance-ref": "gts.acme.*"},
]
# Relation of each pair of them, base by row and derived by column (0 included, 1 unknown, 2 excluded).
_RELATED = "[[0,0,1,1,1],[2,0,1,1,2],[1,1,0,2,1],[1,1,0,0,1],[2,2,1,1,0]]"


@_register(f"SELECT 'gts.acme.sales.catalog.b'||x.b||'.v1.'||x.s||'~' AS base, 'gts.acme.sales.catalog.b'||y.b||'.v1.'||y.s||'~' AS derived, CAST({_RELATED}[x.s%5+1][y.s%5+1] AS INT) AS relation FROM {_VERSIONS} x JOIN {_VERSIONS} y ON x.b = y.b AND x.s < y.s")
def scope_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a version's reference scope lies within that of a lower one."""
    body = F.struct(F.parse_json(F.concat(F.lit('{"r":'), F.element_at(F.array(*(F.lit(json.dumps(x)) for x in _SCOPES)), F.col("s") % 5 + 1), F.lit("}"))).alias("properties"))
    types = _schema_rows(_versions(spark, sf_dir, "'gts.acme.sales.catalog.b' || b || '.v1.' || s || '~'", body))
    pairs = schemas.minor_pairs(types.select("gts_id")).select(F.col("old").alias("base"), F.col("new").alias("derived"))
    return scopes.relations(pairs, types)


@_register(f"SELECT {_EVENT} AS entity_key, coalesce(user_id >= 5, true) AND coalesce(value <= 100, true) AND (value IS NULL OR user_id IS NOT NULL) AS valid FROM events")
def validate_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that only branches which hold have looked at: a value beyond its bound leaves its member unevaluated."""
    schema = {"$schema": "https://json-schema.org/draft/2020-12/schema", "properties": {"id": {}, "event_type": {}}, "unevaluatedProperties": False, "dependentSchemas": {"value": {"required": ["user_id"]}},
        "anyOf": [{"properties": {"user_id": {"$ref": "#least"}}}, {"properties": {"value": {"maximum": 100}}}], "$defs": {"l": {"$anchor": "least", "minimum": 5}}}
    e = files.events(spark, sf_dir)
    return e.select("entity_key", (F.size(evaluate.errors(F.col("content"), schema)) == 0).alias("valid"))


_PICKED = "CASE p_size % 5 WHEN 0 THEN 'gts.acme.*' WHEN 1 THEN 'gts.acme.sales.orders.order.v1.'||(p_partkey%3)||'~*' WHEN 2 THEN 'gts.acme.sales.orders.order.v1~acme.sales._.*' WHEN 3 THEN 'gts.acme.shop.*' ELSE 'gts.acme.sales.orders.order.v1.1~acme.sales._.o'||p_partkey||'.v1' END"


@_register(f"""SELECT pattern, count(*) AS selected FROM (SELECT DISTINCT {_PICKED} AS pattern FROM part) JOIN (SELECT {_ORDER} AS id FROM orders)
 ON pattern = id OR pattern = 'gts.acme.*' OR pattern = 'gts.acme.sales.orders.order.v1~acme.sales._.*' OR (pattern LIKE '%~*' AND starts_with(id, substr(pattern, 1, length(pattern) - 1))) GROUP BY pattern""")
def pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each pattern selects: patterns of all breadths in a table, joined by the names that they fix."""
    p = files.table(spark, sf_dir, "part").select(F.expr(_PICKED).alias("pattern")).distinct()
    return relations.selected(p, _orders(spark, sf_dir).select("id")).groupBy("pattern").agg(F.count("*").alias("selected"))
