"""Publishing a session: conflicts, types to a fix-point, instances beside them, and versions that are seen whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from typeloom.operators import publish, registry

D7 = "http://json-schema.org/draft-07/schema#"
A, B, C = "gts.lab.kit.set.a.v1~", "gts.lab.kit.set.b.v1~", "gts.lab.kit.set.c.v1~"


def entities(spark, *docs, first=0):
    return registry.entities_of(spark.createDataFrame([(first + i, json.dumps(d)) for i, d in enumerate(docs)], "seq long, content string"))


def schema(key, **more):
    return {"$id": f"gts://{key}", "$schema": D7} | more


def test_publication(spark, tmp_path):
    stored = entities(spark, schema(A, required=["n"]), {"id": A + "x.y._.i.v1", "n": 1})
    mine = entities(
        spark, schema(B, allOf=[{"$ref": f"gts://{A}"}]), schema(C, minLength=-1), schema(C + "x.y.z.d.v1~"), {"id": A + "x.y._.j.v1", "n": 2}, {"id": A + "x.y._.k.v1"}, {"id": C + "x.y._.l.v1"},
        {"id": A + "x.y._.i.v1", "n": 1}, {"id": A + "x.y._.i.v1", "n": 9}, {"id": B + "x.y._.m.v1", "n": 3}, first=10,
    )
    other = entities(spark, schema("gts.lab.kit.set.o.v1~"), first=50)
    staged = mine.withColumn("session", F.lit("me")).unionByName(other.withColumn("session", F.lit("you")))
    outcomes, after = publish.publication(stored, staged, "me")
    got = {r.seq: (r.outcome, r.error) for r in outcomes.collect()}
    assert {s: o for s, (o, _) in got.items()} == {10: "Added", 11: "Invalid", 12: "Invalid", 13: "Added", 14: "Invalid", 15: "Invalid", 16: "Unchanged", 17: "Conflict", 18: "Added"}
    assert got[11][1].startswith("Schema: ") and got[14][1].startswith("Invalid: ") and got[15][1].startswith("SchemaNotFound") and got[12][1] and got[10][1] is None
    assert {r.entity_key for r in after.collect()} == {A, A + "x.y._.i.v1", B, A + "x.y._.j.v1", B + "x.y._.m.v1"}

    path = str(tmp_path / "versions")
    assert publish.current(spark, path) == (0, None)
    assert publish.write(stored, path, 0) == 1 and publish.write(after, path, 1) == 2
    n, seen = publish.current(spark, path)
    assert n == 2 and seen.count() == 5 and sorted(seen.columns) == sorted(stored.columns)
    with pytest.raises(Exception, match="already exists"):
        publish.write(stored, path, 1)
    (tmp_path / "versions" / "v=3").mkdir()  # a writer that didn't end
    assert publish.current(spark, path)[0] == 2
