"""The stages of the pipeline, each on its predecessor's rows."""

import corpus_pipeline
from typeloom.llm.common import saved, table

from .test_operators import DIR, brute_components, packed_well


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(saved(stage(spark, kept[-1], DIR)))
    assert all(df.columns == columns for df in kept[:-1])
    given, good, distinct, clean, mixed, packed = kept
    assert 0 < good.count() <= given.count()
    want = brute_components([(r.doc_id, r.text) for r in good.collect()], 5)
    assert {r.doc_id for r in distinct.collect()} == {i for i, (_, top) in want.items() if i == top}
    before = {r.doc_id: r.text for r in distinct.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id])
    assert {r.doc_id for r in mixed.collect()} <= after.keys()
    rows = packed.collect()
    assert sum(r.piece == 0 for r in rows) == mixed.count()
    packed_well(rows)


def test_stages_odd(spark):
    """Nulls, empty and repeated rows, clashing columns, and an empty table pass all stages."""
    from pyspark.sql import functions as F

    given = table(spark, DIR, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "", "", 0), (-2, "x", None, None, 1), (-2, "x", None, None, 1)], given.schema)
    for docs in (given.unionByName(odd).withColumns({c: F.lit(7) for c in ("size", "copies", "found", "key", "_id")}), given.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, DIR))
            assert name == "pack" or docs.columns == columns
        docs.count()
