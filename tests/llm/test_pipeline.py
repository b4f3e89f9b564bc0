"""The pipeline's stages against plain versions of what each must keep."""

import re

import corpus_pipeline
from payspark.llm import queries
from test_decontaminate import brute as brute_hits
from test_near_copies import brute_groups

DOCUMENTS = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{DOCUMENTS}/documents.parquet")
    before, rows = docs.count(), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.saved(stage(spark, docs, DOCUMENTS))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = {r.doc_id: r for r in after.collect()}
        old = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(old) and len(rows) == after.count()
        if name != "personal data":
            assert all(rows[k] == old[k] for k in rows)
        else:
            assert set(rows) == set(old)
            mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
            assert not any(mail.search(r.text) for r in rows.values()) and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "simhash near-dedup":
            ids = sorted(old)
            assert set(rows) == {ids[min(g)] for g in brute_groups([old[k].text for k in ids])}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DOCUMENTS}/benchmark.parquet").collect()]
            hit = [w[4] for w in brute_hits([old[k].text for k in sorted(old)], items)]
            assert set(rows) == {k for k, h in zip(sorted(old), hit) if not h}
        docs = after
    assert 0 < len(rows) < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DOCUMENTS).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert all(len(r.ids) == r.length for r in packed)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, DOCUMENTS).collect())


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, null ids, further columns with the stages' own names, empty tables."""
    from pyspark.sql import functions as F

    names = ["row", "key", "kept", "result", "result_", "text_", "ids", "score", "label", "idx"]
    base = spark.read.parquet(f"{DOCUMENTS}/documents.parquet")
    first = base.where("doc_id < 60")
    odd = first.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(first.limit(2)).unionByName(first.limit(2).withColumn("text", F.lit(None).cast("string")))
    odd = odd.unionByName(first.limit(1).withColumns({"doc_id": F.lit(900_001).cast("long"), "text": F.lit("")}))
    odd = odd.unionByName(first.limit(1).withColumns({"doc_id": F.lit(900_002).cast("long"), "text": F.repeat(F.lit("a long line of plain words here\n"), F.lit(60_000))}))
    whole = first.unionByName(odd).withColumns({n: F.lit(n) for n in names})
    for rows, sub in ((whole, "odd"), (whole.limit(0), "empty")):
        folder = str(tmp_path / sub)
        rows.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            own = spark.read.parquet(f"{DOCUMENTS}/{table}.parquet")
            (own if sub == "odd" else own.limit(0)).write.parquet(f"{folder}/{table}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.saved(stage(spark, docs, folder))
            assert docs.columns == rows.columns
        packed = corpus_pipeline.run(spark, folder)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() and (sub == "odd") == (packed.count() > 0)


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
