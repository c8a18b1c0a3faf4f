"""The pipeline's stages, one after another, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for at, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        counts.append(docs.count())
        if at < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and docs.where("length > 4096").count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names and no row at all: columns and values of others stay."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (7, None, "en", "web", None), (8, "x" * 100_000, None, None, 100_000)], docs.schema)
    names = ("key", "kept", "log_weight", "size", "target", "taken", "draws", "shard", "place", "mark", "component", "redacted", "ids", "k0", "c0")
    odd = docs.unionByName(odd).unionByName(docs.limit(20)).select("*", *[F.lit("mine").alias(c) for c in names])
    for table in (odd, odd.limit(0)):
        now = table
        for at, (_, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{at}-{table is odd}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            if at < len(P.STAGES) - 1:
                assert now.columns == odd.columns and now.where(" or ".join(f"{c} <> 'mine'" for c in names)).count() == 0
        assert (now.count() > 0) == (table is odd)


def test_simhash_decides_what_near_copies_are_compared(spark, monkeypatch):
    """The stage's candidates are those of its SimHashes and no others: without a link of theirs, every distinct text stays."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_000 + i, " ".join(f"w{j}" for j in range(200 + i)), "en", "s", 1) for i in range(2)], docs.schema)
    docs = docs.unionByName(extra)
    kept = {r.doc_id for r in P.near_copies(spark, docs, SF).select("doc_id").collect()}
    assert 10_000 in kept and 10_001 not in kept
    monkeypatch.setattr(P.simhash, "wide_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    assert P.near_copies(spark, docs, SF).count() == docs.select("text").fillna("").distinct().count()


def test_names(spark):
    import __spark_entry__ as E

    found = E.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
    assert set(E.oracle_sql()) <= set(found)
