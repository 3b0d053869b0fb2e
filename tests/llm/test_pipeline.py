"""The pipeline stage by stage, each against what it promises on its own input."""

from collections import Counter

import corpus_pipeline as C
import duckdb
import pytest
from catalign.llm import queries


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = {}
    for name, stage in C.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        frames[name] = docs
        assert name == "packing" or docs.columns == before.columns
    texts = [r.text for r in frames["exact_dedup"].collect()]
    assert len(set(texts)) == len(texts) and set(texts) == {r.text for r in frames["language_id"].collect()}
    assert frames["language_id"].count() == 200  # all given documents have a language
    assert {r.doc_id for r in frames["near_dup"].collect()} <= {r.doc_id for r in frames["exact_dedup"].collect()}
    mixed = Counter(r.doc_id for r in frames["mixing"].collect())
    assert max(mixed.values()) <= 3
    packed = Counter(r.doc_id for r in frames["packing"].filter("piece = 0").collect())
    assert packed == mixed


def test_run_and_empty(spark, small, tmp_path):
    assert C.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, small).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
