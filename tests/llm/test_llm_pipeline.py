import os
import random

import duckdb
import pytest

import corpus_pipeline
from tallyloom.llm import decontam, queries
from tallyloom.llm.common import stored

from .test_llm_dedup import shingle_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)


def test_stages(spark):
    """Each stage on all that the one before it kept, held against its own contract."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
        if name == "ngram_jaccard_join":
            sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in docs.collect()}
            ids = sorted(sets)
            assert not any(sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
        if name == "benchmark_decontamination":
            assert decontam.find_benchmark(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
            last = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert seen[0] < 200 and seen == sorted(seen, reverse=True) and seen[-1] > 100
    assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect()) and {r["doc_id"] for r in docs.collect()} == set(last)


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    random.seed(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count(), name
        if name != "byte_bpe":
            assert out.columns == odd.columns, name
