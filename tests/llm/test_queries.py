"""Registered queries and the pipeline over the smallest tables, against their SQL or other operators' brute force."""

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from fitloom.llm import bpe, decontaminate, simhash
from fitloom.llm.common import table
from fitloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_answers_every_document(spark, name):
    n = QUERIES[name](spark, SF).count()
    assert n == table(spark, SF, "documents").count() or name == "op6_secret_forest" and n > 0


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, SF).cache()
        assert after.columns == columns and after.count() <= seen.count(), name
        if name == "near_copies":
            fps = {r["doc_id"]: simhash.fingerprint(r["text"], 4) for r in seen.collect()}
            kept = {r["doc_id"] for r in after.collect()}
            assert all(any((fps[i] ^ fps[j]).bit_count() <= 4 and j < i for j in fps) for i in set(fps) - kept)
            assert not any((fps[i] ^ fps[j]).bit_count() <= 4 for i in kept for j in kept if i < j)
        if name == "benchmark":
            assert not decontaminate.decontaminate(after, table(spark, SF, "benchmark")).where("contaminated").count()
        if name == "secrets":
            before = {r["doc_id"]: r["text"] for r in seen.collect()}
            assert after.count() == len(before) and all(r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"] for r in after.collect())
        seen = after
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in seen.collect()}
    worker = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert all(worker.encode([texts[r["doc_id"]]])[0][1] == r["n_tokens"] for r in last.limit(20).collect())
    assert corpus_pipeline.run(spark, SF).count() == last.count()
