"""The stages on a small corpus, each against its operator's brute force, and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from samples import SCHEMA, words_of
from test_corpus import plain_classes, plain_removal

SF = "/root/testdata/sf0.001"


def corpus(spark, folder):
    rows = [(k, words_of(k, 80 + k % 40), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, words_of(k, 80 + k % 40), "en", "s0") for k in range(10)]
    rows += [(200 + k, words_of(300 + k, 60) + " " + words_of(999, 70) + " " + words_of(400 + k, 60), "en", "s1") for k in range(8)]
    rows += [(300 + k, " ".join(w.upper() + "###" for w in words_of(k, 100).split()), "en", "s2") for k in range(8)] + [(400, None, None, None), (401, "short", "en", "s1")]
    docs = spark.createDataFrame([(k, t, lang, s, len(t or ""), "c", "b", "p", "n", None) for k, t, lang, s in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(300 + k, 0, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    kept = {r["doc_id"] for r in results[0].collect()}
    assert kept >= {*range(60), *range(200, 208)} and not kept & {400, 401, *range(300, 308)}
    classes = plain_classes([(r["doc_id"], r["text"]) for r in results[0].collect()])
    assert sorted(r["doc_id"] for r in results[1].collect()) == sorted(min(map(int, c)) for c in classes)
    want = {k: n for k, _, n, _, _ in plain_removal([(r["doc_id"], r["text"]) for r in results[1].collect()])}
    before = {r["doc_id"]: len(r["text"].encode()) for r in results[1].collect()}
    assert {str(r["doc_id"]): before[r["doc_id"]] - len(r["text"].encode()) for r in results[2].collect()} == want
    assert results[2].filter(F.length("text") != F.col("n_chars")).isEmpty()
    assert results[3].select(*columns).subtract(results[2]).isEmpty()
    assert results[4].count() == results[3].count() and results[4].filter("not round_trip").isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
@pytest.mark.parametrize("name", ["op3_poisson_mixture", "op7_merkle_audit"])
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
