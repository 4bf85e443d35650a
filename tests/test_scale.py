"""What leaves a partition, and results against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import index, retrieval, scan


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def indexed(spark, docs, schema, tmp_path, *fields):
    index.build(spark.createDataFrame(docs, schema), {f: f for f in fields}, str(tmp_path / "ix"))
    return index.opened(spark, str(tmp_path / "ix"))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 12, 3)), " ".join(f"w{k}" for k in rng.zipf(1.5, 40) % 40)) for i in range(300)]
    docs += [(1000 + i, docs[3][1], docs[3][2]) for i in range(40)]  # copies
    return docs, indexed(spark, docs, "doc_id long, title string, body string", tmp_path, "title", "body")


def test_bm25_sends_only_first_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(scan, "CELLS", 50)  # many blocks
    docs, ix = corpus
    terms = [(q, f"w{k}") for q in range(6) for k in range(q, 3 * q + 3)]
    got = index.bm25(ix, spark.createDataFrame(terms, "query_id int, term string"), 7, {"title": 6.0, "body": 1.0})
    assert "MapInArrow" in plan(got) and "Join" not in plan(got)
    toks = {d: (t.split(), b.split()) for d, t, b in docs}
    mean = sum(len(t) + len(b) for t, b in toks.values()) / len(toks)
    df = {w: sum(w in t or w in b for t, b in toks.values()) for _, w in terms}
    want = set()
    for q in range(6):
        scores = {}
        for d, (t, b) in toks.items():
            for _, w in [x for x in terms if x[0] == q]:
                f = 6.0 * t.count(w) + b.count(w)
                if f:
                    idf = math.log((len(toks) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[d] = scores.get(d, 0.0) + (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(t) + len(b)) / mean))
        first = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:7]
        want |= {(q, d, k, round(scores[d], 6)) for k, d in enumerate(first, 1)}
    assert {(r.query_id, r.doc_id, r["rank"], r.score) for r in got.collect()} == want


def test_common_grams_leave_a_partition_as_few_rows(spark, corpus):
    docs, ix = corpus
    grams = spark.createDataFrame([(f"w{a} w{b}",) for a in range(8) for b in range(8)], "gram string")
    every = {(r.gram, r.doc_id) for r in index.gram_places(ix, grams).collect()}
    hold = lambda g: {d for d, *fields in docs if any(f" {g} " in f" {f} " for f in fields)}
    assert every == {(g, d) for (g,) in grams.collect() for d in hold(g)}
    parts = ix.tokens.rdd.getNumPartitions()
    few = [r.gram for r in index.gram_places(ix, grams, 2).collect()]
    assert all(few.count(g) <= 3 * parts for g in few) and {g for g in few if few.count(g) <= 2} == {g for g, _ in every if len(hold(g)) <= 2}


def test_rows_of_one_id_are_one_document_without_phrases_across(spark, tmp_path):
    ix = indexed(spark, [(1, "red shoe"), (1, "blue red"), (2, None), (None, "hat")], "doc_id long, text string", tmp_path, "text")
    assert {(r.term, r.df) for r in ix.terms.collect()} == {("red", 1), ("shoe", 1), ("blue", 1), ("hat", 1)}
    assert ix.size.first().n_docs == 3 and {(r.doc_id, r.d) for r in ix.lengths.collect()} == {(1, 4), (2, 0), (None, 1)}
    grams = spark.createDataFrame([("red shoe",), ("shoe blue",), ("red blue",), ("red red",)], "gram string")
    assert {(r.gram, r.doc_id) for r in index.gram_places(ix, grams).collect()} == {("red shoe", 1)}


def test_dense_equals_brute_force_with_ties_and_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(scan, "CELLS", 64)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(90)]
    vectors += [(200 + i, vectors[4][1]) for i in range(30)] + [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(vectors, "doc_id long, v array<float>")
    q = spark.createDataFrame([x for x in vectors if x[0] % 10 == 0], "query_id long, q array<float>")
    got = retrieval.dense(v, q, 12)
    assert "Join" not in plan(got)
    pairs = v.join(F.broadcast(q), F.col("doc_id") != F.col("query_id")).select("query_id", "doc_id", F.round(retrieval.dot(F.col("v"), F.col("q")), 6).alias("score"))
    want = retrieval.top_n(pairs, 12, F.desc("score"), F.col("doc_id"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rounding_is_that_of_spark(spark):
    x = np.array([0.0000005, 1.0000005, 2.5000015, -0.0000005, -1e-9, 12.3456785, 0.1234565, 7.0])
    want = spark.createDataFrame([(float(a),) for a in x], "x double").select(F.round("x", 6)).collect()
    assert [repr(float(a)) for a in scan.rounded(x)] == [repr(r[0] + 0.0) for r in want]


def test_all_terms_of_a_long_query_count(spark):
    q = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(60)))], "query_id int, text string")
    assert retrieval.query_terms(q, most=None).count() == 60 and retrieval.query_terms(q).count() == 40
