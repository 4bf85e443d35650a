"""Traps and edge cases of single operators."""

import sqlite3
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions import extract as ex
from brindle.functions import text as tx
from brindle.operators import detectors, index, metrics, policy, retrieval, sessions
from brindle.plans.analytics import chat_turns


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("$80", "<=80"), ("around 45.50 bucks", "<=45.5"), ("thirty-five dollars", "<=35"), ("three hundred usd", "<=300"),
        ("hundred dollars", "<=100"), ("no more than $20", "<=20"), ("more than $20", ">=20"), ("$20 or more than that", "<=20"),
        ("AT LEAST 15 DOLLARS", ">=15"), ("size 80", None), ("", None), ("nothing over 1234.5 usd", "<=1234.5"), ("upwards of nineteen bucks", ">=19"),
    ],
)
def test_budget(spark, text, want):
    assert one(spark, text, ex.budget) == want


@pytest.mark.parametrize("text, want", [("embroidered necklace", None), ("Sterling Silver ring", "sterling silver"), ("metal and cotton", "cotton"), ("", None)])
def test_catalog_material(spark, text, want):
    from brindle.functions import vocab

    assert one(spark, text, lambda c: ex.vocab_value(c, vocab.CATALOG_MATERIALS)) == want


@pytest.mark.parametrize(
    "text, want",
    [("Never mind, boots", True), ("I would never mind boots", False), ("ok; scratch that", True), ("Let's start over", True), ("", False), ("ignore the hat", True), ("please ignore it", False)],
)
def test_override(spark, text, want):
    assert one(spark, text, ex.override_cue) is want


def test_short_token_lists_have_no_grams(spark):
    assert one(spark, "one", lambda c: tx.grams(tx.phrase_tokens(c), 2)) == []
    assert one(spark, "a b c", lambda c: tx.grams(tx.phrase_tokens(c), 2)) == ["a b", "b c"]
    assert one(spark, "the of", lambda c: tx.query_grams(tx.phrase_tokens(c))) == []


def test_built_query_has_a_limit(spark):
    row = spark.createDataFrame([("first", ["aaaa", "bbbb"])], "f string, r array<string>")
    assert row.select(tx.built_query(F.col("f"), F.col("r"), 10)).first()[0] == "first aaaa"
    assert row.select(tx.built_query(F.col("f"), F.col("r"), 8)).first()[0] == "first aa"
    assert row.select(tx.built_query(F.col("f"), F.col("r"), 2000)).first()[0] == "first aaaa bbbb"
    assert row.select(tx.retracted(F.lit("Red shoe, red hat, redder"), F.lit("red"))).first()[0] == "shoe, hat, redder"


def test_flat_fields(spark):
    row = spark.createDataFrame([({"a": "1", "b": ""}, ["x", None, ""], None)], "m map<string,string>, l array<string>, s string")
    kinds = {f.name: f.dataType for f in row.schema}
    assert row.select(tx.flat_values(F.col("m"), kinds["m"])).first()[0] == ["a: 1"]
    assert row.select(tx.flat_values(F.col("l"), kinds["l"])).first()[0] == ["x"]
    assert row.select(tx.flat(F.col("s"), kinds["s"])).first()[0] == ""


def indexed(spark, docs, schema, tmp_path, *fields):
    index.build(spark.createDataFrame(docs, schema), {f: f for f in fields}, str(tmp_path / "ix"))
    return index.opened(spark, str(tmp_path / "ix"))


def test_bm25_and_phrases_match_the_full_text_engine(spark, tmp_path):
    docs = [(1, "red shoe", "a comfortable red shoe for running"), (2, "blue shoe", "shoe shoe shoe"), (3, "hat", "plain hat"), (4, "scarf", "red wool"), (5, "boot", "running boot"), (6, "sock", "wool sock")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE p USING fts5(id UNINDEXED, title, body)")
    db.executemany("INSERT INTO p VALUES (?, ?, ?)", docs)
    want = db.execute("SELECT id, -bm25(p, 0, 6.0, 1.0) FROM p WHERE p MATCH 'red OR running' ORDER BY 2 DESC").fetchall()
    terms = spark.createDataFrame([(9, "red"), (9, "running")], "query_id int, term string")
    ix = indexed(spark, docs, "doc_id int, title string, body string", tmp_path, "title", "body")
    got = index.bm25(ix, terms, 10, {"title": 6.0, "body": 1.0}).orderBy("rank").collect()
    assert {r.doc_id for r in got} == {int(i) for i, _ in want}
    for i, score in want:
        assert abs(next(r.score for r in got if r.doc_id == int(i)) - score) < 1e-5
    grams = [("red shoe",), ("shoe shoe",), ("shoe shoe shoe",), ("shoe red",), ("a comfortable red shoe",), ("shoe a",), ("wool",), ("no such",)]
    have = {(r.gram, r.doc_id) for r in index.gram_places(ix, spark.createDataFrame(grams, "gram string")).collect()}
    assert have == {(g, int(i)) for (g,) in grams for (i,) in db.execute("SELECT id FROM p WHERE p MATCH ?", (f'"{g}"',))}


def test_a_grid_of_field_weights_equals_each_setting(spark, tmp_path):
    docs = [(i, f"t{i % 3} red", " ".join(f"w{j % (i + 2)}" for j in range(9)) + " red t1") for i in range(12)]
    ix = indexed(spark, docs, "doc_id int, title string, body string", tmp_path, "title", "body")
    terms = spark.createDataFrame([(1, "t1"), (1, "w3"), (2, "red")], "query_id int, term string")
    grid = spark.createDataFrame([(0, [6.0, 1.0]), (1, [0.0, 2.0])], "setting int, weights array<double>")
    got = index.bm25_grid(ix, terms, 5, grid)
    for k, w in ((0, {"title": 6.0, "body": 1.0}), (1, {"title": 0.0, "body": 2.0})):
        assert sorted(map(tuple, got.where(f"setting = {k}").drop("setting").collect())) == sorted(map(tuple, index.bm25(ix, terms, 5, w).collect()))


def test_contained_passages(spark, tmp_path):
    docs = [(1, "xalpha beta gamma delta"), (2, "alpha beta gamma"), (3, "Alpha beta gamma."), (4, "beta"), (5, None), (6, "alpha  beta gamma")]
    table = spark.createDataFrame(docs, "doc_id int, text string")
    ix = indexed(spark, docs, "doc_id int, text string", tmp_path, "text")
    passages = [(1, "alpha beta gamma"), (2, "beta"), (3, ""), (4, None), (5, "no such words here"), (6, "lpha beta gamma d")]
    got = {(r.query_id, r.doc_id) for r in index.containing(ix, table, spark.createDataFrame(passages, "query_id int, passage string")).collect()}
    assert got == {(q, d) for q, p in passages for d, t in docs if p is not None and t is not None and p in t}


def test_an_index_is_kept_and_guarded(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    make = lambda df: df
    spark.createDataFrame([(1, "red")], "doc_id int, text string").write.parquet(path)
    first = index.kept(spark.read.parquet(path), make, {"text": "text"}, "t")
    assert index.kept(spark.read.parquet(path), make, {"text": "text"}, "t").postings.inputFiles() == first.postings.inputFiles()
    spark.createDataFrame([(1, "red"), (2, "blue")], "doc_id int, text string").write.mode("overwrite").parquet(path)
    again = index.kept(spark.read.parquet(path), make, {"text": "text"}, "t")
    assert again.size.first().n_docs == 2 and again.postings.inputFiles() != first.postings.inputFiles()
    index.build(spark.read.parquet(path).limit(0), {"text": "text"}, str(tmp_path / "none"), "x")
    assert index.opened(spark, str(tmp_path / "none"), "x").postings.count() == 0
    with pytest.raises(ValueError):
        index.opened(spark, str(tmp_path / "none"), "y")


def test_a_field_of_weight_zero_still_matches(spark, tmp_path):
    ix = indexed(spark, [(1, "x", "hat"), (2, "y", "boot")], "doc_id int, title string, store string", tmp_path, "title", "store")
    terms = spark.createDataFrame([(1, "hat")], "query_id int, term string")
    got = index.bm25(ix, terms, 5, {"title": 6.0, "store": 0.0}).collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 0.0)]


def test_zero_weight_leg_changes_nothing(spark):
    legs = spark.createDataFrame([(1, 10, 0, 1), (1, 11, 0, 2), (1, 12, 1, 1)], "query_id int, doc_id int, leg int, rank int")
    with_zero = retrieval.fused(legs, [1.0, 0.0]).orderBy("rank").collect()
    alone = retrieval.fused(legs.where("leg = 0"), [1.0]).orderBy("rank").collect()
    assert with_zero == alone


def test_rerank_failure_keeps_the_order(spark):
    rows = spark.createDataFrame([(1, d, d, "q", "t") for d in range(1, 6)], "query_id int, doc_id int, rank int, query string, document string")

    def broken(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None] * len(q), dtype=float)

    def raising(q: pd.Series, d: pd.Series) -> pd.Series:
        raise OSError("no model")

    for scorer in (broken, raising):
        assert [r.doc_id for r in retrieval.reranked(rows, scorer).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_rows_beyond_the_window_keep_their_order(spark):
    """Nothing of a long list is lost, and only its head moves."""
    rows = [(1, d, d, [1.0, 0.0] if d % 2 else [0.0, 1.0], -1e9) for d in range(1, 601)] + [(2, d, d, [1.0, 0.0], -1e9) for d in range(1, 6)]
    got = retrieval.diversified(spark.createDataFrame(rows, "query_id long, doc_id long, rank int, vector array<double>, repel double"), 10, 0.5).orderBy("query_id", "rank").collect()
    mine = [r.doc_id for r in got if r.query_id == 1]
    assert sorted(mine) == list(range(1, 601)) and mine[40:] == list(range(41, 601)) and mine[:3] == [1, 2, 3]
    assert [r.doc_id for r in got if r.query_id == 2] == [1, 2, 3, 4, 5]


def test_dense_in_blocks(spark, monkeypatch):
    v = [(i, [float((i * 7 + j * 3) % 11) for j in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(v, "doc_id long, v array<double>")
    queries = vectors.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, retrieval.dense(vectors, queries, 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 9)
    assert sorted(map(tuple, retrieval.dense(vectors, queries, 3).collect())) == whole and len(whole) == 180


def test_entropy_edges(spark):
    rows = [("const", "c", v) for v in "aaaa"] + [("half", "c", v) for v in "aabb"] + [("null", "c", v) for v in (None, None, "a", "a")] + [("one", "c", "a")]
    got = {r.pool: r.entropy for r in policy.pool_entropy(spark.createDataFrame(rows, "pool string, attribute string, value string")).collect()}
    assert got == {"const": 0.0, "half": 1.0, "null": 1.0, "one": 0.0}


def test_routing(spark):
    row = spark.range(1).select(policy.routing(F.lit("browsing"), F.lit(True)).alias("r")).first().r
    assert (row.bm25, row.trade, row.repel, row.diversify) == (1.25, 0.35, True, True)


def test_empty_sessions_report(spark):
    empty = spark.createDataFrame([], "scenario string, hit_turn int, hit_rank int")
    (row,) = metrics.session_report(empty).collect()
    assert (row.scenario, row.n, row.hit_rate, row.mrr, row.mttc, row.efficiency, row.score) == (None, 0, 0.0, 0.0, None, 0.0, 0.0)


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 10.0], [5.0], [2.0, 2.0, 2.0, 7.0, 7.0], [float(i * i % 101) for i in range(333)], [float(i) for i in range(20)]])
def test_latency_and_quartiles_follow_the_sorted_values(spark, values):
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in metrics.latency(rows, "v", "k").collect()}
    s, n = sorted(values), len(values)
    assert got["a"].p50 == round(statistics.median(s), 1) and got["a"].max == max(s) and got["a"].n == n
    assert got["a"].p95 == round(s[int(n * 0.95) - 1] if n >= 20 else s[-1], 1) and got["b"].p50 == 1.0
    cut = metrics.quartile_cuts(rows.where("k = 'a'"), "v").first()
    assert (cut.q1, cut.q2, cut.q3) == (s[n // 4], s[n // 2], s[3 * n // 4])
    assert metrics.upper_median(rows.where("k = 'a'"), "v", "k").first().upper_median == s[n // 2]


@pytest.mark.parametrize("text, want", [("size 9w", True), ("us 10x", True), ("US 9.5", True), ("xxl fit", True), ("xxlarge", False), ("smaller", False), ("12 inches", True), ("12 inchesx", False), ("oversize 9", False)])
def test_sizes(spark, text, want):
    assert ("size" in one(spark, text, ex.detected_attributes)) is want


def test_fold_equals_its_native_twin(spark, sf):
    signals = sessions.turn_signals(chat_turns(spark, sf)).cache()
    key = lambda df: sorted(map(tuple, df.select("session", "turn", "segment", "boundary", "color", "material", "budget", "informative").collect()))
    assert key(sessions.fold(signals)) == key(sessions.fold_native(signals))


def told(text, turn=1, override=False, contentless=False, defer=False, categories=(), **slots):
    return {"text": text, "turn": turn, "override": override, "contentless": contentless, "defer": defer, "categories": list(categories), **{k: slots.get(k) for k in sessions.SLOTS}}


def test_an_override_keeps_the_query_unless_it_names_a_new_category():
    state = sessions.step(sessions.fresh(), told("shoes please", categories=["shoes"], color="red"))
    state = sessions.step(state, told("leather ones", 2, material="leather"))
    same = sessions.step(state, told("never mind, white shoes", 3, override=True, categories=["shoes"], color="white"))
    assert same["first"]["text"] == "shoes please" and [m["text"] for m in same["recent"]] == ["leather ones", "never mind, white shoes"]
    assert same["slots"] == {"color": "white"} and same["segment"] == 1 and same["informative"] == ["never mind, white shoes"]
    other = sessions.step(state, told("forget that, hats", 3, override=True, categories=["hats"]))
    assert other["first"]["text"] == "forget that, hats" and [m["text"] for m in other["recent"]] == ["forget that, hats"] and other["slots"] == {}


def test_a_scoped_override_retracts_only_what_it_replaces():
    state = sessions.step(sessions.fresh(), told("red leather shoes", categories=["shoes"], color="red", material="leather"))
    state = sessions.step(state, told("never mind, blue", 2, override=True, color="blue"), scoped=True)
    assert state["slots"] == {"material": "leather", "color": "blue"} and state["retracted"] == ["red"] and state["segment"] == 0
    assert sessions.view(state, 1, 2)["query"] == "leather shoes never mind, blue"
    state = sessions.step(state, told("red after all", 3, color="red"), scoped=True)
    assert state["retracted"] == [] and state["slots"]["color"] == "red"


def test_boundary_needs_a_contentless_hand_back_and_contentless_turns_are_no_query():
    state = sessions.step(sessions.fresh(), told("shoes"))
    assert not sessions.step(state, told("up to you but black", 2, defer=True))["boundary"]
    after = sessions.step(state, told("up to you", 2, contentless=True, defer=True))
    assert after["boundary"] and after["recent"] == [] and sessions.view(after, 1, 2)["query"] == "shoes"


def test_simulated_customers_are_read_as_they_are_meant(spark):
    """The customer's fixed phrases are what the cue classifiers recognise."""
    rows = [(1, "boundary", "hat", ["cotton"], []), (2, "intent_override", "hat", ["cotton", "size 4"], ["color: red"])]
    c = spark.createDataFrame(rows, "session long, kind string, category string, hard array<string>, soft array<string>")
    log = sessions.simulate(c, ["material", "material", "material", "material"], turn_of=F.lit(3))
    got = {(r.session, r.turn): r for r in log.select("*", ex.reply_class(F.col("message")).alias("reply"), ex.defer_cue(F.col("message")).alias("defer"), ex.override_cue(F.col("message")).alias("override")).collect()}
    assert got[1, 2].reply == "non_answer" and got[1, 2].defer and got[1, 3].message == "For that, what matters is: cotton." and got[1, 4].reply == "non_answer" and not got[1, 4].defer
    assert got[2, 1].message == "I'm looking for hat. color: red" and not got[2, 2].overridden and got[2, 3].overridden and got[2, 3].message == "Actually, ignore my earlier preference. What I need is: cotton."
    assert got[2, 4].n_told == 0 and got[2, 4].message == "I don't have an additional preference for material."


def test_detectors_with_an_injected_encoder(spark):
    classes = ["buying", "browsing", "override", "continuation", "non_answer"]
    words = {"buy": 0, "browse": 1, "pivot": 2, "also": 3, "whatever": 4}

    def encoder(batch: pd.Series) -> pd.Series:
        def one(text):
            v = [0.0] * 5
            for w, k in words.items():
                v[k] += float(w in text)
            n = sum(x * x for x in v) ** 0.5
            return [x / n if n else 0.0 for x in v]

        return batch.map(one)

    def broken(batch: pd.Series) -> pd.Series:
        raise OSError("no model")

    protos = spark.createDataFrame([(c, [1.0 if i == k else 0.0 for i in range(5)]) for k, c in enumerate(classes) for _ in range(3)], "label string, v array<double>")
    rows = [(1, "pivot now"), (2, "pivot. also and also this buy"), (3, "whatever"), (4, "whatever, in black"), (5, "never mind"), (6, ""), (7, None), (8, "also"), (9, "it doesn't matter")]
    turns = spark.createDataFrame(rows, "turn_id long, text string")
    got = {r.turn_id: (r.override, r.non_answer) for r in detectors.detected(turns, protos, encoder).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (True, False), 6: (False, False), 7: (False, False), 8: (False, False), 9: (False, False)}
    plain = {r.turn_id: (r.override, r.non_answer) for r in detectors.detected(turns, protos, broken).collect()}
    assert plain[1] == (False, False) and plain[5] == (True, True) and plain[9] == (False, True)
