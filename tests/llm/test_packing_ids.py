"""Sequences hold the tokenizer's ids, in the query and in the pipeline's stage; packing is best fit."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import packing, queries, tokens

ROWS = [
    (1, None), (2, ""), (3, "plain words, and some more of them"), (4, "日本語のテキスト" * 900), (5, "QUJD" * 9000), (6, " \t\n  x"),
    (None, "no id"), (7, "twice"), (7, "twice"), (8, "naïve Größe ½ " * 400), (9, "a mark <|endoftext|> inside"), (None, "no id"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def encoded(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def unpacked(rows):
    """The ids of every (document, copy), put together again from the sequences."""
    out: dict = {}
    for r in rows:
        assert r.n_tokens == len(r.tokens) <= r.capacity and r.capacity == min(c for c in packing.CAPACITIES if c >= r.n_tokens)
        at = 0
        for p in r.parts:
            assert p.offset == at
            at += p.length
            out.setdefault((p.id, p.copy), {})[p.start] = r.tokens[p.offset : at]
        assert at == r.n_tokens
    whole = {}
    for key, pieces in out.items():
        assert all(len(pieces[s]) == max(packing.CAPACITIES) for s in sorted(pieces)[:-1])
        whole[key] = [x for s in sorted(pieces) for x in pieces[s]]
    return whole


def test_op8_holds_every_text(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_packing(spark, sf).collect()
    assert unpacked(got) == {(i, 0): encoded(library, t) for i, t in docs.items()}
    assert sum(r.n_tokens for r in got) > 0.9 * sum(r.capacity for r in got)


def test_the_pipeline_stage_holds_every_copy(spark, sf, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    want: dict = {}
    for i, text in ROWS:
        want[i, sum(k[0] == i for k in want)] = encoded(library, text)
    assert unpacked(corpus_pipeline.pack_sequences(spark, docs, sf).collect()) == want
    assert corpus_pipeline.pack_sequences(spark, docs.where("doc_id = -1"), sf).count() == 0


def test_packing_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = [sorted(map(str, packing.packed(d, shard_bytes=1 << 17).select("bin_id", "n_tokens", "parts").collect())) for d in (docs.repartition(2), docs.repartition(5, "source"))]
    assert both[0] == both[1] and len({r.split("bin_id=")[1].split(",")[0] for r in both[0]}) == len(both[0])


def test_a_row_that_recurs_often_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "REPEATS", 10)
    docs = spark.createDataFrame([(1, "the same row again")] * 200 + [(2, "another")], "doc_id long, text string")
    got = packing.packed(docs, shard_bytes=500).collect()
    assert sum(len(r.parts) for r in got) == 201 and len({r.bin_id >> 32 for r in got}) > 3


def plain_best_fit(lengths, capacities, cost):
    """The rules by brute force: each piece into the tightest open bin, else the cheapest one opens."""
    bins: list[dict] = []
    for k, n in enumerate(lengths):
        fits = [b for b in bins if b["room"] >= n]
        if fits:
            least = min(b["room"] for b in fits)
            b = [b for b in fits if b["room"] == least][-1]
        else:
            def rate(c):
                room = c - n
                come = sum(x for x in lengths[k + 1 :] if x <= room)
                return cost.of(c) / (n + min(room, come)), c

            b = {"room": min((c for c in capacities if c >= n), key=rate), "in": []}
            bins.append(b)
        b["in"].append(n)
        b["room"] -= n
    return sorted(tuple(b["in"]) for b in bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=80), st.sampled_from([packing.Cost(), packing.Cost(0, 1e12), packing.Cost(500, 4096)]))
def test_packing_is_best_fit(lengths, cost):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    caps = (256, 512, 1024)
    where, offset, cap = packing.pack(lengths, caps, cost)
    got = []
    for b in sorted(set(where.tolist())):
        inside = sorted((int(o), int(n)) for w, o, n in zip(where, offset, lengths) if w == b)
        assert inside[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(inside, inside[1:]))
        used = sum(n for _, n in inside)
        assert {int(c) for w, c in zip(where, cap) if w == b} == {min(c for c in caps if c >= used)}
        got.append(tuple(n for _, n in inside))
    # bins of equal room are alike, so what matters is how much each holds
    want = plain_best_fit(lengths.tolist(), caps, cost)
    assert sorted(map(sum, got)) == sorted(map(sum, want)) and sorted(map(len, got)) == sorted(map(len, want)) and sorted(x for g in got for x in g) == sorted(lengths.tolist())


def test_the_opening_follows_what_is_to_come():
    caps = (512, 1024, 2048, 4096)
    alone = packing.pack(np.array([300]), caps)[2]
    upto = lambda xs: np.concatenate([[0], np.cumsum(xs)])
    many = [300] * 50
    assert alone.tolist() == [512] and packing.opening(0, [300], upto([300]), caps, packing.Cost()) == 512
    assert packing.opening(0, many, upto(many), caps, packing.Cost()) > 512


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    from brindle.llm import shared

    spark.conf.unset(shared._BATCH_SETTING)
    shared.bound_batches(spark)
    assert int(spark.conf.get(shared._BATCH_SETTING)) == shared.BATCH_BYTES
    spark.conf.set(shared._BATCH_SETTING, "4096")
    shared.bound_batches(spark)
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 50)) for i in range(300)], "doc_id long, text string").coalesce(1)
    small = sorted(map(str, packing.packed(docs).collect()))
    assert spark.conf.get(shared._BATCH_SETTING) == "4096"
    spark.conf.unset(shared._BATCH_SETTING)
    assert small == sorted(map(str, packing.packed(docs).collect()))


def test_orc_batches_are_bounded_and_their_size_changes_no_ids(spark, tmp_path):
    from brindle.llm import shared, tokens

    names = [n for n in shared._BATCH_SETTINGS if ".orc." in n]
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 50)) for i in range(600)], "doc_id long, text string").coalesce(1)
    got = []
    for rows in (None, "7", "4096"):
        for n in names:
            spark.conf.unset(n) if rows is None else spark.conf.set(n, rows)
        path = str(tmp_path / f"t{rows}")
        encoded = tokens.encode(docs)
        tokens.write_tokens(encoded, path)
        got.append(sorted(map(str, tokens.read_tokens(spark, path, encoded.schema).select("doc_id", "n", "tokens").collect())))
        assert [spark.conf.get(n) for n in names] == [rows or str(shared._BATCH_SETTINGS[n]) for n in names]
    for n in names:
        spark.conf.unset(n)
    assert len(names) == 2 and len(got[0]) == 600 and got[0] == got[1] == got[2]
