"""One row of each near-duplicate class stays, whatever the ids are."""

from brindle.llm import near_dedup

A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(40))
ROWS = [
    (5, A), (3, A), (3, A), (3, A), (9, A + " more"), (None, A),
    (None, B), (None, B), (4, "alone in its words and its class"), (7, None), (8, ""),
]


def test_one_row_of_a_class_stays(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, `__k` int").repartition(3)
    got = near_dedup.without_near_duplicates(docs)
    assert got.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == [(3, A), (4, ROWS[8][1]), (7, None), (8, ""), (None, B)]
    assert near_dedup.without_near_duplicates(docs.where("doc_id = -1")).count() == 0


def test_a_text_without_shingles_shifts_nothing(spark):
    """Ids 1, 2 and 5 have an empty text too; the links of the others in the same task stay right."""
    pair = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    rows = [(1, ""), (1, pair[0]), (2, " "), (2, pair[0] + " end"), (3, pair[1]), (4, pair[1] + " end"), (5, ""), (5, pair[2]), (6, pair[2] + " end")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in got if r.n_shingles} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
