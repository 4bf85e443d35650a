import pytest

from brindle.sources import catalog

LINES = ['{"parent_asin": "A", "title": "Red boot", "price": 50, "features": ["zip", "warm"], "details": {"Fit": "wide"}, "categories": ["Root", "Boots"]}', "", '{"parent_asin": "B", "title": null}']


def put(path, lines):
    path.write_text("\n".join(lines))
    return str(path)


def test_catalog_scan(spark, tmp_path):
    rows = catalog.read_jsonl(spark, put(tmp_path / "c.jsonl", LINES), catalog.CATALOG)
    got = {r.parent_asin: r for r in rows.collect()}
    assert set(got) == {"A", "B"} and got["A"].details == {"Fit": "wide"} and got["B"].price is None
    text = catalog.lookup(rows, spark.createDataFrame([("A",), ("Z",)], "parent_asin string")).collect()
    assert [r.text for r in text] == ["Red boot Root Boots zip warm"]


@pytest.mark.parametrize("line", ['{"parent_asin": ', '{"title": "no key"}'])
def test_checked_scan_refuses(spark, tmp_path, line):
    good = catalog.read_checked(spark, put(tmp_path / "g.jsonl", LINES), catalog.CATALOG, "parent_asin", limit=1)
    assert good.count() == 1
    with pytest.raises(Exception, match="malformed line|has no parent_asin"):
        catalog.read_checked(spark, put(tmp_path / "b.jsonl", [*LINES, line]), catalog.CATALOG, "parent_asin").collect()


def test_index_guard(spark, tmp_path):
    path = str(tmp_path / "ix")
    catalog.write_index(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<float>"), path, "m", "d1")
    assert catalog.read_index(spark, path, "m", "d1").count() == 2
    for model, digest in (("other", "d1"), ("m", "d2")):
        with pytest.raises(ValueError):
            catalog.read_index(spark, path, model, digest)


def test_profile_store(spark, tmp_path):
    path = str(tmp_path / "store")
    for rows in ([("k", "color", "red", 1)], [("k", "color", "red", 2), ("k", "color", "blue", 2), ("j", "color", "tan", 1)]):
        catalog.append_disclosures(spark.createDataFrame(rows, "key string, attribute string, value string, session int"), path)
    assert [tuple(r) for r in catalog.carried_values(spark.read.parquet(path)).collect()] == [("k", "color", "red")]
    twice = spark.createDataFrame([("k", "color", "tan", 1), ("k", "color", "tan", 1)], "key string, attribute string, value string, session int")
    assert [r.value for r in catalog.carried_values(twice).collect()] == ["tan"]


def test_replay_and_log(spark, tmp_path):
    turns = spark.createDataFrame([(1, "buying", "A", 3), (2, "buying", "B", 2), (3, "browsing", "A", None), (4, "buying", "A", None)], "session int, scenario string, target string, hit_turn int")
    cards = spark.createDataFrame([("A", "Boot"), ("B", "Hat")], "target string, title string")
    got = sorted((r.session, r.title) for r in catalog.replay_picks(turns, cards).collect())
    assert got == [(2, "Hat"), (3, "Boot")]
    for value in (1, 2):
        catalog.log_point(spark.createDataFrame([(value,)], "score int"), str(tmp_path / "log"), "a")
    assert [r.score for r in spark.read.json(str(tmp_path / "log")).collect()] == [2]
