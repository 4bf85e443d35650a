"""The work of one row grows with its own length, not faster."""

import re

from pyspark.sql import functions as F

from brindle.functions import extract as ex
from brindle.operators import sessions


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_simulated_answer_is_computed_once_a_turn(spark):
    rows = [(1, "boundary", "hat", ["cotton"], ["color: red"])]
    c = spark.createDataFrame(rows, "session long, kind string, category string, hard array<string>, soft array<string>")
    text = plan(sessions.simulate(c, ["size", "material", "color", "other", "size"], turn_of=F.lit(3)))
    assert text.count(sessions.DISCLOSES[0]) == 5


def test_leads_are_bounded_endings(spark):
    texts = ["", "not a b", "x " * 400 + "not red, blue", "é—" * 60 + " no wait red", "a" * 50 + " b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    word = r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+"
    for r in df.select("text", ex.leads(F.col("text"), F.lit(word), 30).alias("leads")).collect():
        starts = [m.start() for m in re.finditer(r"(?<=\W)\w+", r.text)]
        assert r.leads == [r.text[:i][-30:] for i in starts]
