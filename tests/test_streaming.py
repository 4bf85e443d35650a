"""The live state machine against the batch fold, and windows on a stream."""

from brindle.operators import sessions
from brindle.plans.analytics import chat_turns
from brindle.streaming import live


def test_live_sessions_equal_the_batch_fold(spark, sf, tmp_path):
    turns = chat_turns(spark, sf)
    turns.repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).json(str(tmp_path / "in"))
    q = live.live_sessions(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    cols = ["session", "turn", "segment", "query", "boundary", "informative"]
    got = sorted(map(tuple, spark.table("live").select(*cols).collect()))
    assert got == sorted(map(tuple, sessions.fold(sessions.turn_signals(turns)).select(*cols).collect()))


def test_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, live.windowed_counts(events, "1 day").collect()))
