"""The live ledger over a stream of files equals the batch ledger of the same messages."""

import time

from pyspark.sql import functions as F

from turnwise.operators import state
from turnwise.sources import views as V
from turnwise.streaming import live

SCHEMA = "session string, turn long, message string"


def _words(spark):
    rows = [("category", "belt"), ("color", "black"), ("color", "red"), ("color", "dark red"), ("style", "casual"), ("material", "polyvinyl chloride")]
    return spark.createDataFrame([(*r, 1) for r in rows], "slot string, term string, support long")


def _run(spark, tmp_path, batches, words, **how):
    """What is told of messages that come in ``batches``, each a trigger of its own."""
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    q = live.live_ledger(stream, words, **how).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("live").outputMode("update").start()
    until = time.time() + 120
    while q.isActive and time.time() < until and len({p["batchId"] for p in q.recentProgress if p["numInputRows"]}) < len(batches):
        time.sleep(0.2)  # timers keep such a query alive, so it is stopped once everything is read
    assert q.exception() is None
    q.stop()
    return spark.table("live")


def test_late_and_repeated_turns(spark, tmp_path):
    first = [("s", 1, "belts closure black pvc"), ("s", 3, "casual dark red"), ("t", 2, "blue thing")]
    second = [("s", 2, "Actually, ignore my earlier preference. red"), ("s", 1, "belts closure black pvc"), ("t", 4, "no preference"), ("t", 3, "blue")]
    third = [("s", 5, "closure " + " ".join(f"w{i}" for i in range(60))), ("t", 1, "Actually, ignore my earlier preference. casual"), ("s", 4, "I don't have a preference for red")]
    told = _run(spark, tmp_path, [first, second, third], _words(spark))
    got = {tuple(r) for r in live.latest(told).collect()}
    said = spark.createDataFrame(first + second + third, SCHEMA).distinct().withColumnRenamed("session", "sample_id")
    heard = state.hear(said, _words(spark))
    assert got == {tuple(r) for r in state.active_by_turn(heard).select("sample_id", "turn", "token", "slot", "first_turn", "place").collect()}
    assert max(r.n for r in live.latest(told).groupBy("sample_id", "turn").agg(F.count("*").alias("n")).collect()) == 40
    gains = {(r.session, r.turn): (r.gained, r.stuck_for) for r in told.groupBy("session", "turn").agg(F.max_by(F.struct("gained", "stuck_for"), "revision").alias("x")).select("session", "turn", "x.*").collect()}
    assert gains == {(r.sample_id, r.turn): (r.gained, r.stuck_for) for r in state.gains(heard).collect()}
    assert told.where("session = 's' and turn = 1").count() == 1  # neither the repetition nor what came later changed it


def test_whole_conversations(spark, sf_dir, tmp_path):
    from turnwise import queries

    said = V.messages(spark, sf_dir).where("sample_id < 200").select(F.col("sample_id").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), "message").cache()
    words = queries._vocabulary(spark, sf_dir)
    batches = [[tuple(r) for r in said.where(f"pmod(hash(session, turn), 3) = {i}").collect()] for i in (2, 0, 1)]  # turns come in any order
    got = {tuple(r) for r in live.latest(_run(spark, tmp_path, batches, words)).collect()}
    heard = state.hear(said.withColumnRenamed("session", "sample_id"), words)
    want = {tuple(r) for r in state.active_by_turn(heard).select("sample_id", "turn", "token", "slot", "first_turn", "place").collect()}
    assert got == want and len({r[0] for r in want}) > 40 and said.where("message like 'Actually%'").count() > 3


def test_idle_sessions_are_dropped(spark, tmp_path):
    told = _run(spark, tmp_path, [[("s", 1, "red")], [("u", 1, "red")], [("u", 2, "red")], [("s", 2, "red")]], _words(spark), idle=1)
    assert {r.turn: r.gained for r in told.where("session = 's'").collect()} == {1: 1, 2: 1}
