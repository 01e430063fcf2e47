"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

from pageloom.operators import state
from pageloom.streaming import sessions as S


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).parquet(str(path))


def test_idle_sessions(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00") for u in (1, 2) for h in (0, 1, 5) for m in (0, 4, 8)]
    df = spark.createDataFrame(rows, "u int, t string").select("u", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = drain(S.idle_sessions(stream(spark, tmp_path / "e"), "u", "ts"), "idle", "complete")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, state.sessions(df, "u", "ts").collect()))


def test_first_requests(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "text string, speed double").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    df.write.parquet(str(tmp_path / "r"))
    assert drain(S.first_requests(stream(spark, tmp_path / "r"), ["text", "speed"], "ts"), "firsts").count() == 2


def test_heartbeat(spark, tmp_path):
    oks = [True, False, False, False, False, True, False]
    df = spark.createDataFrame([("k", f"2024-01-01 00:0{i}:00", ok) for i, ok in enumerate(oks)], "k string, t string, ok boolean")
    df = df.select("k", F.to_timestamp("t").alias("ts"), "ok")
    df.coalesce(1).write.parquet(str(tmp_path / "b"))
    live = [r.state for r in drain(S.heartbeat_states(stream(spark, tmp_path / "b"), "k"), "beats").orderBy("ts").collect()]
    assert live == [r.state for r in S.heartbeat_states_batch(df, "k").orderBy("ts").collect()]
    assert live[3] == live[4] == "DISCONNECTED"
