"""A stream's sessions equal the batch operator's."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reelwright.operators import timeline
from reelwright.streaming.sessions import stream_sessions


def test_stream_equals_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("m", t, ["a"] if t % 2 else ["b", "c", "a"]) for t in (0, 5, 10, 16, 30, 31, 50)] + [("n", 3, ["c"]), ("n", 4, []), ("end", 100_000, ["z"])]
    df = spark.createDataFrame([(m, base + timedelta(seconds=t), tags) for m, t, tags in rows], "movie_id string, ts timestamp, tags array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, "5 seconds", "1 second").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["movie_id"], int((r["start"] - base).total_seconds()), int((r["end"] - base).total_seconds()), r["tags"], r["n"]) for r in spark.table("sessions").collect())
    det = spark.createDataFrame([(m, t, tags, i) for i, (m, t, tags) in enumerate(rows) if m != "end"], "movie_id string, t bigint, tags array<string>, seq int")
    want = sorted((r["movie_id"], r["start"], r["end"], r["tags"], r["n"]) for r in timeline.sessionize(det, 5, 10**6).collect())
    assert got == want
