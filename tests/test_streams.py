"""Streams: timelines with state against the batch operators, and containers read as they come."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_container import lib

from reelwright.operators import timeline
from reelwright.sources import containers
from reelwright.streaming import timelines

BASE = datetime(2024, 1, 1)


def test_stream_timeline_equals_batch(spark, tmp_path):
    """Several micro-batches, rows out of order within the delay, ends of their own that overrun later groups, ties."""
    r = random.Random(4)
    rows = [(m, t, i, r.choice([["a"], ["b", "a"], []]), r.choice([None, None, t + r.randrange(1, 90_000)])) for m in ("m", "n") for i, t in enumerate(sorted(r.choices(range(0, 300_000, 500), k=40)))]
    duration, interval = 400_000, 5_000
    files = [[] for _ in range(6)]
    for row in rows:
        files[min(5, row[1] // 50_000)].append(row)
    for part in files:
        r.shuffle(part)
    files += [[("end", 10_000_000, 0, ["z"], None)], [("end", 20_000_000, 1, ["z"], None)]]
    schema = "movie_id string, ts timestamp, seq long, tags array<string>, bad_end long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timelines.ROCKS)
    try:
        for k, part in enumerate(files):
            spark.createDataFrame([(m, BASE + timedelta(milliseconds=t), i, tags, e) for m, t, i, tags, e in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = timelines.stream_timeline(stream, interval, duration, "2024-01-01 00:00:00", "60 seconds")
            q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(180), k
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((x["movie_id"], x["seg_no"], x["start"], x["end"], x["tags"]) for x in spark.read.parquet(str(tmp_path / "out")).collect() if x["movie_id"] != "end")
    det = spark.createDataFrame(rows, "movie_id string, t bigint, seq long, tags array<string>, bad_end bigint")
    movies = spark.createDataFrame([("m", duration), ("n", duration)], "movie_id string, duration bigint")
    batch = timeline.fill_gaps(timeline.sessionize(det, interval, duration), movies)
    assert got == sorted((x["movie_id"], x["seg_no"], x["start"], x["end"], x["tags"]) for x in batch.collect())
    assert len(got) > 20


def test_containers_come_once(spark, tmp_path):
    folder, log = str(tmp_path / "lib"), str(tmp_path / "log")

    def run():
        rows = containers.read_stream(spark, folder, log, "index", files_per_batch="2").select("path", "segment_id", "corrupt")
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted(((x["path"][-6:-4], x["segment_id"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)

    lib(spark, folder, movies=2, segments=2)
    want = [(m, s) for m in ("m0", "m1") for s in ("s1", "s2")]
    assert run() == want and run() == want  # nothing new
    _, seg, packets = lib(spark, str(tmp_path / "other"), movies=5, segments=2)
    late = ~F.col("movie_id").isin("m0", "m1")
    containers.write(seg.filter(late), folder, {}, packets=packets.filter(late))
    (tmp_path / "lib" / "bad.bvf").write_bytes(b"?")
    for _ in range(3):
        got = run()
    assert len(got) == 11
    assert [g for g in got if g[1] is not None] == [(f"m{k}", s) for k in range(5) for s in ("s1", "s2")]
    assert len(list((tmp_path / "log").glob("*.json"))) >= 3
    with pytest.raises(Exception, match="needs the option log"):
        spark.readStream.format("segment_container").option("path", folder).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).start().awaitTermination(60)


def test_tasks_of_a_stream_do_not_carry_the_files_seen(tmp_path):
    from pyspark.cloudpickle import dumps, loads
    from pyspark.sql.types import StructType

    from reelwright.sources.containers import _Stream

    (tmp_path / "in").mkdir()
    for i in range(200):
        (tmp_path / "in" / f"{i}.bvf").write_bytes(b"x")
    stream = _Stream({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "table": "index"}, StructType().add("path", "string"))
    empty = len(dumps(stream))
    assert stream.latestOffset() == {"batches": 1} and len(stream.seen) == 200
    assert len(dumps(stream)) == empty
    assert loads(dumps(stream)).latestOffset() == {"batches": 1}  # and what was seen is told again
