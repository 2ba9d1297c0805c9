"""Payloads as sorted streams: chunks and digests against brute force, beyond what a row may hold."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reelwright.operators import playback
from reelwright.sources import shared


def packet_rows(spark):
    r = random.Random(1)
    rows = [(m, s, n, r.choice([1, 2]), None if r.random() < 0.1 else bytes(r.randrange(256) for _ in range(r.randrange(0, 40)))) for m in ("a", "b", None) for s in range(4) for n in range(r.randrange(1, 30))]
    rows += [("empty", 0, 1, 1, b""), ("empty", 1, 1, 2, None)]
    return rows, spark.createDataFrame(r.sample(rows, len(rows)), "movie string, s int, n int, kind int, data binary").repartition(3)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_chunks(spark, chunk):
    rows, df = packet_rows(spark)
    want = {}
    for m, s, _, _, d in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        want[m, s] = want.get((m, s), b"") + (d or b"")
    got = {}
    for r in playback.payload_chunks(df, ["movie", "s"], "n", "data", chunk).collect():
        got.setdefault((r["movie"], r["s"]), []).append((r["chunk_no"], bytes(r["payload"])))
    assert {k: b"".join(p for _, p in sorted(v)) for k, v in got.items()} == want
    for parts in got.values():
        parts.sort()
        assert [n for n, _ in parts] == list(range(len(parts))) and all(len(p) == chunk for _, p in parts[:-1])


def test_digests(spark):
    rows, df = packet_rows(spark)
    got = playback.payload_digests(df, ["movie", "s"], "n", "data", {"all": None, "audio": F.col("kind") == 2}).collect()
    assert len(got) == len({x[:2] for x in rows})
    for r in got:
        mine = [x for x in sorted(rows, key=lambda x: x[2]) if x[:2] == (r["movie"], r["s"])]
        for name, picked in (("all", mine), ("audio", [x for x in mine if x[3] == 2])):
            data = b"".join(x[4] or b"" for x in picked)
            assert r[f"{name}_bytes"] == len(data) and r[f"{name}_hash"] == (hashlib.sha256(data).hexdigest() if data else "")


def test_payloads_longer_than_a_row(spark):
    """More than MOST_PAYLOAD in one key: digests and chunks stream; one row refuses."""
    n, size = 75, 8 << 20
    df = spark.range(0, n, 1, 8).select(F.lit("k").alias("k"), "id", F.repeat(F.chr(65 + F.col("id") % 26), F.lit(size)).cast("binary").alias("data"))
    assert n * size > playback.MOST_PAYLOAD
    whole = hashlib.sha256()
    for i in range(n):
        whole.update(bytes([65 + i % 26]) * size)
    r = playback.payload_digests(df, ["k"], "id", "data", {"all": None}).first()
    assert (r["all_bytes"], r["all_hash"]) == (n * size, whole.hexdigest())
    parts = playback.payload_chunks(df, ["k"], "id", "data").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("b"), F.max(F.length("payload")).alias("m")).first()
    assert (parts["n"], parts["b"], parts["m"]) == (-(-n * size // playback.CHUNK), n * size, playback.CHUNK)
    with pytest.raises(Exception, match="too long for a row"):
        playback.joined_payloads(df, ["k"], "id", "data").select(F.length("payload")).collect()


def test_serving_and_exporting_in_chunks(spark):
    seq = spark.createDataFrame([("m", "p", i, f"s{i}", "mute" if i == 2 else "play", f"t{i}", 10) for i in range(1, 6)], "movie_id string, profile string, play_no int, seg_id string, profile_action string, target_id string, duration long")
    packets = spark.createDataFrame([("m", "t2", 1, 1, b"v"), ("m", "t2", 2, 2, b"a"), ("m", "t3", 1, 1, b"v3"), ("m", "t3", 2, 2, b"a3"), ("m", "t4", 1, 2, b"")], "movie_id string, target_id string, packet_no int, packet_type int, data binary")
    at = spark.createDataFrame([("m", 15), ("m", 20), ("m", 35)], "movie_id string, position long")
    rows = playback.served(seq, at, packets).collect()
    assert {(r["position"], r["chunk_no"], r["payload"] and bytes(r["payload"])) for r in rows} == {(15, 0, b"v"), (20, 0, b"v3a3"), (35, None, None)}
    parts = playback.exported(seq, packets, chunk=3).orderBy("play_no", "chunk_no").collect()
    assert [(r["play_no"], r["chunk_no"], bytes(r["payload"])) for r in parts] == [(2, 0, b"v"), (3, 0, b"v3a"), (3, 1, b"3")]


def test_serving_with_shuffled_joins(spark):
    """As beyond the limit of broadcasts: positions are broadcast, the other tables are not."""
    seq = shared.kept(spark.createDataFrame([(m, p, n, f"s{n}", "mute" if n == 2 and p == "b" else "play", f"t{n}", 10) for m in range(40) for p in "ab" for n in range(1, 6)], "movie_id long, profile string, play_no int, seg_id string, profile_action string, target_id string, duration long"))
    packets = spark.createDataFrame([(m, f"t{n}", k, k, f"{m}-{n}-{k}".encode()) for m in range(40) for n in range(1, 6) for k in (1, 2)], "movie_id long, target_id string, packet_no int, packet_type int, data binary")
    at = F.broadcast(spark.createDataFrame([(m, 15) for m in range(40)], "movie_id long, position long"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = playback.served(seq, at, packets).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r["movie_id"], r["profile"], bytes(r["payload"] or b"").decode()) for r in rows) == [(m, p, f"{m}-2-1" + ("" if p == "b" else f"{m}-2-2")) for m in range(40) for p in "ab"]
