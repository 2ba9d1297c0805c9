"""The container format: bytes, round trips, damage."""

import contextlib
import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from reelwright.operators import playback
from reelwright.sources import container as c
from reelwright.sources import containers


def build(blocks, manifest=None, **kw):
    m = manifest or c.manifest_json("tt1", "Фильм", 360_500, [{"id": b[0]} for b in blocks], {}, "2024-01-01T00:00:00Z")
    return b"".join(c.packed(m, blocks, 360_500, **kw))


TRIO = [(s, d, c.block(s, v, a)) for s, d, v, a in (("seg_001", 120_000, [(0, b"v1"), (40, b"v2")], [(0, b"a1")]), ("seg_002", 60_000, None, None), ("сег_3", 5, [], [(7, b"xyz")]))]


def test_header_and_index_bytes():
    data = build(TRIO)
    fields = struct.unpack("<8sHHIQQQQIQI", data[:64])
    assert fields[0] == b"BVF\x01\0\0\0\0" and fields[1:4] == (1, 0, 9) and fields[4:6] == (64, 120) and fields[6] == 184 and fields[8:] == (3, 360_500, 0)
    sid, offset, length, duration = struct.unpack("<16sQQQ", data[64:104])
    assert sid == b"seg_001".ljust(16, b"\0") and offset == 184 + fields[7] and length == 32 + 3 * 16 + 6 and duration == 120_000
    assert data[offset : offset + 4] == b"SEG\0"
    last = struct.unpack("<16sQQQ", data[144:184])
    assert last[1] + last[2] == len(data)


def test_round_trip():
    box = c.Container(io.BytesIO(build(TRIO)))
    assert [e.segment_id for e in box.index()] == ["seg_001", "seg_002", "сег_3"]
    assert box.manifest()["title"] == "Фильм"
    assert box.packets(box.index()[0]) == ((1, 0x100), [(1, 0, b"v1"), (1, 40, b"v2"), (2, 0, b"a1")])
    assert box.packets(box.index()[1])[1] == [(1, 0, b"\0"), (2, 0, b"\0")]
    assert box.packets(box.index()[2])[1] == [(2, 7, b"xyz")]


def test_optional_manifest_fields():
    plain = json.loads(c.manifest_json("m", "t", 1, [], {}, "x"))
    assert "chapters" not in plain and "video_info" not in plain
    full = json.loads(c.manifest_json("m", "t", 1, [], {}, "x", {"width": 1}, [{"title": "Глава"}]))
    assert full["chapters"] == [{"title": "Глава"}] and full["video_info"] == {"width": 1}


def test_no_segments():
    box = c.Container(io.BytesIO(data := build([])))
    assert box.index() == [] and box.header.segment_count == 0
    assert box.header.manifest_offset + box.header.manifest_length == len(data)


def test_limits_and_damage():
    with pytest.raises(ValueError, match="16 bytes"):
        c.packed_id("x" * 17)
    with pytest.raises(ValueError, match="16 bytes"):
        c.packed_id("ф" * 9)
    good = build(TRIO)
    for at, what in ((0, "magic"), (8, "version"), (60, "reserved")):
        bad = bytearray(good)
        bad[at] ^= 2
        with pytest.raises(c.Corrupt, match=what):
            c.Container(io.BytesIO(bytes(bad)))
        c.Container(io.BytesIO(bytes(bad)), strict=False)
    with pytest.raises(c.Corrupt, match="shorter"):
        c.Container(io.BytesIO(good[:10]))
    box = c.Container(io.BytesIO(good[:-1]))
    with pytest.raises(c.Corrupt, match="cut off"):
        box.packets(box.index()[2])
    assert list(c.packets_of(good[-19:-1])) == []


def test_spark_round_trip_and_modes(spark, tmp_path):
    segments = spark.createDataFrame(
        [("m", "T", 345_000, i, f"seg_{i:03d}", 100 * i, 100 * i + 50, ["x"] if i % 3 == 0 else [], [], "mature" if i % 3 == 0 else "safe", False, {"child": ("swap", "f")}, [(0, f"v{i}".encode()), (9, b"-")], [(0, f"a{i}".encode())]) for i in range(1, 21)]
        + [("n", "U", 10, 1, "seg_001", 0, 10, [], [], "safe", True, {}, None, None)],
        "movie_id string, title string, duration_ms long, seg_no int, seg_id string, start_ms long, end_ms long, tags array<string>, topics array<string>, risk string, is_filler boolean, profiles map<string,struct<action:string,segment_id:string>>, video array<struct<pts_ms:long,data:binary>>, audio array<struct<pts_ms:long,data:binary>>")
    folder = str(tmp_path / "lib")
    written = {r["movie_id"]: r["segments"] for r in containers.write(segments, folder, {"child": {"filters": {"x": "swap"}}}).collect()}
    assert written == {"m": 20, "n": 1}
    back = containers.read(spark, folder).cache()
    assert [r["segment_id"] for r in back.filter("movie_id = 'm'").orderBy("seg_no").collect()] == [f"seg_{i:03d}" for i in range(1, 21)]
    assert back.filter("movie_id = 'm'").first()["profiles"]["child"]["segment_id"] == "f" and back.filter("is_filler").count() == 1
    packets = containers.read(spark, folder, "packets")
    full = {r["segment_id"]: bytes(r["payload"]) for r in containers.payloads(packets.filter("path LIKE '%m.bvf'")).collect()}
    assert full["seg_007"] == b"v7-a7"
    video = containers.payloads(packets.filter("path LIKE '%m.bvf'"), c.VIDEO).filter("segment_id = 'seg_007'").first()
    assert bytes(video["payload"]) == b"v7-"
    audio = containers.payloads(packets.filter("path LIKE '%m.bvf'"), c.AUDIO).select(playback.audio_hash(F.col("payload")).alias("h"))
    assert len(audio.first()["h"]) == 64
    assert containers.read(spark, folder, "header").filter("segment_count = 20 AND version_major = 1").count() == 1
    (tmp_path / "lib" / "broken.bvf").write_bytes(b"nothing")
    bad = containers.read(spark, folder, "index")
    assert bad.filter("corrupt IS NOT NULL").count() == 1 and bad.filter("corrupt IS NULL").count() == 21
    with pytest.raises(Exception, match="shorter than a header"):
        containers.read(spark, folder, "index", "FAILFAST").count()


def lib(spark, folder, movies=3, segments=4, data=b"v", **kw):
    """Containers m0 .. with segments s1 .., of three video packets and an audio packet each."""
    rows = [(f"m{m}", f"T{m}", 1000, i, f"s{i}", i, i + 1, ["x"], [], "mature", False, {}) for m in range(movies) for i in range(1, segments + 1)]
    seg = spark.createDataFrame(rows, "movie_id string, title string, duration_ms long, seg_no int, seg_id string, start_ms long, end_ms long, tags array<string>, topics array<string>, risk string, is_filler boolean, profiles map<string,struct<action:string,segment_id:string>>")
    packets = [(f"m{m}", i, 1 + (n == 4), n, n * 10, data * (100 + i) + f"{m}.{i}.{n}".encode()) for m in range(movies) for i in range(1, segments + 1) for n in (3, 1, 4, 2)]
    pk = spark.createDataFrame(packets, "movie_id string, seg_no int, packet_type int, packet_no int, pts_ms long, data binary")
    return containers.write(seg, folder, {}, packets=pk, **kw), seg, pk


def scan(folder, table, mode="PERMISSIVE", filters=(), **options):
    """A scan without Spark: its rows, and the bytes that it fetched."""
    from pyspark.sql.types import StructType

    reader = containers._Reader({"path": folder, "table": table, "mode": mode, **options}, StructType.fromDDL(containers.TABLES[table]))
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, reader.fetched, left


def test_packet_rows_are_written(spark, tmp_path):
    done, _, packets = lib(spark, str(tmp_path))
    assert sorted((r["movie_id"], r["segments"], r["bytes"]) for r in done.collect()) == sorted((f"m{m}", 4, (tmp_path / f"m{m}.bvf").stat().st_size) for m in range(3))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m0.bvf", "m1.bvf", "m2.bvf"]
    back = containers.read(spark, str(tmp_path), "packets", "FAILFAST")
    got = sorted((r["path"][-6:-4], r["seg_no"], r["packet_type"], r["packet_no"], r["pts_ms"], bytes(r["data"])) for r in back.collect())
    assert got == sorted(tuple(r) for r in packets.collect())
    lib(spark, str(tmp_path), movies=1, data=b"new")  # a movie's file is replaced
    assert containers.read(spark, str(tmp_path), "packets").filter("path LIKE '%m0.bvf'").first()["data"].startswith(b"newnew")


def test_missing_packets_make_stubs_and_stray_ones_fail(spark, tmp_path):
    _, seg, packets = lib(spark, str(tmp_path / "a"), movies=1)
    silent = packets.filter("NOT (seg_no = 2 AND packet_type = 2) AND seg_no <> 3")
    containers.write(seg, str(tmp_path / "b"), {}, packets=silent)
    rows = containers.read(spark, str(tmp_path / "b"), "packets", "FAILFAST").collect()
    assert sorted((r["seg_no"], r["packet_type"], bytes(r["data"])) for r in rows if r["seg_no"] in (2, 3)) == [(s, k, b"\0") for s in (2, 3) for k in (1, 2)]
    for stray in (packets.withColumn("seg_no", F.lit(9)), packets.withColumn("movie_id", F.lit("other"))):
        with pytest.raises(Exception, match="have no segment"):
            containers.write(seg, str(tmp_path / "c"), {}, packets=stray)
    assert not (tmp_path / "c").exists() or not list((tmp_path / "c").iterdir())


def test_failed_jobs_leave_nothing(spark, tmp_path):
    done, seg, packets = lib(spark, str(tmp_path / "a"))
    bad = seg.withColumn("seg_id", F.when(F.col("movie_id") == "m2", F.lit("an id of over sixteen bytes")).otherwise(F.col("seg_id")))
    with pytest.raises(Exception, match="16 bytes"):
        containers.write(bad, str(tmp_path / "b"), {}, packets=packets)
    assert list((tmp_path / "b").iterdir()) == []


def test_blocks_of_several_gigabytes():
    """Lengths and offsets beyond 32 bits, with a sink that counts instead of storing."""

    class Count:
        size, first = 0, b""

        def write(self, x):
            self.size += len(x)
            if len(self.first) < 4096:
                self.first += bytes(x[:4096])

        def close(self):
            pass

    data, n = bytes(64 << 20), 48  # 3 GB
    info = {"title": "t", "duration_ms": 9, "start_ms": 0, "end_ms": 5, "tags": [], "topics": [], "risk": "safe", "is_filler": False, "profiles": [], "stub": False, "video_info": None, "chapters": None}
    segments = [info | {"seg_no": k, "seg_id": f"s{k}", "length": c.BLOCK.size + (n * (c.PACKET.size + len(data)) if k == 1 else c.PACKET.size + 1)} for k in (1, 2)]
    f = containers.File(out := Count(), "m", {"segments": segments, "profiles": "{}", "analyzed_at": "x"})
    for k in range(n):
        f.packet(1, c.VIDEO, k, data)
    f.packet(2, c.VIDEO, 0, b"x")
    f.close()
    one, two = c.Container(io.BytesIO(out.first)).index()
    assert one.data_length > 3 << 30 and two.data_offset == one.data_offset + one.data_length and out.size == two.data_offset + two.data_length
    g = containers.File(Count(), "m", {"segments": segments, "profiles": "{}", "analyzed_at": "x"})
    g.packet(1, c.VIDEO, 0, b"too short")
    with pytest.raises(ValueError, match="differs from its length"):
        g.packet(2, c.VIDEO, 0, b"x")


def test_chapters_and_video_info_come_back(spark, tmp_path):
    _, seg, packets = lib(spark, str(tmp_path / "a"), movies=1)
    seg = seg.withColumns({"video_info": F.struct(F.lit(640).alias("width")), "chapters": F.array(F.struct(F.lit("Eins").alias("title"), F.lit(0).alias("start_ms")))})
    containers.write(seg, str(tmp_path / "b"), {}, packets=packets)
    m = json.loads(containers.read(spark, str(tmp_path / "b"), "manifest", "FAILFAST").first()["manifest"])
    assert m["video_info"] == {"width": 640} and m["chapters"] == [{"title": "Eins", "start_ms": 0}]


def test_filters_are_pushed_and_skip_bytes(spark, tmp_path):
    lib(spark, str(tmp_path), data=b"v" * 5000)
    df = containers.read(spark, str(tmp_path), "packets", "FAILFAST").filter("segment_id = 's3' AND path LIKE '%m1.bvf'")
    assert {(r["seg_no"], r["segment_id"]) for r in df.collect()} == {(3, "s3")} and df.count() == 4
    with contextlib.redirect_stdout(plan := io.StringIO()):
        df.explain("formatted")
    assert "EqualTo(segment_id,s3)" in plan.getvalue().split("PushedFilters")[1] and "Filter (" not in plan.getvalue()
    rows, fetched, left = scan(str(tmp_path), "packets", filters=[containers.EqualTo(("segment_id",), "s3"), containers.StringEndsWith(("path",), "m1.bvf"), containers.EqualTo(("pts_ms",), 10)])
    size = sum(len(r["data"]) + c.PACKET.size for r in rows)
    assert len(rows) == 4 and [f.attribute for f in left] == [("pts_ms",)]
    # A header, an index, that block, and its header once more.
    assert fetched == c.HEADER.size + 4 * c.ENTRY.size + c.BLOCK.size + size
    assert [r["seg_no"] for r in scan(str(tmp_path), "index", filters=[containers.GreaterThan(("seg_no",), 2), containers.In(("segment_id",), ("s1", "s4"))])[0]] == [4, 4, 4]
    _, heads, _ = scan(str(tmp_path), "packet_heads")
    assert heads < 0.6 * sum(p.stat().st_size for p in tmp_path.iterdir())


def test_ranges_read_only_what_is_asked(spark, tmp_path):
    lib(spark, str(tmp_path), movies=2)
    files = {str(p): p.read_bytes() for p in tmp_path.iterdir()}
    heads = containers.read(spark, str(tmp_path), "packet_heads", "FAILFAST").filter("seg_no = 2")
    got = containers.ranges(heads.select("path", "offset", F.col("size").alias("length"), "packet_no"), str(tmp_path)).collect()
    assert len(got) == 8 and all(bytes(r["data"]) == files[r["path"]][r["offset"] : r["offset"] + r["length"]] for r in got)
    odd = spark.createDataFrame([(next(iter(files)), 5, 1000, "k"), (next(iter(files)), 10**9, 5, "gone"), (next(iter(files)), None, 5, "null"), (None, 0, 5, "null")], "path string, offset long, length long, tag string")
    parts = sorted(containers.ranges(odd, str(tmp_path), chunk=300).collect(), key=lambda r: r["chunk_no"])
    assert [r["tag"] for r in parts] == ["k"] * 4 and b"".join(bytes(r["data"]) for r in parts) == files[parts[0]["path"]][5:1005]


def test_packets_of_stored_blocks(spark, tmp_path):
    lib(spark, str(tmp_path))
    index = containers.read(spark, str(tmp_path), "index", "FAILFAST")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    files.join(index, "path").select("path", "seg_no", F.expr("substring(content, cast(data_offset + 1 AS INT), cast(data_length AS INT))").alias("block")).createOrReplaceTempView("blocks_of_files")
    got = spark.sql("SELECT path, seg_no, p.* FROM blocks_of_files, LATERAL packets(block) p")
    want = containers.read(spark, str(tmp_path), "packets", "FAILFAST").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 48
    cut = spark.sql("SELECT b.seg_no, p.packet_no FROM (SELECT seg_no, substring(block, 1, length(block) - 1) AS block FROM blocks_of_files UNION ALL SELECT 0, NULL UNION ALL SELECT -1, X'00') b, LATERAL packets(b.block) p")
    assert cut.count() == 36
    with pytest.raises(Exception, match="cut off"):
        spark.sql("SELECT p.packet_no FROM (SELECT substring(block, 1, length(block) - 1) AS block FROM blocks_of_files) b, LATERAL packets(b.block, true) p").count()


def test_damage_costs_only_what_is_damaged(spark, tmp_path):
    lib(spark, str(tmp_path), movies=3)
    boxes = {p: c.Container(io.BytesIO(p.read_bytes())) for p in sorted(tmp_path.iterdir())}
    (a, box_a), (b, box_b), (d, box_d) = boxes.items()
    second, last = box_a.index()[1], box_b.index()[3]
    raw = bytearray(a.read_bytes())
    raw[second.data_offset] ^= 1
    a.write_bytes(raw)
    b.write_bytes(b.read_bytes()[: last.data_offset + last.data_length - 3])  # the last packet is cut
    d.write_bytes(d.read_bytes()[: c.HEADER.size + 2 * c.ENTRY.size + 7])  # in its index
    rows = containers.read(spark, str(tmp_path), "packets").collect()
    fine = {(r["path"][-6:-4], r["seg_no"], r["packet_no"]) for r in rows if r["corrupt"] is None}
    assert fine == {(m, s, n) for m in ("m0", "m1") for s in range(1, 5) for n in range(1, 5)} - {("m0", 2, n) for n in range(1, 5)} - {("m1", 4, 4)}
    bad = sorted((r["path"][-6:-4], r["seg_no"] or 0, r["segment_id"] or "", r["corrupt"]) for r in rows if r["corrupt"])
    assert bad == [("m0", 2, "s2", "bad block magic"), ("m1", 4, "s4", "block is cut off"), ("m2", 0, "", "index is cut off"), ("m2", 1, "s1", "block is shorter than its header"), ("m2", 2, "s2", "block is shorter than its header")]
    assert containers.read(spark, str(tmp_path), "index").filter("corrupt IS NULL AND path LIKE '%m2.bvf'").count() == 2
    with pytest.raises(Exception, match="bad block magic"):
        containers.read(spark, str(tmp_path), "packets", "FAILFAST").filter("path LIKE '%m0.bvf'").count()
    assert containers.read(spark, str(tmp_path), "packets", "FAILFAST").filter("path LIKE '%m0.bvf' AND seg_no <> 2 AND seg_no >= 3").count() == 8


def test_folders_listed_in_tasks(spark, tmp_path):
    for k in range(3):
        lib(spark, str(tmp_path / f"part{k}" / "deep"), movies=k + 1, segments=1)
    lib(spark, str(tmp_path), movies=1, segments=1)
    (tmp_path / "_staged-x").mkdir()
    (tmp_path / "_staged-x" / "m9.bvf").write_bytes(b"unfinished")
    whole, in_tasks = (containers.read(spark, str(tmp_path), "index", "FAILFAST", listing=how) for how in ("driver", "tasks"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, in_tasks.collect())) and in_tasks.count() == 7
    assert in_tasks.filter("path LIKE '%m2.bvf'").count() == 1 and in_tasks.rdd.getNumPartitions() == 4


def test_written_in_all_tasks(spark):
    """However few bytes the rows have: files take the time."""
    from pyspark.sql import functions as F

    rows = spark.range(64).select(F.col("id").cast("string").alias("movie_id"), F.lit("t").alias("title"), F.lit(10).cast("long").alias("duration_ms"), F.lit(1).alias("seg_no"), F.lit("seg_001").alias("seg_id"), F.lit(0).cast("long").alias("start_ms"), F.lit(10).cast("long").alias("end_ms"),
                                  F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("topics"), F.lit("safe").alias("risk"), F.lit(False).alias("is_filler"), F.expr("cast(map() AS map<string,struct<action:string,segment_id:string>>)").alias("profiles"),
                                  *[F.array(F.struct(F.lit(0).cast("long").alias("pts_ms"), F.lit(b"x").alias("data"))).alias(n) for n in ("video", "audio")])
    from reelwright.sources import containers

    assert containers.stream_of(rows, {}, "x").select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_packets_of_batches_are_those_of_the_table_function(spark):
    from reelwright.sources import container, containers

    good = container.block("s1", None, None)
    rows = [(0, good), (1, None), (2, good[:-1]), (3, good)]
    blocks = spark.createDataFrame(rows, "k int, block binary")
    containers.register(spark)
    want = spark.sql("SELECT b.k, p.* FROM {b} b, LATERAL packets(b.block) p", b=blocks).collect()
    got = containers.packets_of(blocks).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 4
