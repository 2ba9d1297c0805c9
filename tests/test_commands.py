"""Commands end to end, and the parts of containers that they don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from reelwright import __main__ as commands
from reelwright.functions import exprs
from reelwright.operators import playback, policy
from reelwright.sources import containers, inputs


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_analysis_to_playback(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "m1.json").write_text(json.dumps({"segments": [{"words": [{"word": " Damn! ", "start": 1.0, "end": 1.2}, {"word": "damn", "start": 21.0, "end": 21.4}]}, {"words": None}]}))
    spark.createDataFrame([("m1", 30_000, 0.7, False), ("m1", 40_000, 0.7, True), ("m2", 0, 0.1, None)], "movie_id string, t long, score double, is_cartoon boolean").write.parquet(str(tmp_path / "frames"))
    spark.createDataFrame([("m1", 60_000), ("m2", 9_000)], "movie_id string, duration long").write.parquet(str(tmp_path / "movies"))
    commands.main(["analyze", str(tmp_path / "t"), str(tmp_path / "frames"), str(tmp_path / "movies"), str(tmp_path / "lib")])
    assert {x["movie_id"]: x["segments"] for x in said(capsys)} == {"m1": 5, "m2": 1}
    rows = containers.read(spark, str(tmp_path / "lib"), "segments", "FAILFAST").filter("movie_id = 'm1'").orderBy("seg_no").collect()
    assert [(r["start_ms"], r["end_ms"], r["tags"]) for r in rows] == [(0, 20_000, []), (20_000, 25_000, ["language"]), (25_000, 30_000, []), (30_000, 35_000, ["nudity"]), (35_000, 60_000, [])]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "kid.json").write_text(json.dumps({"birthday": "2018-01-01"}))
    (tmp_path / "v" / "own.json").write_text(json.dumps({"name": "own", "filters": {"nudity": "skip"}}))
    commands.main(["info", str(tmp_path / "lib"), str(tmp_path / "v"), "--as-of", "2024-06-30"])
    info = {(x["path"].rsplit("/", 1)[1], x["viewer_id"]): x for x in said(capsys)}
    assert info["m1.bvf", "kid"]["entries"] == 5 and info["m1.bvf", "own"]["duration_ms"] == 55_000 and info["m2.bvf", "kid"]["entries"] == 1
    commands.main(["list", str(tmp_path / "lib"), str(tmp_path / "v"), "--as-of", "2024-06-30"])
    assert len(said(capsys)) == 5 + 4 + 2


def test_captions_demo_and_mux(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "m.json").write_text(json.dumps({"scene": "s", "events": [{"start": 1.0, "end": 2.5, "description": "A knife, blood."}, {"start": 4.0, "description": "calm"}]}))
    movies = str(tmp_path / "movies")
    spark.createDataFrame([("m", 6_000)], "movie_id string, duration long").write.parquet(movies)
    commands.main(["captions", str(tmp_path / "c"), movies, str(tmp_path / "a")])
    commands.main(["demo", movies, str(tmp_path / "b")])
    assert [x["segments"] for x in said(capsys)] == [4, 3]
    rows = containers.read(spark, str(tmp_path / "a")).orderBy("seg_no").collect()
    assert [(r["start_ms"], r["end_ms"], r["tags"], r["risk"]) for r in rows] == [(0, 1000, [], "safe"), (1000, 2500, ["violence"], "mature"), (2500, 4000, [], "safe"), (4000, 6000, [], "safe")]
    packet = "array<struct<pts_ms:long,data:binary>>"
    schema = f"movie_id string, title string, duration_ms long, seg_no int, seg_id string, start_ms long, end_ms long, tags array<string>, topics array<string>, risk string, is_filler boolean, profiles map<string,struct<action:string,segment_id:string>>, video {packet}, audio {packet}, video_info struct<width:int,height:int>, chapters array<struct<title:string,start_ms:long,end_ms:long>>"
    rows = [(i, "T", 10, n, f"s{n}", 0, 10, [], [], "safe", False, {}, None, None, (640, 360), [("One", 0, 10)]) for i in ("a/b", "..", ".hidden", "Фильм") for n in (1, 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "segments"))
    commands.main(["mux", str(tmp_path / "segments"), str(tmp_path / "d")])
    assert {x["movie_id"] for x in said(capsys)} == {"a/b", "..", ".hidden", "Фильм"} and len(list((tmp_path / "d").iterdir())) == 4
    manifest = containers.read(spark, str(tmp_path / "d"), "manifest", "FAILFAST")
    assert {r["movie_id"] for r in manifest.collect()} == {"a/b", "..", ".hidden", "Фильм"}
    body = json.loads(manifest.first()["manifest"])
    assert body["video_info"] == {"width": 640, "height": 360} and body["chapters"][0]["title"] == "One"
    assert containers.read(spark, str(tmp_path / "d"), "index", files=json.dumps(["a%2Fb.bvf"])).count() == 2
    nameless = spark.createDataFrame([(None, *rows[0][1:])], schema)
    with pytest.raises(Exception, match="needs a movie_id"):
        containers.write(nameless, str(tmp_path / "e"), {}).collect()


def test_accessors(spark, tmp_path):
    index = spark.createDataFrame([("p", 1, "a", 5), ("p", 2, "b", 6), ("p", 3, "a", 7), ("q", 1, "c", 8)], "path string, seg_no int, segment_id string, duration_ms long")
    asked = spark.createDataFrame([("p", "a"), ("q", "zz")], "path string, segment_id string")
    assert {r["segment_id"]: r["duration_ms"] for r in containers.by_id(asked, index, strict=False).collect()} == {"a": 5, "zz": None}
    with pytest.raises(Exception, match="'zz' is not in the index of q"):
        containers.by_id(asked, index).collect()
    assert {r["segment_id"] for r in containers.block_at(index, 0).collect()} == {"a", "c"}
    with pytest.raises(Exception, match="segment 2 is not in 0 .. 0 of q"):
        containers.block_at(index, 2).collect()
    empty = containers.write(spark.createDataFrame([], "movie_id string, title string, duration_ms long, seg_no int, seg_id string, start_ms long, end_ms long, tags array<string>, topics array<string>, risk string, is_filler boolean, profiles map<string,struct<action:string,segment_id:string>>, video array<struct<pts_ms:long,data:binary>>, audio array<struct<pts_ms:long,data:binary>>"), str(tmp_path / "none"), {})
    assert empty.count() == 0


def test_sequences_and_payloads(spark):
    matrix = spark.createDataFrame([("m", "p", n, f"s{n}", a, f"s{n}", 10 * n, 10 * n + 10, n == 4) for n, a in ((1, "play"), (2, "mute"), (3, "skip"), (4, "play"), (5, "play"))], "movie_id string, profile string, seg_no int, seg_id string, profile_action string, target_id string, start long, end long, is_filler boolean")
    index = spark.createDataFrame([("m", f"s{n}", n, 10) for n in range(1, 6)] + [("m", "s1", 9, 4)], "movie_id string, target_id string, entry_no int, duration long")
    seq = playback.sequence(matrix, index)
    assert [(r["seg_id"], r["duration"]) for r in seq.orderBy("play_no").collect()] == [("s1", 4), ("s2", 10), ("s5", 10)]
    at = spark.createDataFrame([("m", p) for p in (0, 3, 4, 14, 23, 24, 99)], "movie_id string, position long")
    for closed, want in ((False, [1, 1, 2, 3, 3, 3, 3]), (True, [1, 1, 1, 2, 3, 3, 3])):
        assert [r["play_no"] for r in playback.seek(seq, at, closed).orderBy("position").collect()] == want
    packets = spark.createDataFrame([("m", t, n, k, d) for t in ("s1", "s2") for n, k, d in ((2, 1, b"w"), (1, 1, b"v"), (3, 2, b"a"))] + [("m", "s5", 1, 2, b"")], "movie_id string, target_id string, packet_no int, packet_type int, data binary")
    rows = playback.exported(seq, packets).orderBy("play_no").collect()
    assert [(r["file"], r["line"], r["duration_line"], bytes(r["payload"])) for r in rows] == [("seg_000.ts", "file 'seg_000.ts'", "duration 0.004", b"vwa"), ("seg_001.ts", "file 'seg_001.ts'", "duration 0.010", b"vw")]
    assert {r["position"]: r["payload"] and bytes(r["payload"]) for r in playback.served(seq, at, packets).collect()} == {0: b"vwa", 3: b"vwa", 4: b"vw", 14: None, 23: None, 24: None, 99: None}


def test_rounding_and_previews(spark):
    df = spark.createDataFrame([(0, 0.0), (4, 0.0), (5, 0.0), (15, 0.02), (25, 0.02), (26, 0.03), (1234567, 1234.57)], "ms long, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", exprs.hundredths(F.col("ms"))).collect())
    people = spark.createDataFrame([("2020-01-01", None), ("2009-01-01", "Female"), ("1980-01-01", "male"), ("", "male"), (None, None)], "born string, sex string")
    assert [r[0] for r in people.select(policy.profile_preview(F.col("born"), F.col("sex"), F.lit("2024-06-30").cast("date"))).collect()] == ["child", "teen_f", "adult", "—", "—"]
    rows = spark.createDataFrame([(["a", "b"], ["t"]), ([], None), (None, ["t"])], "tags array<string>, topics array<string>")
    assert [r["resolved_action"] for r in policy.resolve_segments(rows, policy.filters_map({"b": "mute", "t": "skip"})).collect()] == ["skip", "play", "skip"]


def test_files_of_inputs(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.json", '{"birthday": "2000-01-01"}')], "name string, body string")
    assert [r["name"] for r in inputs.write_files(rows, str(tmp_path / "f")).collect()] == ["a%2Fb.json"]
    assert inputs.viewers(spark, str(tmp_path / "f")).first()["birthday"] == "2000-01-01"
