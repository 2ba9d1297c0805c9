"""Inputs as JSON, captions, and what viewers see of written containers."""

import json

import pytest
from pyspark.sql import functions as F

from reelwright.operators import detect, timeline, viewing
from reelwright.sources import container as c
from reelwright.sources import containers, inputs


def as_of():
    return F.lit("2024-06-30").cast("date")


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(body))


def library(folder):
    """One movie: a plain segment, one with violence that children swap for a filler, one that only has topics, a filler."""
    folder.mkdir()
    play, swap = (lambda s: {"action": "play", "segment_id": s}), {"action": "swap", "segment_id": "fill"}
    segments = [
        {"id": "s1", "start_ms": 0, "end_ms": 100, "tags": [], "risk": "safe", "profiles": {"child": play("s1"), "adult": play("s1")}},
        {"id": "s2", "start_ms": 100, "end_ms": 145, "tags": ["violence"], "risk": "mature", "profiles": {"child": swap, "adult": play("s2")}},
        {"id": "s3", "start_ms": 145, "end_ms": 200, "tags": ["nudity"], "topics": ["drugs"], "risk": "mature", "profiles": {"child": {"action": "skip", "segment_id": "s3"}, "adult": play("gone")}},
        {"id": "fill", "start_ms": 0, "end_ms": 40, "tags": [], "risk": "safe", "is_filler": True, "profiles": {}},
    ]
    blocks = [(s["id"], s["end_ms"] - s["start_ms"], c.block(s["id"], None, None)) for s in segments]
    manifest = c.manifest_json("m", "M", 200, segments, {"child": {"filters": ["violence"]}, "adult": {"filters": {}}}, "x")
    (folder / "m.bvf").write_bytes(b"".join(c.packed(manifest, blocks, 200)))


def test_playback_of_viewers(spark, tmp_path):
    library(tmp_path / "lib")
    v = tmp_path / "viewers"
    put(v, "kid.json", {"birthday": "2016-01-01", "sex": "female"})
    put(v, "grown.json", {"user": {"birthday": "1988-01-01"}})
    put(v, "strict.json", {"name": "film_club", "description": "d", "filters": {"nudity": "mute", "violence": "blur", "drugs": "skip"}})
    put(v, "clash.json", {"name": "child", "filters": {"violence": "play"}})
    viewers = inputs.viewers(spark, str(v))
    assert {r["viewer_id"]: r["kind"] for r in inputs.profile_rows(viewers).collect()} == {"kid": "legacy", "grown": "legacy", "strict": "custom", "clash": "custom"}
    read = lambda t: containers.read(spark, str(tmp_path / "lib"), t)
    profiles = viewing.viewer_profiles(read("manifest"), viewers, as_of())
    got = {}
    for r in viewing.playback(read("segments"), read("index"), profiles).orderBy("viewer_id", "play_no").collect():
        got.setdefault(r["viewer_id"], []).append((r["segment_id"], r["action"], r["target_id"], r["duration_ms"]))
    assert got["kid"] == [("s1", "play", "s1", 100), ("s2", "swap", "fill", 40)]
    assert got["grown"] == [("s1", "play", "s1", 100), ("s2", "play", "s2", 45)]  # the target of s3 is missing
    assert got["strict"] == [("s1", "play", "s1", 100), ("s2", "blur", "s2", 45)]  # skip beats mute in s3
    pairs = read("files").select("path", F.explode(F.array(F.lit("kid"), F.lit("strict"))).alias("viewer_id"))
    few = viewing.viewer_profiles(read("manifest"), viewers, as_of(), views=pairs)
    assert sorted(map(repr, few.collect())) == sorted(repr(r) for r in profiles.collect() if r["viewer_id"] in ("kid", "strict")) and few.count() == 2
    assert "Nested" not in few._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in few._jdf.queryExecution().executedPlan().toString()
    assert got["clash"] == got["kid"]  # a custom profile named like a built-in takes the container's entries


def test_teen_falls_back_unless_strict(spark, tmp_path):
    library(tmp_path / "lib")
    put(tmp_path / "v", "teen.json", {"birthday": "2009-01-01", "sex": "male"})
    manifests, viewers = containers.read(spark, str(tmp_path / "lib"), "manifest"), inputs.viewers(spark, str(tmp_path / "v"))
    assert viewing.viewer_profiles(manifests, viewers, as_of()).first()["profile"] == "adult"
    assert viewing.viewer_profiles(manifests, viewers, as_of(), strict=True).first()["profile"] is None


def test_bad_profile(spark, tmp_path):
    put(tmp_path / "v", "bad.json", {"description": "nothing"})
    with pytest.raises(Exception, match="invalid profile"):
        inputs.profile_rows(inputs.viewers(spark, str(tmp_path / "v"))).collect()


def test_transcripts_and_users(spark, tmp_path):
    put(tmp_path / "t", "movie1.json", {"segments": [{"words": [{"word": " Hi", "start": 0.0, "end": 0.4}]}, {}]})
    words = detect.transcript_words(inputs.transcripts(spark, str(tmp_path / "t")))
    assert [(r["movie_id"], r["word"]) for r in words.collect()] == [("movie1", "hi")]
    put(tmp_path / "u", "config.json", {"DefaultProfile": "teen", "UserProfiles": {"a": {"Birthday": "2010-01-01", "Sex": "male"}, "b": {"ProfileOverride": "child"}}})
    got = {r["user_id"]: (r["birthday"], r["profile_override"], r["default_profile"]) for r in inputs.server_users(spark, str(tmp_path / "u")).collect()}
    assert got == {"a": ("2010-01-01", None, "teen"), "b": (None, "child", "teen")}


def test_captions_become_a_timeline(spark, tmp_path):
    put(tmp_path / "c", "m.json", {"scene": "s", "events": [{"start": 20.0, "end": 30.0, "description": "a fight with a knife"}, {"end": 10.0, "description": "a quiet street"}, {"start": 40.0, "description": "damn it"}]})
    rows = inputs.captions(spark, str(tmp_path / "c")).withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})
    movies = spark.createDataFrame([("m", 60)], "movie_id string, duration bigint")
    full = timeline.fill_gaps(viewing.caption_segments(rows, movies), movies, adjacent=True).orderBy("seg_no").collect()
    assert [(r["start"], r["end"], r["tags"]) for r in full] == [(0, 10, []), (10, 20, []), (20, 30, ["violence"]), (30, 40, []), (40, 60, ["language"])]
