"""Viewers, profiles and actions."""

import pytest
from pyspark.sql import functions as F

from reelwright.functions import exprs, params
from reelwright.operators import playback, policy, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("born", "as_of", "age"), [("2010-01-01", "2023-01-01", 13), ("2010-01-02", "2023-01-01", 12), ("2000-02-29", "2013-02-28", 12), ("2000-02-29", "2013-03-01", 13)])
def test_completed_years(spark, born, as_of, age):
    assert value(spark, policy.completed_years(F.lit(born).cast("date"), F.lit(as_of).cast("date"))) == age


def test_fractional_years_differ_at_the_edge(spark):
    assert value(spark, policy.fractional_years(F.lit("2010-01-01").cast("date"), F.lit("2023-01-01").cast("date"))) < 13


@pytest.mark.parametrize(("override", "born", "sex", "default", "want"), [
    ("teen_f", "2020-01-01", "male", None, "teen_f"), ("", "2020-01-01", "male", None, "child"), (None, "2008-01-01", "FEMALE", None, "teen_f"), (None, "2008-01-01", "m", None, "teen_m"),
    (None, "1980-01-01", None, "child", "adult"), (None, "not a date", "male", "child", "child"), (None, None, None, None, "adult"), (None, "", "", "", "adult")])
def test_preferred_profile(spark, override, born, sex, default, want):
    s = lambda x: F.lit(x).cast("string")
    assert value(spark, policy.preferred_profile(s(override), s(born), s(sex), F.lit("2024-06-30").cast("date"), s(default))) == want


@pytest.mark.parametrize(("preferred", "there", "want", "strict"), [
    ("child", ["child", "adult"], "child", "child"), ("teen_m", ["teen", "adult"], "teen", "teen"), ("child", ["adult", "teen"], "adult", None), ("x", ["teen", "teen_f"], "teen_f", None), ("x", ["b", "a"], "a", None), (None, ["child"], "child", None), ("x", [], "x", None)])
def test_available_profile(spark, preferred, there, want, strict):
    names = F.array(*[F.lit(x) for x in there]).cast("array<string>")
    assert value(spark, policy.available_profile(F.lit(preferred).cast("string"), names)) == want
    assert value(spark, policy.available_profile(F.lit(preferred).cast("string"), names, strict=True)) == strict


@pytest.mark.parametrize(("labels", "want"), [(["nudity", "drugs"], "skip"), (["nudity", "violence"], "swap"), (["violence", "alcohol"], "blur"), (["alcohol"], "mute"), (["x"], "play"), ([], "play")])
def test_most_restrictive(spark, labels, want):
    strict = policy.filters_map({"profanity": "skip", "nudity": "swap", "violence": "blur", "drugs": "skip", "alcohol": "mute"})
    assert value(spark, policy.most_restrictive(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), strict)) == want


def test_list_form_of_filters(spark):
    tags = F.array(F.lit("nudity"), F.lit("gore"))
    assert value(spark, policy.list_filters(tags, F.lit("swap"))) == {"nudity": "swap", "gore": "swap"}


SEG = "movie_id string, seg_no int, seg_id string, start bigint, end bigint, tags array<string>, risk string, action string, profile_segment_id string, is_filler boolean"
PROFILES = {"child": {"nudity": "swap", "violence": "swap", "language": "swap"}, "teen": {"nudity": "swap"}, "adult": {}}


def trio(spark):
    return spark.createDataFrame([
        ("m", 1, "seg_001", 0, 300_000, [], "safe", "play", None, False), ("m", 2, "seg_002", 300_000, 345_000, ["violence", "gore"], "mature", "swap", "filler_001", False),
        ("m", 3, "filler_001", 0, 45_000, [], "safe", "play", None, True), ("m", 4, "seg_003", 345_000, 600_000, [], "safe", "play", None, False)], SEG)


def index(segments):
    return segments.select("movie_id", F.col("seg_id").alias("target_id"), (F.col("end") - F.col("start")).alias("duration"))


def test_matrix_and_sequence(spark):
    m = policy.profile_matrix(trio(spark), policy.profiles_table(spark, PROFILES))
    got = {r["profile"]: (r["profile_action"], r["target_id"]) for r in m.filter("seg_id = 'seg_002'").collect()}
    assert got == {"child": ("swap", "filler_001"), "teen": ("play", "seg_002"), "adult": ("play", "seg_002")}
    seq = playback.sequence(m, index(trio(spark))).cache()
    child = [(r["play_no"], r["seg_id"], r["profile_action"], r["target_id"]) for r in seq.filter("profile = 'child'").orderBy("play_no").collect()]
    assert child == [(1, "seg_001", "play", "seg_001"), (2, "seg_002", "swap", "filler_001"), (3, "seg_003", "play", "seg_003")]
    info = {r["profile"]: (r["segments"], r["duration"], r["swapped"]) for r in playback.playback_info(seq).collect()}
    assert info["adult"] == (3, 600_000, 0) and info["child"] == (3, 600_000, 1)
    positions = spark.createDataFrame([("m", p) for p in (150_000, 300_000, 1_000_000)], "movie_id string, position bigint")
    half = {r["position"]: (r["seg_id"], r["offset"]) for r in playback.seek(seq.filter("profile = 'adult'"), positions).collect()}
    assert half == {150_000: ("seg_001", 150_000), 300_000: ("seg_002", 0), 1_000_000: ("seg_003", 655_000)}
    closed = {r["position"]: r["seg_id"] for r in playback.seek(seq.filter("profile = 'adult'"), positions, closed=True).collect()}
    assert closed[300_000] == "seg_001"
    pat = [r["adjusted_start"] for r in playback.adjusted_times(seq.filter("profile = 'child'")).orderBy("play_no").collect()]
    assert pat == [0, 300_000, 345_000]


def test_untagged_mature_is_filtered_for_all_and_missing_targets_drop_out(spark):
    s = trio(spark).withColumn("tags", F.array().cast("array<string>"))
    m = policy.profile_matrix(s, policy.profiles_table(spark, PROFILES))
    assert {r["target_id"] for r in m.filter("seg_id = 'seg_002'").collect()} == {"filler_001"}
    seq = playback.sequence(m, index(trio(spark)).filter("target_id <> 'filler_001'"))
    assert [r["seg_id"] for r in seq.filter("profile = 'adult'").orderBy("play_no").collect()] == ["seg_001", "seg_003"]
    assert playback.unreferenced_fillers(spark.createDataFrame([("m", "filler_001"), ("m", "f2")], "movie_id string, seg_id string"), m).count() == 1
    none = m.withColumn("target_id", F.col("seg_id"))
    assert playback.self_swaps(none).count() == 3


def test_skip_leaves_the_sequence_and_flags(spark):
    s = trio(spark).withColumn("action", F.when(F.col("seg_id") == "seg_002", "skip").otherwise(F.col("action")))
    m = policy.profile_matrix(s, policy.profiles_table(spark, PROFILES))
    assert [r["seg_id"] for r in playback.sequence(m, index(s)).filter("profile = 'child'").orderBy("play_no").collect()] == ["seg_001", "seg_003"]
    flags = policy.action_flags(F.lit("odd"))
    assert value(spark, flags["playable"]) and not value(spark, flags["is_skip"])


def test_enumerations_reject_unknown_names(spark):
    assert [value(spark, exprs.action_code(F.lit(a))) for a in ("play", "swap", "skip", "mute", "blur")] == [0, 1, 2, 3, 4]
    for bad in (exprs.risk_code(F.lit("evil")), exprs.action_code(F.lit("destroy")), exprs.checked_id(F.lit("x" * 17))):
        with pytest.raises(Exception, match=r"unknown|longer"):
            value(spark, bad)
    assert value(spark, exprs.checked_id(F.lit("x" * 16))) == "x" * 16


def test_caption_tags_and_topics(spark):
    tags = lambda t: value(spark, exprs.caption_tags(F.lit(t)))
    assert tags("A white wall") == [] and tags("a NAKED man") == ["nudity"] and tags("a hit") == [] and tags("a hit and a kick") == ["violence"] and tags("oh, damn!") == ["language"]
    assert params.keyword_weights()["nudity"]["naked"] == 5 and params.keyword_weights()["nudity"]["nude"] == 4
    topics = lambda t: value(spark, exprs.parsed_topics(F.lit(t)))
    assert topics('x ["profanity","nope"] y') == ["profanity"] and topics("politics and war_military") == ["politics", "war_military"] and topics("") == []


def test_classifier_and_overlap(spark):
    segments = spark.createDataFrame([("m", 1, 0, 10), ("m", 2, 10, 40), ("m", 3, 40, 50)], "movie_id string, seg_no int, start bigint, end bigint")
    words = spark.createDataFrame([("m", 0, "politics", 0, 4), ("m", 1, "and", 8, 12), ("m", 2, "crime", 12, 39), ("n", 0, "drugs", 0, 50)], "movie_id string, seq int, word string, start bigint, end bigint")
    for bucket in (3, 1000):
        texts = text.overlap_text(segments, words, bucket)
        assert sorted((r["seg_no"], r["text"]) for r in texts.collect()) == [(1, "politics and"), (2, "and crime"), (3, "")]
    got = text.with_topics(segments, text.classify_topics(texts))
    assert sorted((r["seg_no"], r["topics"]) for r in got.collect()) == [(1, ["politics"]), (2, ["crime"]), (3, [])]


def test_failing_client_gives_no_topics(spark):
    def broken():
        def ask(_):
            raise OSError("down")

        return ask

    df = spark.createDataFrame([("politics",)], "text string")
    assert text.classify_topics(df, broken).first()["topics"] == []


def test_scores(spark):
    v = lambda c: value(spark, c)
    assert v(exprs.checker_confidence(F.lit(None).cast("double"))) == 0.5 and v(exprs.checker_confidence(F.lit(3.0))) == 1.0
    assert [v(exprs.silence_weighted(F.lit(0.8), F.lit(r))) for r in (0.9, 0.2, 0.7)] == [0.4, 0.8, 0.8]
    assert v(exprs.any_flag(F.lit(False), F.lit(0.31), F.lit(False))) and not v(exprs.any_flag(F.lit(False), F.lit(0.3), F.lit(False)))
    assert v(exprs.cartoon_by_features(F.lit(180.0), F.lit(0.0))) and not v(exprs.cartoon_by_features(F.lit(60.0), F.lit(0.1)))
    assert v(exprs.cartoon_by_saturation(F.lit(0.5), F.lit(50)))
    skin = v(exprs.skin_verdict(F.lit(0.5), F.lit(0.2)))
    assert skin["flag"] and skin["confidence"] == 1.0
    assert abs(v(exprs.softmax_second(F.lit(0.0), F.lit(0.0))) - 0.5) < 1e-12
    assert v(exprs.to_ms(F.lit(360.5))) == 360500 and v(exprs.duration_ms(*[F.lit(x).cast("bigint") for x in (None, None, 5, 9)])) == 4
    assert v(exprs.codec_name(F.lit(0x101))) == "Opus" and v(exprs.codec_name(F.lit(0xABC))) == "Unknown (0x00000ABC)"
    assert v(exprs.has_flag(F.lit(0b1001), "seekable")) and not v(exprs.has_flag(F.lit(0b1001), "chapters"))


def test_path_resolution(spark):
    def path(risk, action, tags, filters, choice):
        a = lambda x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
        r = value(spark, policy.path_resolution(F.lit(risk), F.lit(action), a(tags), a(filters), F.lit(choice).cast("string"), F.lit("seg_007"), F.lit("/m"), F.lit("/f")))
        return r["swap_type"], r["path"]

    assert path("safe", "play", [], ["gore"], None) == ("original", "/m/seg_007.ts")
    assert path("mature", "swap", ["fear"], ["gore"], None) == ("original", "/m/seg_007.ts")
    assert path("mature", "swap", ["gore"], ["gore"], "filler_9") == ("filler", "/f/filler_9.ts")
    assert path("mature", "swap", ["gore"], ["gore"], "other") == ("skip", "")
    assert path("mature", "swap", ["gore"], ["gore"], None) == ("skip", "")
    assert path("mature", "swap", ["gore"], ["gore"], "original") == ("original", "/m/seg_007.ts")


def test_index_and_library(spark):
    idx = spark.createDataFrame([("m", "a", 1, 10), ("m", "a", 2, 20)], "movie_id string, id string, seq int, n int")
    assert playback.index_lookup(idx, ["movie_id", "id"], "seq").first()["n"] == 20
    manifest = spark.createDataFrame([("m", "b", "mature", ["x"])], "movie_id string, id string, risk string, tags array<string>")
    r = playback.index_with_manifest(idx.limit(1), manifest, ["movie_id", "id"]).first()
    assert r["risk"] == "safe" and r["tags"] == []
    videos = spark.createDataFrame([("/a/x.mp4",), ("/a/y.mkv",)], "path string")
    assert [r["path"] for r in playback.library(videos, spark.createDataFrame([("/a/x.bvf",)], "path string")).collect()] == ["/a/x.mp4"]
    blocks = spark.createDataFrame([(i, i * 3 + 1) for i in range(9000)], "n bigint, len bigint")
    got = playback.block_offsets(blocks, [], "n", "len", F.lit(64)).orderBy("n").collect()
    at = 64
    for r in got:
        assert r["offset"] == at
        at += r["len"]
