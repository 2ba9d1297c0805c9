"""Whole analyses: from inputs to timelines that containers.write() takes. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.functions import exprs, params
from reelwright.operators import detect, policy, timeline, viewing


def frame_detections(frames: DataFrame, live: float = params.LIVE_THRESHOLD, cartoon: float = params.CARTOON_THRESHOLD) -> DataFrame:
    """movie_id, t, seq, score, tags of frames (movie_id, t, score, is_cartoon) that reach their medium's threshold."""
    hit = frames.filter(F.col("score") >= exprs.nsfw_threshold(F.coalesce("is_cartoon", F.lit(False)), live, cartoon))
    return hit.select("movie_id", "t", F.col("t").alias("seq"), "score", F.array(F.lit("nudity")).alias("tags"))


def analyzed(words: DataFrame, frames: DataFrame, movies: DataFrame, interval: int = 5000, live: float = params.LIVE_THRESHOLD, cartoon: float = params.CARTOON_THRESHOLD) -> DataFrame:
    """The timelines of movies (movie_id, duration) from transcript words (movie_id, word, start_s) and scored frames (movie_id, t, score,
    is_cartoon): words of a bucket and frames over their threshold are detections, detections sessions, and gaps are safe."""
    spoken = words.select("movie_id", "word", exprs.to_ms(F.col("start_s")).alias("start"))
    audio = detect.bucket_detections(spoken, "movie_id", interval).withColumn("seq", F.col("t"))
    both = timeline.build_detections(audio, frame_detections(frames, live, cartoon)).join(movies.select("movie_id", "duration"), "movie_id")
    return timeline.fill_gaps(timeline.sessionize(both, interval, F.col("duration")), movies)


def captioned(captions: DataFrame, movies: DataFrame) -> DataFrame:
    """The timelines of movies from caption events in milliseconds, one segment each."""
    return timeline.fill_gaps(viewing.caption_segments(captions, movies), movies, adjacent=True)


def for_containers(spark: SparkSession, segments: DataFrame, movies: DataFrame, profiles: dict[str, dict[str, str]], title: Column | None = None) -> DataFrame:
    """Rows for containers.write(), without packets, of timelines and movies (movie_id, duration)."""
    actions = policy.profiles_column(policy.profile_matrix(segments, policy.profiles_table(spark, profiles)), ["movie_id", "seg_no"])
    rows = segments.join(actions, ["movie_id", "seg_no"]).join(movies.select("movie_id", F.col("duration").alias("duration_ms"), (title if title is not None else F.col("movie_id").cast("string")).alias("title")), "movie_id")
    none = F.lit(None).cast("array<struct<pts_ms:long,data:binary>>")
    return rows.select(F.col("movie_id").cast("string").alias("movie_id"), "title", F.col("duration_ms").cast("long").alias("duration_ms"), "seg_no", exprs.checked_id(F.col("seg_id")).alias("seg_id"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "tags",
                       F.array().cast("array<string>").alias("topics"), "risk", F.lit(False).alias("is_filler"), "profiles", none.alias("video"), none.alias("audio"))
