"""Detections: words and scores to tagged times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import exprs, params


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """movie_id, seq, word, start_s, end_s of transcripts (movie_id, segments: array<struct<words: array<struct<word, start, end>>>>)."""
    words = F.flatten(F.transform("segments", lambda s: F.coalesce(s["words"], F.array().cast("array<struct<word:string,start:double,end:double>>"))))
    return transcripts.select("movie_id", F.posexplode(words).alias("seq", "_w")).select("movie_id", "seq", exprs.clean_word(F.col("_w.word")).alias("word"), F.col("_w.start").alias("start_s"), F.col("_w.end").alias("end_s"))


def text_words(texts: DataFrame, key: str, step: int | None = None) -> DataFrame:
    """key, pos, word of each white-space token of texts (key, text); step: also start, a word's place times step."""
    rows = texts.select(key, F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "_w"))
    rows = rows.select(key, "pos", exprs.clean_word(F.col("_w")).alias("word"))
    return rows if step is None else rows.withColumn("start", F.col("pos").cast("bigint") * step)


def clean_words(text: str) -> Column:
    """All white-space tokens of a text, cleaned, as an array; none for a null text. The text is lowered once, not each word."""
    return F.coalesce(F.transform(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""), lambda w: F.btrim(w, F.lit("'\""))), F.array().cast("array<string>"))


def text_buckets(texts: DataFrame, key: str, interval: int, step: int, keywords: list[str] | None = None, tag: str = "language") -> DataFrame:
    """bucket_detections() of texts (key, text) whose words stand `step` apart, made row by row: no word is shuffled."""
    known = F.array(*[F.lit(w) for w in keywords or params.PROFANITY])
    at = F.transform(clean_words("text"), lambda w, i: F.when(F.array_contains(known, w), F.floor(i.cast("bigint") * step / interval) * interval))
    return texts.select(key, F.explode(F.array_distinct(F.array_compact(at)).cast("array<bigint>")).alias("t")).withColumn("tags", F.array(F.lit(tag)))


def text_keywords(texts: DataFrame, key: str, keywords: Sequence[tuple[str, str, int]], thresholds: dict[str, int], least: int = 2) -> DataFrame:
    """keyword_hits() of texts (key, text), for keywords (tag, keyword, weight) and thresholds by tag, made row by row."""
    words = F.array_distinct(clean_words("text"))
    hits = []
    for tag in sorted({t for t, _, _ in keywords}):
        total = F.lit(0).cast("bigint")
        for _, word, weight in (k for k in keywords if k[0] == tag):
            total = total + F.when(F.array_contains("_w", word), F.lit(weight)).otherwise(0)
        hits.append(F.when(total >= thresholds.get(tag, least), F.struct(F.lit(tag).alias("tag"), total.alias("weight"))))
    return texts.select(key, words.alias("_w")).select(key, F.inline(F.array_compact(F.array(*hits))))


def bucket_detections(words: DataFrame, key: str, interval: int, keywords: list[str] | None = None, tag: str = "language") -> DataFrame:
    """key, t, tags: each interval in which a word of keywords starts (words: key, word, start). The bucket is a quotient, not a range join."""
    hit = words.filter(F.col("word").isin(*(keywords or params.PROFANITY)))
    return hit.select(key, (F.floor(F.col("start") / interval) * interval).cast("bigint").alias("t")).distinct().withColumn("tags", F.array(F.lit(tag)))


def keyword_hits(words: DataFrame, key: str, keywords: DataFrame, thresholds: Column) -> DataFrame:
    """key, tag, weight of the tags whose keywords (tag, keyword, weight), each counted once per key, reach the threshold for `tag`."""
    met = words.select(key, F.col("word").alias("keyword")).join(F.broadcast(keywords), "keyword")  # a parameter table
    return met.select(key, "tag", "keyword", "weight").distinct().groupBy(key, "tag").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= thresholds)


def above_threshold(frames: DataFrame, score: Column, is_cartoon: Column) -> DataFrame:
    return frames.withColumn("threshold", exprs.nsfw_threshold(is_cartoon)).filter(score >= F.col("threshold"))


def silence_ratio(words: DataFrame) -> DataFrame:
    """movie_id, ratio: the share of the time from the first word's start to the last one's end in which nobody speaks, first and last in
    the order of seq. words: movie_id, seq, start, end (whole numbers). No span: 0. Movies without words: not here; their ratio is 1."""
    s = words.groupBy("movie_id").agg(F.sum(F.col("end") - F.col("start")).alias("_speech"), F.max_by("end", "seq").alias("_end"), F.min_by("start", "seq").alias("_start"))
    span = F.col("_end") - F.col("_start")
    return s.select("movie_id", F.when(span <= 0, F.lit(0.0)).otherwise(exprs.clamp(F.lit(1.0) - F.col("_speech") / span)).alias("ratio"))
