"""Timelines: detections to segments to a gapless, numbered timeline.

Times are whole numbers (bigint) of any one unit. Every window is partitioned by movie_id, so movies are spread over the cluster and each
operator needs one shuffle; operators that follow each other reuse its partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.functions import exprs
from reelwright.sources.shared import kept


def _empty() -> Column:
    return F.array().cast("array<string>")


def build_detections(audio: DataFrame, visual: DataFrame) -> DataFrame:
    """Both kinds in one table, ordered keys added: audio goes before visual at the same time (movie_id, t, kind, tags, bad_end, seq)."""
    a = audio.select("movie_id", "t", F.lit("audio").alias("kind"), "tags", F.lit(None).cast("bigint").alias("bad_end"), F.lit(1.0).alias("score"), "seq")
    tags = F.col("tags") if "tags" in visual.columns else F.array(F.lit("nudity"))
    end = F.col("bad_end") if "bad_end" in visual.columns else F.lit(None).cast("bigint")
    v = visual.select("movie_id", "t", F.lit("visual").alias("kind"), tags.alias("tags"), end.alias("bad_end"), "score", "seq")
    return a.unionByName(v).withColumn("seq", F.struct((F.col("kind") == "visual").cast("int").alias("source"), F.col("seq").alias("n")))


def sessionize(detections: DataFrame, interval: int, duration: Column | int, order: str = "seq") -> DataFrame:
    """Groups of detections no further apart than `interval` from start to start: movie_id, group_no, start, end, tags, n.

    detections: movie_id, t, tags, optionally bad_end, and `order`, which breaks ties of t. A detection without bad_end lasts `interval`.
    """
    duration = duration if isinstance(duration, Column) else F.lit(duration)
    by = Window.partitionBy("movie_id").orderBy("t", order)
    end = F.least(F.col("t") + interval, duration)
    if "bad_end" in detections.columns:
        end = F.coalesce(F.col("bad_end"), end)
    rows = detections.withColumns({"_end": end, "_d": duration, "_new": F.coalesce((F.col("t") - F.lag("t").over(by) > interval).cast("int"), F.lit(0))})
    rows = rows.withColumn("group_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return rows.groupBy("movie_id", "group_no").agg(
        F.min("t").alias("start"), F.least(F.max("_end"), F.max("_d")).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count("*").alias("n"))


def classified(segments: DataFrame) -> DataFrame:
    """With risk and action from the tags."""
    return segments.withColumns({"risk": exprs.risk_of(F.col("tags")), "action": exprs.action_of(F.col("tags"))})


def _numbered(parts: DataFrame) -> DataFrame:
    by = Window.partitionBy("movie_id").orderBy("_at", "start", "end")
    return parts.withColumn("seg_no", F.row_number().over(by)).withColumn("seg_id", exprs.segment_id(F.col("seg_no"))).drop("_at")


def fill_gaps(segments: DataFrame, movies: DataFrame, adjacent: bool = False) -> DataFrame:
    """movie_id, seg_no, seg_id, start, end, tags, risk, action: the segments, and safe ones wherever none reaches.

    segments: movie_id, start, end, tags, and group_no for their order. movies: movie_id, duration, of every movie: one without segments is
    a single safe one. A gap is measured from the furthest end so far; `adjacent`: from the end of the segment just before.
    """
    by = Window.partitionBy("movie_id").orderBy("group_no")
    before = F.lag("end").over(by) if adjacent else F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.select("movie_id", "group_no", "start", "end", "tags", F.coalesce(before, F.lit(0)).cast("bigint").alias("_before"))
    # A segment and the gap before it come from one row, so nothing is read or shuffled twice.
    own = F.struct((F.col("group_no") * 2 + 1).alias("_at"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("tags").alias("tags"))
    gap = F.struct((F.col("group_no") * 2).alias("_at"), F.col("_before").alias("start"), F.col("start").cast("bigint").alias("end"), _empty().alias("tags"))
    parts = rows.select("movie_id", F.inline(F.when(F.col("start") > F.col("_before"), F.array(gap, own)).otherwise(F.array(own))))
    last = segments.groupBy("movie_id").agg((F.max_by("end", "group_no") if adjacent else F.max("end")).alias("_last"), F.max("group_no").alias("_g"))
    tail = movies.join(last, "movie_id", "left").withColumn("_last", F.coalesce("_last", F.lit(0)).cast("bigint")).filter(F.col("_last") < F.col("duration"))
    tail = tail.select("movie_id", (F.coalesce("_g", F.lit(0)) * 2 + 2).alias("_at"), F.col("_last").alias("start"), F.col("duration").cast("bigint").alias("end"), _empty().alias("tags"))
    return classified(_numbered(parts.unionByName(tail)))


def risk_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("movie_id").agg(F.count("*").alias("n"), F.count_if(F.col("risk") == "safe").alias("safe"), F.count_if(F.col("risk") == "mature").alias("mature"))


def coverage(segments: DataFrame) -> DataFrame:
    """movie_id, covered: the length of the union of the segments, overlaps counted once."""
    by = Window.partitionBy("movie_id").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reached))).groupBy("movie_id").agg(F.sum("_new").alias("covered"))


def demo_thirds(movies: DataFrame) -> DataFrame:
    """Safe, language, safe thirds of each movie; empty parts are left out (movie_id, seg_no, seg_id, start, end, tags, risk, action)."""
    d = F.col("duration")
    cuts = [F.lit(0).cast("bigint"), F.floor(d / 3).cast("bigint"), F.floor(d * 2 / 3).cast("bigint"), d.cast("bigint")]
    parts = [F.struct(F.lit(i).alias("_at"), cuts[i].alias("start"), cuts[i + 1].alias("end"), (F.array(F.lit("language")) if i == 1 else _empty()).alias("tags")) for i in range(3)]
    rows = movies.select("movie_id", F.inline(F.array(*parts))).filter(F.col("end") > F.col("start"))
    return classified(_numbered(rows))


def sample_grid(movies: DataFrame, interval: int) -> DataFrame:
    """movie_id, sample_no, t: one sample per interval, one at least."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / interval))
    return movies.select("movie_id", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("sample_no", "_k")).select("movie_id", "sample_no", (F.col("_k") * interval).cast("bigint").alias("t"))


def refined_bounds(samples: DataFrame, step: int) -> DataFrame:
    """movie_id, bad_start, bad_end of each run of bad samples on a scored grid (movie_id, t, bad): the end is the first safe time after it."""
    by = Window.partitionBy("movie_id").orderBy("t")
    rows = samples.withColumn("_run", F.sum((~F.col("bad")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("bad").groupBy("movie_id", "_run").agg(F.min("t").alias("bad_start"), (F.max("t") + step).alias("bad_end")).drop("_run")


#: What scores probes: rows of movie_id, t and more to the same with `bad` (boolean; null: the probe failed).
Scorer = Callable[[DataFrame], DataFrame]


def bisected_bounds(found: DataFrame, movies: DataFrame, scorer: Scorer, precision: float, more: Sequence[str] = (), forward: bool = True) -> DataFrame:
    """found (movie_id, t: a time known to be bad, columns `more` that the scorer needs, and others) with bad_start and bad_end: where what is
    bad begins and has ended, to `precision`, by bisection between the known time and the movie's start and end (movies: movie_id, duration).
    forward=False gives the movie's end as bad_end instead, without a search.

    All searches of all movies go in step: a round probes the middle of every open interval, each distinct probe once, in one call of the
    scorer, and halves them; there are as many rounds as the longest interval needs. A failed probe ends its search with the bounds so far. A
    table holds the intervals between rounds. Times are doubles; the first known bad time, or the first safe one after, is told. A null t, or
    a movie without a duration, gives nulls; equal rows search once.
    """
    key = ["movie_id", "t", *more]
    places = found.select(*key).filter(F.col("t").isNotNull()).distinct().join(movies.select("movie_id", F.col("duration").cast("double").alias("_duration")), "movie_id")
    t = F.col("t").cast("double")
    sides = [F.struct(F.lit("start").alias("side"), F.lit(0.0).alias("safe"), t.alias("bad"))] + [F.struct(F.lit("end").alias("side"), F.col("_duration").alias("safe"), t.alias("bad"))] * forward
    state = places.select(*key, "_duration", F.inline(F.array(*sides)))
    wide = F.abs(F.col("safe") - F.col("bad")) > precision
    state = kept(state.withColumn("open", F.coalesce(wide, F.lit(False))))
    done = []
    while True:
        opened = state.filter("open")
        done.append(state.filter("NOT open"))
        if opened.isEmpty():
            break
        asked = opened.withColumn("_probe", (F.col("safe") + F.col("bad")) / 2)
        probes = asked.select("movie_id", F.col("_probe").alias("t"), *more).distinct()
        answers = scorer(probes).select(F.col("movie_id").alias("_m"), F.col("t").alias("_p"), *[F.col(c).alias(f"_{c}") for c in more], F.col("bad").alias("_is_bad"))
        same = [F.col("movie_id") == F.col("_m"), F.col("_probe") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in more)]
        met = asked.join(answers, same, "left").select(*key, "_duration", "side", "safe", "bad", "_probe", "_is_bad")
        known = F.col("_is_bad").isNotNull()
        met = met.withColumns({"safe": F.when(known & ~F.col("_is_bad"), F.col("_probe")).otherwise(F.col("safe")), "bad": F.when(known & F.col("_is_bad"), F.col("_probe")).otherwise(F.col("bad"))})
        state = kept(met.withColumn("open", known & wide).select(*key, "_duration", "side", "safe", "bad", "open"))
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    last = F.max("_duration") if not forward else F.max(F.when(F.col("side") == "end", F.col("safe")))
    bounds = ends.groupBy(*key).agg(F.max(F.when(F.col("side") == "start", F.col("bad"))).alias("bad_start"), last.alias("bad_end"))
    bounds = bounds.select(*[F.col(c).alias(f"_{c}") for c in key], "bad_start", "bad_end")
    return found.join(bounds, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left").select(*found.columns, "bad_start", "bad_end")


def snapped(segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """An extension: start moved to the nearest keyframe (movie_id, t) at or before it, 0 without one. Both tables meet in one window by
    movie and time, so no range join is needed."""
    rows = segments.select("movie_id", F.col("start").alias("_t"), F.lit(1).alias("_k"), F.struct(*[F.col(c) for c in segments.columns]).alias("_row"))
    keys = keyframes.select("movie_id", F.col("t").alias("_t"), F.lit(0).alias("_k")).distinct()
    both = rows.unionByName(keys, allowMissingColumns=True)
    by = Window.partitionBy("movie_id").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.when(F.col("_k") == 0, F.col("_t")), ignorenulls=True).over(by)
    return both.withColumn("snapped_start", F.coalesce(key, F.lit(0))).filter("_k = 1").select("_row.*", "snapped_start")
