"""An extension: sessions of a stream of detections. Groups are those of operators.timeline.sessionize for detections without bad_end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(detections: DataFrame, interval: str, delay: str) -> DataFrame:
    """movie_id, start, end, tags, n once the watermark (delay) has passed a group (detections: movie_id, ts timestamp, tags).

    A session window merges detections no more than `interval` apart, equality included, and ends `interval` after the last one. State is
    one row per open session; rows later than the watermark are dropped.
    """
    window = F.session_window("ts", interval)
    # Spark keeps partial session state of merging aggregates; the set of tags is bounded by the taxonomy.
    rows = detections.withWatermark("ts", delay).select("movie_id", "ts", F.posexplode_outer("tags").alias("pos", "tag"))
    first = F.coalesce("pos", F.lit(0)) == 0  # one row of each detection
    out = rows.groupBy("movie_id", window).agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.count_if(first).alias("n"))
    return out.select("movie_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "tags", "n")
