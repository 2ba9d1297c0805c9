"""An extension: gapless timelines of a stream of detections, as sessionize() and fill_gaps() give them in a batch, bad_end included.

A session window ends a fixed time after its last detection; here a detection may say itself when it ends (bad_end), so a processor with state
keeps each movie's open group and how far segments reach, and timers by event time close groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "movie_id string, seg_no int, start long, end long, tags array<string>, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Timeline(StatefulProcessor):
    """State of a movie: detections the watermark hasn't passed, and one row for the open group (start, last, end, tags, n), how far segments
    reach and the number of the last one."""

    def __init__(self, interval: int, duration: int, base: int):
        self.interval, self.duration, self.base = interval, duration, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, seq long, bad_end long, tags array<string>")
        self.now = handle.getValueState("now", "first long, last long, final long, tags array<string>, n long, reached long, number long, over boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [(int(r.t), int(r.seq), None if pd.isna(r.bad_end) else int(r.bad_end), list(r.tags if r.tags is not None else [])) for pdf in rows for r in pdf.itertuples()]
        for row in came:
            self.waiting.appendValue(row)
        for t in {row[0] for row in came}:
            self.handle.registerTimer(self.base + t + 1)
        self.handle.registerTimer(self.base + self.duration + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() - self.base  # detections before it have all come
        rows = sorted(((t, seq, bad, list(tags)) for t, seq, bad, tags in self.waiting.get()), key=lambda r: r[:2])
        ready, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        first, last, final, tags, n, reached, number, over = self.now.get() if self.now.exists() else (None, None, None, [], 0, 0, 0, False)
        out: list[tuple] = []

        def close() -> None:
            nonlocal first, reached, number
            if first > reached:
                number += 1
                out.append((key[0], number, reached, first, [], 0))
            number += 1
            end = min(final, self.duration)
            out.append((key[0], number, first, end, sorted(set(tags)), n))
            reached, first = max(reached, end), None

        for t, _, bad, own in ready:
            if first is not None and t - last > self.interval:
                close()
            end = min(t + self.interval, self.duration) if bad is None else bad
            first, last, final, tags, n = (t, t, end, own, 1) if first is None else (first, t, max(final, end), [*tags, *own], n + 1)
            tags = sorted(set(tags))
        if first is not None and passed > last + self.interval:
            close()
        if passed > self.duration and not over and not later:
            if first is not None:
                close()
            if reached < self.duration:
                number += 1
                out.append((key[0], number, reached, self.duration, [], 0))
            over = True
        if ready or out:
            self.waiting.put(later) if later else self.waiting.clear()
            self.now.update((first, last, final, list(tags), n, reached, number, over))
            if first is not None:
                self.handle.registerTimer(self.base + last + self.interval + 1)
        yield pd.DataFrame(out, columns=["movie_id", "seg_no", "start", "end", "tags", "n"])

    def close(self) -> None:
        pass


def stream_timeline(detections: DataFrame, interval: int, duration: int, base: str, delay: str) -> DataFrame:
    """movie_id, seg_no, start, end, tags, n (detections; 0 in a gap) of each segment and gap, once the watermark (delay) has passed it.

    detections: movie_id, ts (timestamp), seq, tags, bad_end (milliseconds since base; null: a detection lasts `interval`). Times are whole
    milliseconds since `base`, in which movies begin; all last `duration`. State of a movie is what the watermark hasn't passed and one row;
    later detections are dropped. A movie without any has no rows. The session needs RocksDB as its state store (ROCKS).
    """
    start = F.lit(base).cast("timestamp")
    rows = detections.withWatermark("ts", delay)
    t = F.unix_millis("ts") - F.unix_millis(start)
    rows = rows.select(F.col("movie_id").cast("string").alias("movie_id"), "ts", t.alias("t"), F.col("seq").cast("long").alias("seq"), F.col("bad_end").cast("long").alias("bad_end"), "tags")
    base_ms = detections.sparkSession.range(1).select(F.unix_millis(start)).first()[0]
    return rows.groupBy("movie_id").transformWithStateInPandas(_Timeline(interval, duration, base_ms), OUT, "Append", "EventTime")
