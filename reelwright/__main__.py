"""python -m reelwright COMMAND ...

analyze TRANSCRIPTS FRAMES MOVIES OUT   transcripts (JSON) and scored frames (Parquet) to containers
captions CAPTIONS MOVIES OUT            caption events (JSON) to containers
demo MOVIES OUT                         safe, language, safe thirds to containers
mux SEGMENTS OUT                        segments (Parquet, columns of containers.write) to containers
list FOLDER VIEWERS                     the playback sequence of each viewer file (JSON) for each container, as JSON lines
info FOLDER VIEWERS                     entries, duration, swaps and mutes of those sequences
MOVIES is a Parquet table of movie_id and duration (milliseconds).
"""

from __future__ import annotations

import argparse
import datetime
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.functions import params
from reelwright.operators import analysis, detect, timeline, viewing
from reelwright.sources import containers, inputs

PLACES = {"analyze": ("transcripts", "frames", "movies", "out"), "captions": ("captions", "movies", "out"), "demo": ("movies", "out"), "mux": ("segments", "out"), "list": ("folder", "viewers"), "info": ("folder", "viewers")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reelwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name, places in PLACES.items():
        c = commands.add_parser(name)
        for place in places:
            c.add_argument(place)
        if "out" in places:
            c.add_argument("--profiles", help="a JSON object of profiles, each a map of tag to action", type=lambda path: json.load(open(path, encoding="utf-8")), default=params.PROFILES)
        else:
            c.add_argument("--as-of", default=datetime.date.today().isoformat())
            c.add_argument("--strict", action="store_true", help="no fallback to a more permissive profile")
        if name == "analyze":
            c.add_argument("--interval", type=int, default=5000, help="milliseconds")
            c.add_argument("--threshold", type=float, default=params.LIVE_THRESHOLD)
            c.add_argument("--cartoon-threshold", type=float, default=params.CARTOON_THRESHOLD)
    return p


def _made(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The containers that a command writes: movie_id, path, segments, bytes."""
    filters = {k: {"name": k, "filters": v} for k, v in a.profiles.items()}
    if a.command == "mux":
        return containers.write(spark.read.parquet(a.segments), a.out, filters)
    movies = spark.read.parquet(a.movies)
    if a.command == "demo":
        segments = timeline.demo_thirds(movies)
    elif a.command == "captions":
        events = inputs.captions(spark, a.captions)
        ms = {c: (F.col(c) * 1000).cast("long") for c in ("start", "end")}
        segments = analysis.captioned(events.withColumns(ms), movies)
    else:
        words = detect.transcript_words(inputs.transcripts(spark, a.transcripts))
        segments = analysis.analyzed(words, spark.read.parquet(a.frames), movies, a.interval, a.threshold, a.cartoon_threshold)
    return containers.write(analysis.for_containers(spark, segments, movies, a.profiles), a.out, filters)


def _seen(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    manifests, segments, index = (containers.read(spark, a.folder, t) for t in ("manifest", "segments", "index"))
    profiles = viewing.viewer_profiles(manifests, inputs.viewers(spark, a.viewers), F.lit(a.as_of).cast("date"), a.strict)
    rows = viewing.playback(segments, index, profiles)
    if a.command == "list":
        return rows.orderBy("path", "viewer_id", "play_no")
    return rows.groupBy("path", "viewer_id").agg(F.count("*").alias("entries"), F.sum("duration_ms").alias("duration_ms"), F.count_if(F.col("action") == "swap").alias("swapped"), F.count_if(F.col("action") == "mute").alias("muted")).orderBy("path", "viewer_id")


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for row in (_made if hasattr(a, "out") else _seen)(spark, a).toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()
