"""What each viewer sees of each movie, from container tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.functions import exprs
from reelwright.operators import policy, text


def caption_segments(captions: DataFrame, movies: DataFrame) -> DataFrame:
    """movie_id, group_no, start, end, tags of caption events (movie_id, seq, start, end, description; whole numbers), in order of start, for
    timeline.fill_gaps(adjacent=True). A missing end is the movie's."""
    order = F.row_number().over(Window.partitionBy("movie_id").orderBy("start", "seq"))
    return captions.join(movies, "movie_id").select("movie_id", order.alias("group_no"), "start", F.coalesce("end", "duration").alias("end"), exprs.caption_tags(F.col("description")).alias("tags"))


def viewer_profiles(manifests: DataFrame, viewers: DataFrame, as_of: Column, strict: bool = False, views: DataFrame | None = None) -> DataFrame:
    """path, viewer_id, profile, filters for each container (path, manifest JSON) and viewer. A viewer with filters is their own profile, by
    name or `custom`; others get the profile of their data that the container has.

    views: the pairs (path, viewer_id) that are asked for, joined to either side by key. Without it all pairs are the result: profiles are
    resolved once for each set of names that containers have and each preference that viewers without filters have, both few, and those with
    filters, whose names are free, meet containers as they are.
    """
    names = F.coalesce(F.array_sort(F.map_keys(F.from_json(F.get_json_object("manifest", "$.profiles"), "map<string,string>"))), F.array().cast("array<string>"))
    preferred = policy.preferred_profile(F.col("profile_override"), F.col("birthday"), F.col("sex"), as_of, F.col("default_profile"))
    own = F.when(F.col("filters").isNotNull(), F.coalesce("name", F.lit("custom")))
    asked = viewers.select("viewer_id", "filters", F.coalesce(own, preferred).alias("_wants"), own.isNotNull().alias("_own"))
    boxes = manifests.select("path", names.alias("_names"))
    profile = F.when(F.col("_own"), F.col("_wants")).otherwise(policy.available_profile(F.col("_wants"), F.col("_names"), strict)).alias("profile")
    if views is not None:
        return views.select("path", "viewer_id").join(asked, "viewer_id").join(boxes, "path").select("path", "viewer_id", profile, "filters")
    others = asked.filter("NOT _own")
    kinds = boxes.select("_names").distinct().crossJoin(others.select("_wants", "_own").distinct()).select("_names", "_wants", profile)
    plain = boxes.join(kinds, "_names").join(others, "_wants").select("path", "viewer_id", "profile", "filters")
    return plain.unionByName(boxes.select("path").crossJoin(asked.filter("_own")).select("path", "viewer_id", F.col("_wants").alias("profile"), "filters"))


def playback(segments: DataFrame, index: DataFrame, profiles: DataFrame) -> DataFrame:
    """path, viewer_id, play_no, segment_id, action, target_id, duration_ms, start_ms, end_ms: the sequence of each viewer and container.

    segments and index are tables of containers, profiles is viewer_profiles(). A segment's entry for the profile decides; without one, the
    most restrictive of the viewer's own filters for its tags and topics. Fillers, skips and targets missing in the index are left out; of
    index entries that repeat an id the last one counts. A sequence is made once for all viewers of a container with the same profile and
    filters; viewers are joined last.
    """
    last = index.groupBy("path", "segment_id").agg(F.max_by("duration_ms", "seg_no").alias("duration_ms")).withColumnRenamed("segment_id", "target_id")
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries("filters")))
    profiles = profiles.withColumn("_f", F.coalesce(F.to_json(sorted_map), F.lit("")))
    kinds = profiles.select("path", "profile", "_f").distinct()
    rows = segments.filter(~F.coalesce("is_filler", F.lit(False))).drop("duration_ms").withColumnRenamed("profiles", "_actions").join(kinds, "path")
    entry = F.try_element_at(F.col("_actions"), F.col("profile"))
    none = F.create_map().cast("map<string,string>")
    filters = F.coalesce(F.from_json("_f", "map<string,string>"), none)
    dynamic = policy.most_restrictive(text.labels(F.col("tags"), F.col("topics")), filters)
    rows = rows.withColumns({"action": F.coalesce(entry["action"], F.when(entry.isNull(), dynamic), F.lit("play")), "target_id": F.coalesce(entry["segment_id"], F.col("segment_id"))})
    rows = rows.filter("action <> 'skip'").join(last, ["path", "target_id"])
    by = Window.partitionBy("path", "profile", "_f").orderBy("seg_no")
    rows = rows.select("path", "profile", "_f", F.row_number().over(by).alias("play_no"), "segment_id", "action", "target_id", "duration_ms", "start_ms", "end_ms")
    return rows.join(profiles.select("path", "profile", "_f", "viewer_id"), ["path", "profile", "_f"]).select("path", "viewer_id", "play_no", "segment_id", "action", "target_id", "duration_ms", "start_ms", "end_ms")
