"""Policies: who the viewer is, and what is done with a segment for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import params


def filters_map(filters: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(filters.items()) for x in kv]).cast("map<string,string>") if filters else F.create_map().cast("map<string,string>")


def profiles_table(spark, profiles: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """profile, filters: a row per profile."""
    rows = sorted((profiles or params.PROFILES).items())
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("profile"), filters_map(v).alias("filters")) for k, v in rows])))


def list_filters(filters: Column, action: Column) -> Column:
    """The map form of a profile whose filters are a list of tags."""
    return F.map_from_arrays(filters, F.transform(filters, lambda _: action))


def priority(action: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in params.RESTRICTIVENESS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, action), F.lit(0))


def most_restrictive(labels: Column, filters: Column) -> Column:
    """The most restrictive of the actions that filters give for labels; play if there is none."""
    actions = F.transform(F.filter(labels, lambda x: F.map_contains_key(filters, x)), lambda x: F.struct(priority(F.element_at(filters, x)).alias("p"), F.element_at(filters, x).alias("a")))
    return F.coalesce(F.array_max(actions)["a"], F.lit("play"))


def resolve_segments(segments: DataFrame, filters: Column) -> DataFrame:
    """segments with resolved_action: the most restrictive action that filters (a map, of a row or a literal) give for its tags and topics."""
    none = F.array().cast("array<string>")
    own = lambda c: F.coalesce(F.col(c), none) if c in segments.columns else none
    return segments.withColumn("resolved_action", most_restrictive(F.array_union(own("tags"), own("topics")), filters))


def profile_matrix(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """segments with profile, profile_action, target_id for each profile (profile, filters).

    A segment that is not safe takes its own action where the profile filters one of its tags, or it has no tags; elsewhere it plays. Only
    swap and skip lead to the segment's profile_segment_id, which is its own id where it is missing. Profiles are a few parameter rows; the
    product is one row per segment and profile by contract, and needs no shuffle.
    """
    sid = F.col("seg_id")
    target = F.coalesce(F.col("profile_segment_id"), sid) if "profile_segment_id" in segments.columns else sid
    held = F.arrays_overlap(F.col("tags"), F.map_keys("filters"))
    filtered = (F.col("risk") != "safe") & ((F.size("tags") == 0) | F.coalesce(held, F.lit(False)))
    action = F.when(filtered, F.col("action")).otherwise(F.lit("play"))
    rows = segments.crossJoin(F.broadcast(profiles)).withColumn("profile_action", action)
    return rows.withColumn("target_id", F.when(F.col("profile_action").isin("swap", "skip"), target).otherwise(sid))


def profiles_column(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys, profiles: the matrix as a map from profile to action and segment_id."""
    return matrix.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile", F.struct(F.col("profile_action").alias("action"), F.col("target_id").alias("segment_id")))))).alias("profiles"))


def completed_years(birthday: Column, as_of: Column) -> Column:
    not_yet = F.struct(F.month(as_of), F.dayofmonth(as_of)) < F.struct(F.month(birthday), F.dayofmonth(birthday))
    return F.year(as_of) - F.year(birthday) - not_yet.cast("int")


def fractional_years(birthday: Column, as_of: Column) -> Column:
    return F.datediff(as_of, birthday) / F.lit(365.25)


def profile_preview(birthday: Column, sex: Column, as_of: Column) -> Column:
    """The profile that a birthday (text) gives, a dash without a valid one."""
    born = F.try_to_date(birthday, "yyyy-MM-dd")
    return F.coalesce(profile_of_age(completed_years(born, as_of), F.lower(F.coalesce(sex, F.lit("unset")))), F.lit("\u2014"))


def profile_of_age(age: Column, sex: Column) -> Column:
    return F.when(age < params.CHILD_UNTIL, "child").when(age < params.TEEN_UNTIL, F.when(sex == "female", "teen_f").otherwise("teen_m")).when(age.isNotNull(), "adult")


def preferred_profile(override: Column, birthday: Column, sex: Column, as_of: Column, default: Column) -> Column:
    """An override, else the age's profile, else the default, else adult. Empty strings count as missing; birthday is text."""
    blank = lambda x: F.when(x != "", x)
    born = F.try_to_date(birthday, "yyyy-MM-dd")
    return F.coalesce(blank(override), profile_of_age(completed_years(born, as_of), F.lower(F.coalesce(sex, F.lit("unset")))), blank(default), F.lit("adult"))


def available_profile(preferred: Column, profiles: Column, strict: bool = False) -> Column:
    """preferred if profiles (an array of names) has it; teen for teen_m and teen_f; else the first there is in the order of fallback, then
    by name; strict: null in place of those last two."""
    teen = F.when(preferred.isin("teen_m", "teen_f") & F.array_contains(profiles, "teen"), F.lit("teen"))
    exact = F.when(F.array_contains(profiles, preferred), preferred)
    if strict:
        return F.coalesce(exact, teen)
    order = F.filter(F.array(*[F.lit(p) for p in params.FALLBACK_ORDER]), lambda p: F.array_contains(profiles, p))
    return F.coalesce(exact, teen, F.get(order, F.lit(0)), F.array_min(profiles), preferred, F.lit("adult"))


def server_profile(users: DataFrame, stored: DataFrame, as_of: Column, default: str, profiles: Column) -> DataFrame:
    """users with profile, from stored (user_id, birthday, sex, profile_override), a left join."""
    rows = users.join(stored, "user_id", "left")
    return rows.withColumn("profile", available_profile(preferred_profile(F.col("profile_override"), F.col("birthday"), F.col("sex"), as_of, F.lit(default)), profiles))


def action_flags(action: Column) -> dict[str, Column]:
    """playable, is_skip, is_mute, is_swap; unknown actions are playable."""
    return {"playable": action != "skip", "is_skip": action == "skip", "is_mute": action == "mute", "is_swap": action == "swap"}


def path_resolution(risk: Column, action: Column, tags: Column, filters: Column, choice: Column, sid: Column, movie_dir: Column, filler_dir: Column) -> Column:
    """swap_type, path, is_swapped of the path form: the original, a filler, or a skip (empty path). choice: the profile's swap option."""
    number = F.coalesce(F.try_to_number(F.element_at(F.split(sid, "_"), -1), F.lit("999999999")).cast("int"), F.lit(0))
    original = F.struct(F.lit("original").alias("swap_type"), F.concat(movie_dir, F.lit("/seg_"), F.format_string("%03d", number), F.lit(".ts")).alias("path"), F.lit(False).alias("is_swapped"))
    filler = F.struct(F.lit("filler").alias("swap_type"), F.concat(filler_dir, F.lit("/"), choice, F.lit(".ts")).alias("path"), F.lit(True).alias("is_swapped"))
    skip = F.struct(F.lit("skip").alias("swap_type"), F.lit("").alias("path"), F.lit(True).alias("is_swapped"))
    plain = (risk == "safe") | (action == "play") | ~F.arrays_overlap(tags, filters) | (choice == "original")
    return F.when(F.coalesce(plain, F.lit(False)) | (F.size(tags) == 0) | (F.size(filters) == 0), original).when(F.startswith(choice, F.lit("filler_")), filler).otherwise(skip)
