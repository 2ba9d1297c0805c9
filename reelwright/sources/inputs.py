"""JSON inputs with explicit schemas: transcripts, captions, profiles, viewers, server users."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "segments array<struct<words:array<struct<word:string,start:double,end:double>>>>"
CAPTIONS = "scene string, events array<struct<start:double,end:double,description:string>>"
VIEWER = "birthday string, date_of_birth string, sex string, gender string, profile_override string, profile string, name string, description string, filters map<string,string>"
USERS = "Enabled boolean, DefaultProfile string, FillerDirectory string, NsfwThreshold double, DefaultAction string, UserProfiles map<string,struct<Birthday:string,Sex:string,ProfileOverride:string>>"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each row of files (name, body: text or bytes) into folder, and returns the names. A name's slashes are written as
    %2F."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names = [n.replace("/", "%2F") for n in batch.column("name").to_pylist()]
            for name, body in zip(names, batch.column("body").to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(body if isinstance(body, bytes) else body.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return files.select("name", "body").mapInArrow(tasks, "name string")


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """movie_id (the file's stem), segments: one file per movie."""
    return _read(spark, path, TRANSCRIPT).withColumn("movie_id", _stem())


def captions(spark: SparkSession, path: str) -> DataFrame:
    """movie_id, seq, start, end, description of each caption event; a missing start is 0, a missing end null."""
    rows = _read(spark, path, CAPTIONS).withColumn("movie_id", _stem())
    return rows.select("movie_id", F.posexplode("events").alias("seq", "_e")).select("movie_id", "seq", F.coalesce("_e.start", F.lit(0.0)).alias("start"), F.col("_e.end").alias("end"), F.coalesce("_e.description", F.lit("")).alias("description"))


def viewers(spark: SparkSession, path: str) -> DataFrame:
    """viewer_id (the file's stem), birthday, sex, profile_override, default_profile, name, filters: either form, with or without a `user`
    object around it."""
    inner = ",".join(part.strip().replace(" ", ":", 1) for part in _top_level(VIEWER))
    rows = _read(spark, path, f"{VIEWER}, default_profile string, user struct<{inner}>").withColumn("viewer_id", _stem())
    pick = lambda *names: F.coalesce(*[F.when(F.col("user").isNotNull(), F.col(f"user.{n}")).otherwise(F.col(n)) for n in names])
    return rows.select("viewer_id", pick("birthday", "date_of_birth").alias("birthday"), pick("sex", "gender").alias("sex"), pick("profile_override", "profile").alias("profile_override"), "default_profile", pick("name").alias("name"), pick("filters").alias("filters"))


def _top_level(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def profile_rows(viewers_: DataFrame) -> DataFrame:
    """Profiles of a file: custom ones (name and filters) or legacy ones (a birthday); anything else fails the query."""
    ok = F.col("birthday").isNotNull() | (F.col("name").isNotNull() & F.col("filters").isNotNull())
    return viewers_.withColumn("kind", F.when(F.col("birthday").isNotNull(), "legacy").when(ok, "custom").otherwise(F.raise_error(F.concat(F.lit("invalid profile: "), "viewer_id"))))


def server_users(spark: SparkSession, path: str) -> DataFrame:
    """user_id, birthday, sex, profile_override, default_profile from the server's configuration: a row per stored user."""
    rows = _read(spark, path, USERS)
    return rows.select("DefaultProfile", F.explode("UserProfiles").alias("user_id", "_u")).select("user_id", F.col("_u.Birthday").alias("birthday"), F.col("_u.Sex").alias("sex"), F.col("_u.ProfileOverride").alias("profile_override"), F.col("DefaultProfile").alias("default_profile"))
