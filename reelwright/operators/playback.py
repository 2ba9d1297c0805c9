"""Playback: sequences, adjusted time, seeks, payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.sources.shared import kept


def index_lookup(index: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per keys: of repeated ids the last in order."""
    rest = [c for c in index.columns if c not in keys]
    return index.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def sequence(matrix: DataFrame, index: DataFrame) -> DataFrame:
    """movie_id, profile, play_no, seg_no, seg_id, profile_action, target_id, start, end, duration: what is played, in order.

    matrix: profile_matrix() of timelines, with is_filler or without; index: movie_id, target_id, duration, and entry_no, by which the last
    of repeated ids counts (without it, the longest). Fillers are no part of the narrative; skips, and segments whose target is not in the
    index, are left out. Partial projections and filters reach the scan.
    """
    index = index_lookup(index, ["movie_id", "target_id"], "entry_no" if "entry_no" in index.columns else "duration")
    rows = matrix.filter(F.col("profile_action") != "skip")
    if "is_filler" in matrix.columns:
        rows = rows.filter(~F.coalesce("is_filler", F.lit(False)))
    rows = rows.join(index.select("movie_id", "target_id", "duration"), ["movie_id", "target_id"])
    by = Window.partitionBy("movie_id", "profile").orderBy("seg_no")
    return rows.select("movie_id", "profile", F.row_number().over(by).alias("play_no"), "seg_no", "seg_id", "profile_action", "target_id", "start", "end", "duration")


def _by() -> Window:
    return Window.partitionBy("movie_id", "profile").orderBy("play_no")


def adjusted_times(seq: DataFrame) -> DataFrame:
    """seq with adjusted_start: the playable time before each entry."""
    return seq.withColumn("adjusted_start", F.coalesce(F.sum("duration").over(_by().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def seek(seq: DataFrame, positions: DataFrame, closed: bool = False) -> DataFrame:
    """movie_id, profile, position, play_no, seg_id, offset of each position (movie_id, position) in adjusted time: the first entry that ends
    after it (closed: at it or after), else the last one. Entries and positions meet in one window by time, from the end: a position takes
    the entry that came last."""
    entry = F.struct("play_no", "seg_id", "adjusted_start")
    ends = adjusted_times(seq).select("movie_id", "profile", (F.col("adjusted_start") + F.col("duration")).alias("_t"), F.lit(1).alias("_k"), F.col("play_no").alias("_n"), entry.alias("_e"))
    asked = seq.select("movie_id", "profile").distinct().join(positions, "movie_id").select("movie_id", "profile", F.col("position").alias("_t"), F.lit(0 if not closed else 2).alias("_k"))
    by = Window.partitionBy("movie_id", "profile")
    found = F.last("_e", ignorenulls=True).over(by.orderBy(F.desc("_t"), "_k", F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0))
    rows = ends.unionByName(asked, allowMissingColumns=True).withColumns({"_p": found, "_end": F.max("_e").over(by)}).filter("_k <> 1")
    at = F.coalesce("_p", "_end")
    return rows.select("movie_id", "profile", F.col("_t").alias("position"), at["play_no"].alias("play_no"), at["seg_id"].alias("seg_id"), (F.col("_t") - at["adjusted_start"]).alias("offset"))


def playback_info(seq: DataFrame) -> DataFrame:
    """movie_id, profile, segments, duration, swapped, muted."""
    return seq.groupBy("movie_id", "profile").agg(F.count("*").alias("segments"), F.sum("duration").alias("duration"), F.count_if(F.col("profile_action") == "swap").alias("swapped"), F.count_if(F.col("profile_action") == "mute").alias("muted"))


def block_offsets(blocks: DataFrame, key: list[str], order: str, length: str, base: Column) -> DataFrame:
    """blocks with offset: base plus the lengths before it. key may be empty for one file; then blocks are numbered by partial sums of
    ranges of `order`, so that no task holds them all."""
    if key:
        by = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumn("offset", base + F.coalesce(F.sum(length).over(by), F.lit(0)))
    part = blocks.withColumn("_part", F.floor(F.col(order) / 4096))
    sums = part.groupBy("_part").agg(F.sum(length).alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    by = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = part.withColumn("_in", F.coalesce(F.sum(length).over(by), F.lit(0))).join(sums, "_part")
    return rows.withColumn("offset", base + F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


#: Bytes of a payload in one row, where it comes in several; and where it must be one.
CHUNK, MOST_PAYLOAD = 16 << 20, 1 << 29


def _in_order(packets: DataFrame, key: list[str], order: str, rest: list[Column]) -> DataFrame:
    return packets.select(*key, order, *rest).repartition(*key).sortWithinPartitions(*key, order)


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch, int]]:
    """(key, whether it is a new one, batch, row) of rows that are sorted by key."""
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in key]
        for i, now in enumerate(zip(*columns, strict=True)):
            yield now, now != last, batch, i
            last = now


def payload_chunks(packets: DataFrame, key: list[str], order: str, data: str, chunk: int = CHUNK) -> DataFrame:
    """key, chunk_no, payload: the bytes of each key's packets in order, in rows of `chunk` bytes (the last one: what is left; a key whose
    packets are empty has one empty row). Rows stream through tasks sorted by key and order, so a payload may have any length; no list of its
    packets is made, and a task holds one chunk and one packet."""
    kinds = dict(packets.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, no, held = 0, None, 0, bytearray()

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[: len(key)], types, strict=True)), pa.array(columns[-2], pa.int32()), pa.array(columns[-1], pa.binary())], [*key, "chunk_no", "payload"])

        types: list[pa.DataType] = []
        for k, new, batch, i in _by_key(batches, key):
            types = types or [batch.schema.field(n).type for n in key]
            if new:
                if now is not None and (held or no == 0):
                    out.append((*now, no, bytes(held)))
                    size += len(held)
                now, no, held = k, 0, bytearray()
            held += batch.column(data)[i].as_buffer() or b""
            while len(held) >= chunk:
                out.append((*now, no, bytes(held[:chunk])))
                size, no = size + chunk, no + 1
                del held[:chunk]
                if size > CHUNK:
                    yield packed()
                    out, size = [], 0
            if size > CHUNK or len(out) > 10_000:
                yield packed()
                out, size = [], 0
        if now is not None and (held or no == 0):
            out.append((*now, no, bytes(held)))
        if out:
            yield packed()

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "chunk_no int, payload binary"])
    return _in_order(packets, key, order, [F.col(data).cast("binary").alias(data)]).mapInArrow(rows, schema)


def payload_digests(packets: DataFrame, key: list[str], order: str, data: str, of: dict[str, Column | None]) -> DataFrame:
    """key, and for each name in `of` name_bytes and name_hash: how many bytes the key's packets have for which the condition holds (None:
    all), and their SHA-256 in hex, "" of none. Bytes stream through sorted tasks as in payload_chunks(), of which none is kept."""
    kinds, names = dict(packets.dtypes), list(of)
    flags = [(F.lit(True) if x is None else F.coalesce(x, F.lit(False))).alias(f"_{n}") for n, x in of.items()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types: list[pa.DataType] = []

        def packed() -> pa.RecordBatch:
            flat = [(*k, *(v for n, d in done for v in (n, d.hexdigest() if n else ""))) for k, done in out]
            columns = list(zip(*flat, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, *[pa.int64(), pa.string()] * len(names)], strict=True)], [*key, *(f"{n}_{x}" for n in names for x in ("bytes", "hash"))])

        picked: list = []
        for k, new, batch, i in _by_key(batches, key):
            if not types:
                types = [batch.schema.field(n).type for n in key]
            if i == 0:
                picked = [batch.column(f"_{n}").to_pylist() for n in names]
            if new:
                if len(out) > 10_000:
                    yield packed()
                    out = []
                out.append((k, [[0, hashlib.sha256()] for _ in names]))
            buffer = batch.column(data)[i].as_buffer()
            for column, total in zip(picked, out[-1][1], strict=True):
                if column[i] and buffer is not None:
                    total[0] += buffer.size
                    total[1].update(buffer)
        if out:
            yield packed()

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), *(f"{n}_bytes long, {n}_hash string" for n in names)])
    return _in_order(packets, key, order, [F.col(data).cast("binary").alias(data), *flags]).mapInArrow(rows, schema)


def joined_payloads(packets: DataFrame, key: list[str], order: str, data: str, only: Column | None = None) -> DataFrame:
    """key, payload: the bytes of the packets (for which `only` holds), in order, in one row; a key whose packets are all left out has none.
    Payloads of over MOST_PAYLOAD bytes, which no row should hold, fail the query: payload_chunks() gives those."""
    rows = payload_chunks(packets.filter(only) if only is not None else packets, key, order, data, MOST_PAYLOAD)
    long = F.raise_error(F.lit("a payload is too long for a row")).cast("binary")
    return rows.select(*key, F.when(F.col("chunk_no") > 0, long).otherwise(F.col("payload")).alias("payload"))


#: Entries that may be broadcast, as counted.
MOST_ENTRIES = 100_000


def _payloads_of(entries: DataFrame, packets: DataFrame, chunk: int) -> DataFrame:
    """entries (movie_id, target_id, profile_action and more) with chunk_no and payload; of muted ones the video packets. Only packets that
    an entry needs are shuffled, each one once or (of a target that is muted here and not there) twice."""
    video = F.col("profile_action") == "mute"
    entries = entries.withColumn("_video", F.coalesce(video, F.lit(False)))
    wanted = entries.select("movie_id", "target_id", "_video").distinct()
    few = wanted.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES
    needed = packets.join(F.broadcast(wanted) if few else wanted, ["movie_id", "target_id"]).filter(~F.col("_video") | (F.col("packet_type") == 1))
    return entries.join(payload_chunks(needed, ["movie_id", "target_id", "_video"], "packet_no", "data", chunk), ["movie_id", "target_id", "_video"]).filter(F.octet_length("payload") > 0).drop("_video")


def exported(seq: DataFrame, packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """movie_id, profile, play_no, target_id, profile_action, file, line, duration_line, chunk_no, payload: what a player concatenates, in
    order of play_no and chunk_no.

    packets: movie_id, target_id, packet_no, packet_type, data. A muted entry has its video packets only. Entries without bytes are left
    out; files keep the numbers of the sequence. A payload of over `chunk` bytes is several rows, of any total length.
    """
    name = F.format_string("seg_%03d.ts", F.col("play_no") - 1)
    return _payloads_of(seq, packets, chunk).select("movie_id", "profile", "play_no", "target_id", "profile_action", name.alias("file"), F.concat(F.lit("file '"), name, F.lit("'")).alias("line"), F.concat(F.lit("duration "), F.format_string("%.3f", F.col("duration") / 1000.0)).alias("duration_line"), "chunk_no", "payload")


def served(seq: DataFrame, positions: DataFrame, packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """movie_id, profile, position, seg_id, chunk_no, payload: the bytes of the entry at each position of adjusted time, in rows of at most
    `chunk` bytes; an entry without bytes has one row of nulls. Positions are sought first, so packets of other entries aren't moved.

    What was found is a table before it is joined with itself and its payloads: Spark 4.1 loses rows where the plan of a seek, a union of
    rows that are dealt alike, stands on both sides of a shuffled join (spark.sql.unionOutputPartitioning)."""
    at = kept(seek(seq, positions).join(seq.select("movie_id", "profile", "play_no", "target_id", "profile_action"), ["movie_id", "profile", "play_no"]))
    bytes_ = _payloads_of(at, packets, chunk).select("movie_id", "profile", "position", "chunk_no", "payload")
    return at.join(bytes_, ["movie_id", "profile", "position"], "left").select("movie_id", "profile", "position", "seg_id", "chunk_no", "payload")


def audio_hash(payload: Column) -> Column:
    """SHA-256 in hex; an empty payload has an empty one."""
    return F.when(F.length(payload) == 0, F.lit("")).otherwise(F.sha2(payload, 256))


def index_with_manifest(index: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The index's rows with the manifest's columns, defaults where it has none: safe, no tags, times 0."""
    rows = index.join(manifest, keys, "left")
    defaults = {"risk": F.lit("safe"), "tags": F.array().cast("array<string>"), "start_ms": F.lit(0).cast("bigint"), "end_ms": F.lit(0).cast("bigint")}
    return rows.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in rows.columns})


def library(videos: DataFrame, containers: DataFrame, path: str = "path") -> DataFrame:
    """The videos beside which a container of the same stem stands."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    return videos.withColumn("_stem", stem(F.col(path))).join(containers.select(stem(F.col(path)).alias("_stem")), "_stem", "left_semi").drop("_stem")


def media_sources(videos: DataFrame, files: DataFrame, header: DataFrame, sequence: DataFrame | None = None, path: str = "path", name: str = "Filtered") -> DataFrame:
    """A catalog's row for each video beside which a container of the same stem stands: videos' columns, source_id (the container's path and the
    name), name, source_path, container, segments, duration_ms, and, of a playback sequence (path of the container, profile_action, duration),
    what it plays: entries, playable_ms, swapped, muted.

    files and header are those tables of containers; damaged ones (corrupt) are no source. Of containers with one stem the last by path counts.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    whole = files.filter(F.col("corrupt").isNull()).select(F.col("path").alias("source_path"), F.col("segments")).join(header.filter(F.col("corrupt").isNull()).select(F.col("path").alias("source_path"), "duration_ms"), "source_path")
    if sequence is not None:
        plays = sequence.groupBy(F.col("path").alias("source_path")).agg(F.count("*").alias("entries"), F.sum("duration").alias("playable_ms"), F.count_if(F.col("profile_action") == "swap").alias("swapped"), F.count_if(F.col("profile_action") == "mute").alias("muted"))
        whole = whole.join(plays, "source_path", "left").fillna(0, ["entries", "playable_ms", "swapped", "muted"])
    rest = [c for c in whole.columns if c != "source_path"]
    one = whole.groupBy(stem(F.col("source_path")).alias("_stem")).agg(F.max(F.struct("source_path", *rest)).alias("_s"))
    rows = videos.withColumn("_stem", stem(F.col(path))).join(one, "_stem")
    return rows.select(*videos.columns, F.concat("_s.source_path", F.lit(f"::{name.lower().replace(' ', '-')}")).alias("source_id"), F.lit(name).alias("name"), "_s.source_path", F.lit("bvf").alias("container"), *[f"_s.{c}" for c in rest])


def self_swaps(matrix: DataFrame) -> DataFrame:
    """Rows that swap a segment with itself."""
    return matrix.filter((F.col("profile_action") == "swap") & (F.col("target_id") == F.col("seg_id")))


def unreferenced_fillers(fillers: DataFrame, matrix: DataFrame) -> DataFrame:
    """Fillers (movie_id, seg_id) that no profile's action leads to."""
    return fillers.join(matrix.select("movie_id", F.col("target_id").alias("seg_id")), ["movie_id", "seg_id"], "left_anti")


def agreeing(a: DataFrame, b: DataFrame, value: str, tolerance: int) -> DataFrame:
    """movie_id, a, b, agree of movies that both have: whether their values differ by less than tolerance."""
    x, y = (d.select("movie_id", F.col(value).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, "movie_id").withColumn("agree", F.abs(F.col("a") - F.col("b")) < tolerance)
