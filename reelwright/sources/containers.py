"""Containers as Spark tables: a data source that reads folders of them, whole or by byte ranges, and writes a file per movie."""

from __future__ import annotations

import json
import operator
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from reelwright.functions import exprs
from reelwright.operators import playback, policy
from reelwright.sources import container as c
from reelwright.sources.shared import folder_of

TABLES = {
    "header": "path string, version_major int, version_minor int, flags long, index_offset long, index_length long, manifest_offset long, manifest_length long, segment_count long, duration_ms long, corrupt string",
    "index": "path string, seg_no int, segment_id string, data_offset long, data_length long, duration_ms long, corrupt string",
    "files": "path string, movie_id string, segments int, bytes long, corrupt string",
    "manifest": "path string, movie_id string, title string, duration_ms long, manifest string, corrupt string",
    "segments": "path string, movie_id string, seg_no int, segment_id string, start_ms long, end_ms long, tags array<string>, topics array<string>, risk string, is_filler boolean, profiles map<string,struct<action:string,segment_id:string>>, corrupt string",
    "blocks": "path string, seg_no int, segment_id string, magic string, codec_video long, codec_audio long, flags long, data_length long, corrupt string",
    "packets": "path string, seg_no int, segment_id string, codec_video long, codec_audio long, packet_no int, packet_type int, pts_ms long, data binary, corrupt string",
    "packet_heads": "path string, seg_no int, segment_id string, packet_no int, packet_type int, pts_ms long, offset long, size long, corrupt string",
}
#: Tables with rows of entries of the index, of which damaged ones alone are lost.
BY_ENTRY = ("index", "blocks", "packets", "packet_heads")
#: A task reads files of so many bytes together (of tables other than packets, a file counts as OPEN bytes), and yields batches of so many.
TASK, OPEN, BATCH = 64 << 20, 1 << 18, 8 << 20


class ContainerSource(DataSource):
    """format("segment_container"): option path (a folder or file), table (one of TABLES), mode PERMISSIVE or FAILFAST, file name suffix
    `suffix`, files (a JSON list of paths or names: these alone), segments=required for a check that each manifest has one, listing=tasks:
    the driver lists the folder itself alone, and a task for each folder in it finds the files there.

    PERMISSIVE: what is damaged is a row with `corrupt` set, and the rest is read: a damaged file is one such row, a damaged block one with
    its seg_no and segment_id; a packet that is cut off comes after those before it. FAILFAST fails the query.

    Filters on path, segment_id and seg_no (=, IN, comparisons, prefixes and suffixes of a path) are pushed into the scan: other files
    aren't opened, and other blocks aren't read. Only table=packets reads blocks, one packet at a time; packet_heads reads their headers.
    Small files share a task. As a stream it takes option log, too (see _Stream). Written, it takes rows of STREAM and makes a file per movie (see write()).
    """

    @classmethod
    def name(cls) -> str:
        return "segment_container"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "segments")]

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("containers are added to a folder (mode append); a movie's file is replaced")
        return _Writer(self.options["path"], schema)


class _Files(InputPartition):
    """Files of a task, or a folder whose files the task finds itself."""

    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, In: lambda x, values: x in values}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.names = schema.fieldNames()
        self.types = _arrow(schema)
        self.table, self.mode, self.suffix = options.get("table", "segments"), options.get("mode", "PERMISSIVE").upper(), options.get("suffix", ".bvf")
        self.uri, self.required = options["path"], options.get("segments") == "required"
        self.only = set(json.loads(options["files"])) if "files" in options else None
        self.in_tasks = options.get("listing") == "tasks"
        self.wanted: list[tuple[str, type, object]] = []
        self.fetched = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes all filters that decide on files or entries of the index. A null matches none of them, as in SQL."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("path", *(("seg_no", "segment_id") if self.table in BY_ENTRY else ())) and (isinstance(f, IsNotNull) or type(f) in _COMPARED):
                self.wanted.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _is_wanted(self, **given: object) -> bool:
        return all(given[name] is not None and (kind is IsNotNull or _COMPARED[kind](given[name], value)) for name, kind, value in self.wanted if name in given)

    def partitions(self) -> list[_Files]:
        if not self.in_tasks:
            return self.packed((f.path, f.size) for f in self.listed() if self._is_wanted(path=f.path))
        system, root = fs.FileSystem.from_uri(self.uri)
        own = self.packed((f.path, f.size) for f in self.listed(recursive=False) if self._is_wanted(path=f.path))
        folders = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and not _hidden(f.path[len(root) :])]
        return own + [_Files([], f) for f in sorted(folders)]

    def listed(self, folder: str | None = None, recursive: bool = True) -> list[fs.FileInfo]:
        """The files to read, of all or of one folder, by path."""
        system, root = fs.FileSystem.from_uri(self.uri)
        info = system.get_file_info(folder or root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(folder or root, recursive=recursive))
        files = [f for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and (f.path.endswith(self.suffix) or f is info) and not _hidden(f.path[len(root) :])]
        return [f for f in files if self.only is None or f.path in self.only or f.base_name in self.only]

    def packed(self, files: Iterable[tuple[str, int]]) -> list[_Files]:
        """Files (path, size) dealt to tasks."""
        out, size = [], TASK
        for path, bytes_ in files:
            own = max(OPEN, bytes_ if self.table == "packets" else 0)
            if size + own > TASK:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(path)
            size += own
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        rows, size = [], 0
        paths = partition.paths if partition else []  # no partitions: Spark asks for rows all the same
        if partition and partition.folder:
            paths = [f.path for f in self.listed(partition.folder) if self._is_wanted(path=f.path)]
        for path in paths:
            for row in self._file(system, path):
                rows.append(row)
                size += 200 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
                if size > BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), self.types, strict=True)], self.names)

    def _file(self, system: fs.FileSystem, path: str) -> Iterator[tuple]:
        box = None
        try:
            with system.open_input_file(path) as f:
                box = c.Container(f, strict=True)
                yield from self._by_entry(box, path) if self.table in BY_ENTRY else ((*row, None) for row in self._rows(box, path))
        except _DAMAGE as e:
            if self.mode == "FAILFAST":
                raise
            if self._is_wanted(seg_no=None, segment_id=None):
                yield (path, *[None] * (len(self.names) - 2), str(e))
        finally:
            self.fetched += box.fetched if box else 0

    def _rows(self, box: c.Container, path: str) -> Iterator[tuple]:
        if self.table == "header":
            yield (path, *box.header[1:10])
        elif self.table == "files":
            yield (path, box.manifest(self.required)["movie_id"], box.header.segment_count, box.size())
        elif self.table == "manifest":
            m = box.manifest(self.required)
            yield (path, m["movie_id"], m.get("title"), m.get("duration_ms"), box.manifest_text())
        else:
            m = box.manifest(self.required)
            for i, s in enumerate(m.get("segments", [])):
                actions = [(k, {"action": v.get("action", "play"), "segment_id": v.get("segment_id", s["id"])}) for k, v in (s.get("profiles") or {}).items()]
                yield (path, m["movie_id"], i + 1, s["id"], s.get("start_ms"), s.get("end_ms"), s.get("tags") or [], s.get("topics") or [], s.get("risk") or "safe", bool(s.get("is_filler")), actions)

    def _by_entry(self, box: c.Container, path: str) -> Iterator[tuple]:
        """Rows of the wanted entries; of a damaged one what can be had, then a row that says so."""
        entries = box.index(whole=self.mode == "FAILFAST")
        for i, e in enumerate(entries):
            if self._is_wanted(seg_no=i + 1, segment_id=e.segment_id):
                try:
                    for row in self._entry(box, e):
                        yield (path, i + 1, *row, None)
                except _DAMAGE as x:
                    if self.mode == "FAILFAST":
                        raise
                    yield (path, i + 1, e.segment_id, *[None] * (len(self.names) - 4), str(x))
        if len(entries) < box.header.segment_count:
            raise c.Corrupt("index is cut off")

    def _entry(self, box: c.Container, e: c.Entry) -> Iterator[tuple]:
        if self.table == "index":
            yield tuple(e)
        elif self.table == "blocks":
            h = box.block_header(e)
            yield (h.segment_id, h.magic.rstrip(b"\0").decode("latin-1"), h.codec_video, h.codec_audio, h.flags, e.data_length)
        elif self.table == "packets":
            codecs = box.codecs(e)
            for n, (kind, pts, data) in enumerate(box.packet_stream(e)):
                yield (e.segment_id, *codecs, n + 1, kind, pts, data)
        else:
            box.codecs(e)
            for n, (kind, pts, at, size) in enumerate(box.packet_heads(e)):
                yield (e.segment_id, n + 1, kind, pts, at, size)


class _Stream(DataSourceStreamReader):
    """New files of a folder, each once. What every batch found is a file in the folder that option `log` names, beside the checkpoint, so an
    offset is the number of a batch, and a query that starts again reads what came since. A file that is replaced is new. Option
    files_per_batch bounds a batch."""

    def __init__(self, options: dict[str, str], schema: StructType):
        if "log" not in options:
            raise ValueError("a stream of containers needs the option log, a folder of its own")
        self.reader, self.log, self.most = _Reader(options, schema), options["log"], int(options.get("files_per_batch", 1 << 30))
        self.batches, self.seen = 0, set()

    def __getstate__(self) -> dict:
        """Every task gets a copy: without the files seen, which the log tells again."""
        return self.__dict__ | {"batches": 0, "seen": set()}

    def _entries(self, n: int) -> list[list]:
        system, root = fs.FileSystem.from_uri(self.log)
        with system.open_input_stream(f"{root}/{n:09d}.json") as f:
            return json.loads(f.read())

    def _resumed(self) -> None:
        system, root = fs.FileSystem.from_uri(self.log)
        system.create_dir(root, recursive=True)
        while system.get_file_info(f"{root}/{self.batches + 1:09d}.json").type == fs.FileType.File:
            self.batches += 1
            self.seen |= {tuple(e) for e in self._entries(self.batches)}

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"batches": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        self._resumed()
        new = [e for f in self.reader.listed() if (e := (f.path, f.size, f.mtime_ns)) not in self.seen][: self.most]
        if new:
            system, root = fs.FileSystem.from_uri(self.log)
            part = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part, compression=None) as out:
                out.write(json.dumps(new).encode())
            system.move(part, f"{root}/{self.batches + 1:09d}.json")
            self._resumed()
        return {"batches": self.batches}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[_Files]:
        return self.reader.packed((path, size) for n in range(start["batches"] + 1, end["batches"] + 1) for path, size, _ in self._entries(n))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict[str, int]) -> None:
        """The log stays, as a list of what was read."""


_DAMAGE = (c.Corrupt, UnicodeDecodeError, json.JSONDecodeError)


def _hidden(path: str) -> bool:
    """Of a path within a folder: whether a part of it begins with a dot or an underscore, as staged files do."""
    return any(part[:1] in ("_", ".") for part in path.split("/"))


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def register(spark: SparkSession) -> None:
    """The data source segment_container, with pushed filters, and the table function packets(block)."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that take filters
    spark.dataSource.register(ContainerSource)
    spark.udtf.register("packets", F.udtf(Packets))


class Packets:
    """packets(block [, strict]): packet_no, packet_type, pts_ms, data of a stored block, for a lateral join. A null block has none. What is
    damaged ends the block, or fails the query (strict)."""

    @staticmethod
    def analyze(block: AnalyzeArgument, strict: AnalyzeArgument | None = None) -> AnalyzeResult:
        if block.dataType.typeName() not in ("binary", "void"):
            raise ValueError("packets() takes a binary block")
        if strict is not None and not strict.isConstantExpression:
            raise ValueError("packets() takes a constant for strict")
        return AnalyzeResult(StructType().add("packet_no", "integer").add("packet_type", "integer").add("pts_ms", "long").add("data", "binary"))

    def eval(self, block: bytes | None, strict: bool = False) -> Iterator[tuple]:
        for n, (kind, pts, data) in enumerate(c.packets_of_block(bytes(block), bool(strict)) if block is not None else ()):
            yield n + 1, kind, pts, data


def packets_of(blocks: DataFrame, block: str = "block", strict: bool = False) -> DataFrame:
    """blocks without their column of blocks, with packet_no, packet_type, pts_ms, data: a row for each packet, as packets() gives them, but
    for batches of blocks at a time."""
    rest = [n for n in blocks.columns if n != block]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(block)
            out, held = [], 0

            def packed() -> pa.RecordBatch:
                at, *values = zip(*out, strict=True)
                kept = batch.select(rest).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True))], [*rest, "packet_no", "packet_type", "pts_ms", "data"])

            for i in range(batch.num_rows):
                data = column[i].as_py()
                for n, (kind, pts, x) in enumerate(c.packets_of_block(data, strict) if data is not None else ()):
                    out.append((i, n + 1, kind, pts, x))
                    held += len(x)
                    if held > BATCH:
                        yield packed()
                        out, held = [], 0
            if out:
                yield packed()

    schema = StructType([*blocks.select(*rest).schema.fields, *StructType.fromDDL("packet_no int, packet_type int, pts_ms long, data binary").fields])
    return blocks.mapInArrow(rows, schema)


#: Bytes of a range that one row holds.
CHUNK = 16 << 20


def ranges(wanted: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """wanted (path, offset, length, any more columns but chunk_no and data) with chunk_no and data: the bytes of each range, in rows of at
    most `chunk` bytes. Nothing else of the files is read, and nothing is shuffled. A range that reaches beyond its file ends there; one that
    is null or begins beyond it has no rows."""
    rest = [n for n in wanted.columns if n not in ("path", "offset", "length")]
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.lit(chunk)).cast("long"))
    rows = wanted.filter((F.col("length") > 0) & F.col("path").isNotNull() & F.col("offset").isNotNull())
    rows = rows.select("path", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), *rest, F.explode(F.transform(parts, lambda k: k.cast("int"))).alias("chunk_no"))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        opened, f = None, None
        for batch in batches:
            at = 0
            columns = [batch.column(n).to_pylist() for n in ("path", "offset", "length", "chunk_no")]
            got, held = [], 0
            for k, (path, offset, length, no) in enumerate(zip(*columns, strict=True)):
                if path != opened:
                    f, opened = system.open_input_file(path), path
                f.seek(min(offset + no * chunk, f.size()))
                data = f.read(min(chunk, length - no * chunk))
                got.append(data if data else None)
                held += len(data)
                if held > BATCH or k + 1 == batch.num_rows:
                    out = batch.slice(at, len(got)).append_column("data", pa.array(got, pa.binary()))
                    yield out.filter(out.column("data").is_valid())
                    at, got, held = k + 1, [], 0

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("data binary").fields])
    return rows.mapInArrow(fetched, schema)


def read(spark: SparkSession, path: str, table: str = "segments", mode: str = "PERMISSIVE", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("segment_container").option("path", path).option("table", table).option("mode", mode).options(**options).load()


def read_stream(spark: SparkSession, path: str, log: str, table: str = "segments", mode: str = "PERMISSIVE", **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("segment_container").option("path", path).option("log", log).option("table", table).option("mode", mode).options(**options).load()


def normalised(segments: DataFrame) -> DataFrame:
    """table=segments with start_s, end_s, duration_s in place of milliseconds; missing times count as 0."""
    s = lambda x: F.coalesce(x, F.lit(0)) / 1000.0
    rest = [n for n in segments.columns if n not in ("start_ms", "end_ms")]
    start, end = F.col("start_ms"), F.col("end_ms")
    return segments.select(*rest, s(start).alias("start_s"), s(end).alias("end_s"), s(F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0))).alias("duration_s"))


def block_at(blocks: DataFrame, position: int) -> DataFrame:
    """The block at a position (from 0) of each container; fails the query where a container has none there."""
    rows = blocks.groupBy("path").agg(F.max("seg_no").alias("_n")).join(blocks.filter(F.col("seg_no") == position + 1), "path", "left")
    out = F.raise_error(F.format_string("segment %d is not in 0 .. %d of %s", F.lit(position), F.col("_n") - 1, F.col("path")))
    return rows.withColumn("seg_no", F.when(F.col("seg_no").isNull(), out.cast("int")).otherwise(F.col("seg_no"))).drop("_n")


def by_id(wanted: DataFrame, table: DataFrame, strict: bool = True) -> DataFrame:
    """wanted (path, segment_id, ...) with the columns of table (index or blocks), of ids that repeat the first entry. An id that is missing
    fails the query; not strict: its columns are null."""
    rest = [n for n in table.columns if n not in ("path", "segment_id")]
    first = table.groupBy("path", "segment_id").agg(F.min_by(F.struct(*rest), F.col("seg_no")).alias("_r"))
    rows = wanted.join(first, ["path", "segment_id"], "left")
    if strict:
        missing = F.raise_error(F.format_string("segment '%s' is not in the index of %s", F.col("segment_id"), F.col("path")))
        rows = rows.withColumn("segment_id", F.when(F.col("_r").isNull(), missing.cast("string")).otherwise(F.col("segment_id")))
    return rows.select(*wanted.columns, "_r.*")


def file_name(movie_id: str) -> str:
    """A file's name for any movie_id: letters, digits, _, - and dots inside stay, other bytes are written as %XX."""
    name = quote(movie_id, safe="")
    return f"{name if name[:1] not in ('.', '_') else f'%{ord(name[0]):02X}' + name[1:]}.bvf"


#: Rows that the data source writes: for each movie one with `head`, then those with packets, by seg_no, packet_type and packet_no.
INFO = "seg_no int, seg_id string, title string, duration_ms long, start_ms long, end_ms long, tags array<string>, topics array<string>, risk string, is_filler boolean, profiles map<string,struct<action:string,segment_id:string>>, length long, stub boolean, video_info string, chapters string"
STREAM = f"movie_id string, head struct<profiles:string,analyzed_at:string,segments:array<struct<{', '.join(x.replace(' ', ':', 1) for x in INFO.split(', '))}>>>, seg_no int, packet_type int, packet_no int, pts_ms long, data binary"
STREAMED = ["movie_id", "head", "seg_no", "packet_type", "packet_no", "pts_ms", "data"]


@dataclass
class _Staged(WriterCommitMessage):
    """(staged file, its place) of what a task has written."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Files are staged in a folder of the job. Those of tasks that succeeded are moved into place when all did; the rest goes with the
    folder, as all of it does when the job fails."""

    def __init__(self, uri: str, schema: StructType):
        self.uri, self.job = uri, f"_staged-{uuid.uuid4().hex}"
        if schema.fieldNames() != STREAMED:
            raise ValueError(f"rows to write have the columns {STREAMED}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        system, root = fs.FileSystem.from_uri(self.uri)
        done, now = [], None
        for batch in iterator:
            movies, numbers, kinds, times, data, heads = (batch.column(n) for n in ("movie_id", "seg_no", "packet_type", "pts_ms", "data", "head"))
            for i in range(batch.num_rows):
                if heads[i].is_valid:
                    if now:
                        now.close()
                    movie = movies[i].as_py()
                    if movie is None:
                        raise ValueError("a container needs a movie_id")
                    part = f"{root}/{self.job}/{uuid.uuid4().hex}"
                    system.create_dir(f"{root}/{self.job}", recursive=True)
                    now = File(system.open_output_stream(part, compression=None), movie, heads[i].as_py())
                    done.append((part, f"{root}/{file_name(movie)}"))
                elif now is None or now.movie != movies[i].as_py():
                    raise ValueError(f"packets of movie {movies[i].as_py()!r} have no segment")
                else:
                    now.packet(numbers[i].as_py(), kinds[i].as_py(), times[i].as_py(), data[i].as_buffer())
        if now:
            now.close()
        return _Staged(done)

    def commit(self, messages: list[_Staged | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.uri)
        system.create_dir(root, recursive=True)

        def placed(pair: tuple[str, str]) -> None:
            if system.get_file_info(pair[1]).type != fs.FileType.NotFound:
                system.delete_file(pair[1])
            system.move(*pair)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(placed, [f for m in messages if m for f in m.files]))
        self._cleared(system, root)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._cleared(*fs.FileSystem.from_uri(self.uri))

    def _cleared(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class File:
    """One container, written packet by packet. Blocks have the lengths that the head gives, or it is an error."""

    def __init__(self, out: pa.NativeFile, movie: str, head: dict):
        self.out, self.movie, self.segments, self.at, self.left = out, movie, sorted(head["segments"], key=lambda r: r["seg_no"]), -1, 0
        entries = [(r["seg_id"], (r["end_ms"] or 0) - (r["start_ms"] or 0), r["length"]) for r in self.segments]
        for piece in c.opening(_manifest(movie, self.segments, json.loads(head["profiles"]), head["analyzed_at"]), entries, self.segments[0]["duration_ms"] or 0):
            out.write(piece)

    def packet(self, seg_no: int, kind: int, pts: int, data: pa.Buffer | bytes) -> None:
        while self.at < 0 or self.segments[self.at]["seg_no"] != seg_no:
            self._next(f"packets of {self.movie!r}, segment {seg_no}, have no segment")
        if not self.segments[self.at]["stub"]:
            self.out.write(c.PACKET.pack(kind, len(data), pts))
            self.out.write(data)
            self.left -= c.PACKET.size + len(data)

    def _next(self, missing: str) -> None:
        if self.left:
            raise ValueError(f"{self.movie!r}: a block differs from its length by {-self.left} bytes")
        self.at += 1
        if self.at == len(self.segments):
            raise ValueError(missing)
        info = self.segments[self.at]
        start = c.block(info["seg_id"], *([None] * 2 if info["stub"] else [()] * 2))
        self.out.write(start)
        self.left = info["length"] - len(start)

    def close(self) -> None:
        while self.at + 1 < len(self.segments):
            self._next("")
        if self.left:
            raise ValueError(f"{self.movie!r}: a block differs from its length by {-self.left} bytes")
        self.out.close()



def packet_rows(segments: DataFrame) -> DataFrame:
    """movie_id, seg_no, packet_type, packet_no, pts_ms, data of segments that have their packets in arrays video and audio."""
    of = lambda name, kind: F.transform(F.coalesce(F.col(name), F.array().cast("array<struct<pts_ms:long,data:binary>>")), lambda p, i: F.struct(F.lit(kind).alias("packet_type"), (i + 1).cast("int").alias("packet_no"), p["pts_ms"].alias("pts_ms"), p["data"].alias("data")))
    return segments.select("movie_id", "seg_no", F.inline(F.concat(of("video", c.VIDEO), of("audio", c.AUDIO))))


def stream_of(segments: DataFrame, profiles: dict, analyzed_at: str, packets: DataFrame | None = None) -> DataFrame:
    """Rows of STREAM, each movie's in one partition and in order. Only heads, with the lengths of blocks, are gathered by movie."""
    if packets is None:
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, p: n + F.lit(c.PACKET.size) + F.octet_length(p["data"]))
        stub = F.col("video").isNull() | F.col("audio").isNull()
        sized = segments.withColumns({"_stub": stub, "_bytes": F.coalesce(total(F.col("video")) + total(F.col("audio")), F.lit(0))}).drop("video", "audio")
        packets = packet_rows(segments.filter(~stub))
    else:
        sums = packets.groupBy("movie_id", "seg_no").agg(F.sum(F.lit(c.PACKET.size) + F.octet_length("data")).alias("_bytes"), (F.max((F.col("packet_type") == c.VIDEO).cast("int")) + F.max((F.col("packet_type") == c.AUDIO).cast("int")) < 2).alias("_stub"))
        sized = segments.join(sums, ["movie_id", "seg_no"], "left").withColumns({"_stub": F.coalesce("_stub", F.lit(True)), "_bytes": F.coalesce("_bytes", F.lit(0).cast("long"))})
    more = {n: F.to_json(n) if n in segments.columns else F.lit(None).cast("string") for n in ("video_info", "chapters")}
    length = F.lit(c.BLOCK.size) + F.when(F.col("_stub"), F.lit(2 * (c.PACKET.size + 1))).otherwise(F.col("_bytes"))
    sized = sized.withColumns({**more, "length": length.cast("long"), "stub": F.col("_stub")})
    info = F.struct(*[F.col(x.split(" ")[0]) for x in INFO.split(", ")])
    heads = sized.groupBy("movie_id").agg(F.struct(F.lit(json.dumps(profiles)).alias("profiles"), F.lit(analyzed_at).alias("analyzed_at"), F.collect_list(info).alias("segments")).alias("head"))
    rows = packets.select("movie_id", "seg_no", "packet_type", F.col("packet_no").cast("int").alias("packet_no"), F.col("pts_ms").cast("long").alias("pts_ms"), F.col("data").cast("binary").alias("data"))
    both = heads.unionByName(rows, allowMissingColumns=True).select(*STREAMED)
    # A number of tasks that doesn't shrink with the bytes: files, not bytes, take the time.
    tasks = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments.sparkSession.sparkContext.defaultParallelism)
    return both.repartition(tasks, "movie_id").sortWithinPartitions("movie_id", "seg_no", "packet_type", "packet_no")  # heads first: their seg_no is null


def write(segments: DataFrame, folder: str, profiles: dict, analyzed_at: str = "2024-01-01T00:00:00Z", packets: DataFrame | None = None) -> DataFrame:
    """Writes one container per movie into folder; returns path, movie_id, segments, bytes of each.

    segments: movie_id, title, duration_ms, seg_no, seg_id, start_ms, end_ms, tags, topics, risk, is_filler, profiles (map of action and
    segment_id), and optionally video_info and chapters, which the manifest takes from a movie's first segment. packets: movie_id, seg_no,
    packet_type, packet_no, pts_ms, data, a row each, so that a block may be longer than any row; a segment without packets of either type is
    a stub. Without that table, segments have arrays video and audio (of pts_ms and data; null: a stub).

    A movie's rows meet in one task, sorted: its list of segments with the lengths of their blocks first, then packets, each of which is
    written as it comes. Files appear when all tasks have ended; a failed job leaves none, a repeated task does no harm. A null movie_id, or
    packets of a segment that isn't there, fail the job.
    """
    spark = segments.sparkSession
    register(spark)
    stream_of(segments, profiles, analyzed_at, packets).write.format("segment_container").option("path", folder).mode("append").save()
    return read(spark, folder, "files", "FAILFAST").join(segments.select("movie_id").distinct(), "movie_id", "left_semi").drop("corrupt")


def _manifest(movie: str, infos: list[dict], profiles: dict, analyzed_at: str) -> bytes:
    listed = []
    for r in infos:
        entry = {"id": r["seg_id"], "start_ms": r["start_ms"], "end_ms": r["end_ms"], "tags": r["tags"] or [], "topics": r["topics"] or [], "risk": r["risk"] or "safe", "profiles": {k: v for k, v in (r["profiles"] or [])}}
        listed.append(entry | ({"is_filler": True} if r["is_filler"] else {}))
    first = infos[0]
    extra = {k: json.loads(first[k]) if first[k] else None for k in ("video_info", "chapters")}
    return c.manifest_json(movie, first["title"], first["duration_ms"], listed, profiles, analyzed_at, **extra)


def payloads(packets: DataFrame, only: int | None = None) -> DataFrame:
    """path, segment_id, payload: a segment's bytes, all or of one packet type."""
    kind = F.col("packet_type") == only if only is not None else None
    return playback.joined_payloads(packets, ["path", "segment_id"], "packet_no", "data", kind)


def packed_timeline(timeline: DataFrame, profiles: dict[str, dict[str, str]], video: Column | None = None, audio: Column | None = None) -> DataFrame:
    """A timeline (microseconds) as rows for write(), with made-up packets (or the given ones, null for a stub)."""
    rows = policy.profile_matrix(timeline, policy.profiles_table(timeline.sparkSession, profiles))
    actions = policy.profiles_column(rows, ["movie_id", "seg_no"])
    ms = lambda x: F.floor(x / 1000).cast("bigint")
    packet = lambda *parts: F.array(F.struct(F.lit(0).cast("bigint").alias("pts_ms"), F.concat(*parts).cast("binary").alias("data")))
    video = packet(F.lit("v"), "seg_id", F.array_join("tags", ",")) if video is None else video
    return timeline.join(actions, ["movie_id", "seg_no"]).select(
        F.col("movie_id").cast("string").alias("movie_id"), F.lit("t").alias("title"), ms(F.lit(30 * 86_400_000_000)).alias("duration_ms"), "seg_no", exprs.checked_id(F.col("seg_id")).alias("seg_id"), ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), "tags",
        F.array().cast("array<string>").alias("topics"), "risk", F.lit(False).alias("is_filler"), "profiles", video.alias("video"), (packet(F.lit("a"), "seg_id") if audio is None else audio).alias("audio"))


def written(spark: SparkSession, packed: DataFrame, profiles: dict[str, dict[str, str]]) -> str:
    """Writes containers to a new shared folder, which is returned."""
    folder = folder_of(spark)
    write(packed, folder, {k: {"name": k, "filters": v} for k, v in profiles.items()})
    return folder


def roundtrip(spark: SparkSession, timeline: DataFrame, profiles: dict[str, dict[str, str]]) -> DataFrame:
    """Writes a timeline as containers, reads them back, and lists what they hold. Packets are read once, for both digests."""
    folder = written(spark, packed_timeline(timeline, profiles), profiles)
    segments, index, packets = (read(spark, folder, t, "FAILFAST") for t in ("segments", "index", "packets"))
    bytes_ = playback.payload_digests(packets, ["path", "segment_id"], "packet_no", "data", {"payload": None, "audio": F.col("packet_type") == c.AUDIO})
    out = segments.join(index.select("path", "segment_id", "duration_ms"), ["path", "segment_id"]).join(bytes_, ["path", "segment_id"])
    return out.select("movie_id", "seg_no", F.col("segment_id").alias("seg_id"), "start_ms", "end_ms", "duration_ms", F.array_join("tags", ",").alias("tags"), "risk", F.col("payload_bytes").cast("int").alias("payload_bytes"), "audio_hash")
