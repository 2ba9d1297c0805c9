"""The segment container: bytes in and out, without Spark.

Layout, little-endian: a 64-byte header, an index of 40-byte entries, a zstd-compressed JSON manifest, then a block per segment: a 32-byte
header and packets of a 16-byte header and data each.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO, NamedTuple

import zstandard

# The format.
MAGIC, BLOCK_MAGIC = b"BVF\x01\0\0\0\0", b"SEG\0"
HEADER, ENTRY, BLOCK, PACKET = struct.Struct("<8sHHIQQQQIQI"), struct.Struct("<16sQQQ"), struct.Struct("<4s16sIII"), struct.Struct("<B3xIQ")
VIDEO, AUDIO = 1, 2
H264, AAC = 0x1, 0x100
DEFAULT_FLAGS = 0b1001
ID_BYTES = 16
MOST = (1 << 63) - 1
#: Bytes that a scan of packets fetches at a time.
AHEAD = 1 << 16


class Corrupt(ValueError):
    """A file that breaks the format."""


class Header(NamedTuple):
    magic: bytes
    version_major: int
    version_minor: int
    flags: int
    index_offset: int
    index_length: int
    manifest_offset: int
    manifest_length: int
    segment_count: int
    duration_ms: int
    reserved: int


class Entry(NamedTuple):
    segment_id: str
    data_offset: int
    data_length: int
    duration_ms: int


class BlockHeader(NamedTuple):
    magic: bytes
    segment_id: str
    codec_video: int
    codec_audio: int
    flags: int


def packed_id(segment_id: str) -> bytes:
    raw = segment_id.encode()
    if len(raw) > ID_BYTES:
        raise ValueError(f"segment id {segment_id!r} has more than {ID_BYTES} bytes")
    return raw.ljust(ID_BYTES, b"\0")


def _unpacked_id(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode()


def block(segment_id: str, video: Iterable[tuple[int, bytes]] | None, audio: Iterable[tuple[int, bytes]] | None, codecs: tuple[int, int] = (H264, AAC)) -> bytes:
    """All video packets (pts, data), then all audio packets; where either list is missing, a stub of one zero byte each."""
    if video is None or audio is None:
        video = audio = ((0, b"\0"),)
    packets = ((VIDEO, video), (AUDIO, audio))
    return BLOCK.pack(BLOCK_MAGIC, packed_id(segment_id), *codecs, 0) + b"".join(PACKET.pack(kind, len(data), pts) + data for kind, rows in packets for pts, data in rows)


def manifest_json(movie_id: str, title: str, duration_ms: int, segments: list[dict], profiles: dict, analyzed_at: str, video_info: dict | None = None, chapters: list | None = None) -> bytes:
    """UTF-8 JSON; video_info and chapters stand in it only if given."""
    body: dict[str, Any] = {"bvf_version": "1.0", "movie_id": movie_id, "title": title, "duration_ms": duration_ms, "analyzed_at": analyzed_at, "profiles": profiles, "segments": segments}
    body |= {k: v for k, v in (("video_info", video_info), ("chapters", chapters)) if v is not None}
    return json.dumps(body, ensure_ascii=False).encode()


def opening(manifest: bytes, entries: list[tuple[str, int, int]], duration_ms: int, flags: int = DEFAULT_FLAGS) -> Iterator[bytes]:
    """The file up to its first block, from the manifest and (segment id, duration, length of the block) of each segment."""
    body = zstandard.ZstdCompressor(level=3).compress(manifest)
    index_length = ENTRY.size * len(entries)
    at = HEADER.size + index_length + len(body)
    yield HEADER.pack(MAGIC, 1, 0, flags, HEADER.size, index_length, HEADER.size + index_length, len(body), len(entries), duration_ms, 0)
    for sid, duration, length in entries:
        yield ENTRY.pack(packed_id(sid), at, length, duration)
        at += length
    yield body


def packed(manifest: bytes, blocks: list[tuple[str, int, bytes]], duration_ms: int, flags: int = DEFAULT_FLAGS) -> Iterator[bytes]:
    """The file in pieces, from the manifest and (segment id, duration, block) of each segment."""
    yield from opening(manifest, [(sid, duration, len(data)) for sid, duration, data in blocks], duration_ms, flags)
    yield from (data for _, _, data in blocks)


class _Window:
    """Reads of one block, AHEAD bytes at a time at least, but none beyond the block."""

    def __init__(self, box: Container, entry: Entry):
        self.box, self.end, self.at, self.held = box, entry.data_offset + entry.data_length, 0, b""

    def read(self, at: int, n: int) -> bytes:
        kept = self.held[at - self.at :] if self.at <= at <= self.at + len(self.held) else b""
        if len(kept) < n:
            kept += self.box._read(at + len(kept), min(max(n - len(kept), AHEAD), self.end - at - len(kept)))
            self.at, self.held = at, kept
        return kept[:n]


class Container:
    """A reader that fetches only what is asked for: header and index first, manifest and blocks on demand.

    strict: the format is checked (magic, major version, reserved bytes, index length, block magic and id, whole packets); otherwise a
    truncated packet ends its block silently. `fetched` counts the bytes that were read.
    """

    def __init__(self, f: BinaryIO, strict: bool = True):
        self.f, self.strict, self.fetched = f, strict, 0
        raw = self._read(0, HEADER.size)
        if len(raw) < HEADER.size:
            raise Corrupt("file is shorter than a header")
        h = self.header = Header(*HEADER.unpack(raw))
        self._check(h.magic == MAGIC, "bad magic")
        self._check(h.version_major == 1, f"unsupported major version {h.version_major}")
        self._check(h.reserved == 0, "reserved field is set")
        self._check(h.index_length == ENTRY.size * h.segment_count, "index length does not fit the segment count")
        self._check(max(h.index_offset, h.manifest_offset, h.manifest_length, h.duration_ms) <= MOST, "a field exceeds 63 bits")

    def _check(self, ok: bool, what: str) -> None:
        if self.strict and not ok:
            raise Corrupt(what)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(n)
        self.fetched += len(raw)
        return raw

    def size(self) -> int:
        return self.f.seek(0, io.SEEK_END)

    def index(self, whole: bool = True) -> list[Entry]:
        """whole: an index that is cut off is an error; else its whole entries are given."""
        raw = self._read(self.header.index_offset, ENTRY.size * self.header.segment_count)
        self._check(not whole or len(raw) == ENTRY.size * self.header.segment_count, "index is cut off")
        return [Entry(_unpacked_id(r[0]), *r[1:]) for r in ENTRY.iter_unpack(raw[: len(raw) // ENTRY.size * ENTRY.size])]

    def manifest_text(self) -> str:
        try:
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(self._read(self.header.manifest_offset, self.header.manifest_length))).read()
        except zstandard.ZstdError as e:
            raise Corrupt(f"manifest is damaged: {e}") from None
        return data.decode()

    def manifest(self, segments: bool = False) -> dict:
        """segments: there must be one at least."""
        m = json.loads(self.manifest_text())
        self._check(bool(m.get("movie_id")), "manifest has no movie_id")
        self._check(bool(m.get("segments")) or not segments, "manifest has no segments")
        return m

    def block_header(self, entry: Entry) -> BlockHeader:
        raw = self._read(entry.data_offset, BLOCK.size)
        self._check(len(raw) == BLOCK.size, "block is shorter than its header")
        magic, sid, video, audio, flags = BLOCK.unpack(raw.ljust(BLOCK.size, b"\0"))
        self._check(magic == BLOCK_MAGIC, "bad block magic")
        self._check(_unpacked_id(sid) == entry.segment_id, "block id differs from the index")
        return BlockHeader(magic, _unpacked_id(sid), video, audio, flags)

    def block(self, entry: Entry) -> bytes:
        raw = self._read(entry.data_offset, entry.data_length)
        self._check(len(raw) == entry.data_length, "block is cut off")
        return raw

    def codecs(self, entry: Entry) -> tuple[int, int]:
        """Of a block that is long enough for a header; else none, or an error."""
        if entry.data_length < BLOCK.size:
            self._check(False, "block is shorter than its header")
            return 0, 0
        h = self.block_header(entry)
        return h.codec_video, h.codec_audio

    def packet_heads(self, entry: Entry) -> Iterator[tuple[int, int, int, int]]:
        """(type, pts, offset of the data in the file, size) of every packet, from the packets' headers alone. A block, or packet, that is
        cut off is an error (not strict: the end) after the whole packets before it."""
        yield from self._heads(entry, _Window(self, entry))

    def _heads(self, entry: Entry, window: _Window) -> Iterator[tuple[int, int, int, int]]:
        at, end = entry.data_offset + BLOCK.size, entry.data_offset + entry.data_length
        while at < end:
            raw = window.read(at, PACKET.size) if at + PACKET.size <= end else b""
            kind, size, pts = PACKET.unpack(raw) if len(raw) == PACKET.size else (0, 1 << 62, 0)
            if at + PACKET.size + size > end:
                self._check(False, "packet is cut off")
                return
            yield kind, pts, at + PACKET.size, size
            at += PACKET.size + size

    def packet_stream(self, entry: Entry) -> Iterator[tuple[int, int, bytes]]:
        """(type, pts, data) of every packet, one in memory at a time; the end as for packet_heads()."""
        window = _Window(self, entry)
        for kind, pts, at, size in self._heads(entry, window):
            data = window.read(at, size)
            if len(data) < size:
                self._check(False, "block is cut off")
                return
            yield kind, pts, data

    def packets(self, entry: Entry) -> tuple[tuple[int, int], list[tuple[int, int, bytes]]]:
        """The codecs, and (type, pts, data) of every packet."""
        return self.codecs(entry), list(self.packet_stream(entry))


def packets_of(data: bytes, strict: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(type, pts, data) of the packets in data, each found from the size of the one before."""
    at = 0
    while at < len(data):
        if at + PACKET.size > len(data) or at + PACKET.size + PACKET.unpack_from(data, at)[1] > len(data):
            if strict:
                raise Corrupt("packet is cut off")
            return
        kind, size, pts = PACKET.unpack_from(data, at)
        yield kind, pts, data[at + PACKET.size : at + PACKET.size + size]
        at += PACKET.size + size


def packets_of_block(data: bytes, strict: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """packets_of() a whole block, after its header."""
    if len(data) < BLOCK.size or data[: len(BLOCK_MAGIC)] != BLOCK_MAGIC:
        if strict:
            raise Corrupt("bad block magic" if len(data) >= BLOCK.size else "block is shorter than its header")
        return
    yield from packets_of(data[BLOCK.size :], strict)
