"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest hash of its s-mers is that of its first or last one. The choice looks at the k-mer
alone, so equal passages give equal anchors whatever stands around them. A fingerprint is the ANCHORS smallest anchor hashes with their
first places; likeness is the share of the joint smallest hashes that both have in the same order of places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import cut

S, K = 5, 15
ANCHORS = 64
#: Ranges for finding each row's successor: rows of one, boundaries of doc_id that the driver may hold (evenly spaced sub-ranges lie between
#: them), and the share of all rows from which a repeated doc_id, or the null ones, are cut by the texts' hashes.
RANGE_ROWS, MOST_BOUNDS, HOT = 20_000, 1024, 0.001
#: Characters of the ranges' first texts that may be broadcast, as counted.
MOST_CHARS = 32 << 20
#: Ranges whose numbers may be broadcast, as counted.
MOST_TOPS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _whole(text: str) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))][: len(text)], np.uint32), np.zeros(min(1, len(text)), np.uint32))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All anchors' hashes and places, in order of place. A text shorter than K, or without a syncmer, is one anchor; an empty one has none."""
    if len(text) < K:
        return _whole(text)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h2 = c[:-1] * np.uint32(0x01000193) + c[1:]
    h = h2[:-2] * np.uint32(0x85EBCA77) + h2[2:]
    h = _mix(h[:-1] * np.uint32(0xC2B2AE3D) + c[4:])  # of every s-mer
    low = np.minimum(h[:-1], h[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    low = np.minimum(low[:-3], low[3:])  # of K - S + 1 = 11 neighbouring s-mers
    at = np.flatnonzero((low == h[: len(low)]) | (low == h[K - S :])).astype(np.uint32)
    if not len(at):  # in texts under 2 * K - S - 1 code points only
        return _whole(text)
    return _mix((h[at] * np.uint32(0x27D4EB2F) + h[at + S]) * np.uint32(0x165667B1) + h[at + 2 * S]), at


def sketch(text: str) -> np.ndarray:
    """ANCHORS x (hash, place) at most, by hash; of a repeated anchor the first place."""
    h, at = anchors(text)
    h, first = np.unique(h, return_index=True)
    return np.stack([h[:ANCHORS], at[first[:ANCHORS]]], 1)


def text_of(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1; equal fingerprints, two empty ones among them, have 1."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both, i, j = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    union = np.union1d(a[:, 0], b[:, 0])[:ANCHORS]
    keep = both <= union[-1]
    i, j = i[keep], j[keep]
    tails: list[int] = []
    for p in b[j, 1][np.argsort(a[i, 1], kind="stable")].tolist():  # longest run of anchors in the same order
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails) / len(union)


def edited(text: str, after: str) -> str:
    """The last half of text replaced by as much of the start of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple[str, np.ndarray] = ("", sketch(""))
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            out: list[list] = [[], [], [], [], [], []]
            for text, after in zip(part.column("text").to_pylist(), part.column("_next").to_pylist(), strict=True):
                own = known[1] if known[0] == text else sketch(text)
                known = (after, sketch(after))  # rows come in order, so the next row's text is mostly this one
                other = edited(text, after)
                new = sketch(other)
                for column, x in zip(out, (len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(new), likeness(own, new), likeness(own, known[1])), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:4]), *(pa.array(x, pa.float64()) for x in out[4:])],
                                             ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _longs(xs: list[int]) -> Column:
    """A literal array, folded when the query is planned."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def _bound_of(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most key, by halving; null keys: 0."""
    size = 1 << len(bounds).bit_length()
    table = _longs(bounds + [(1 << 63) - 1] * (size - 1 - len(bounds)))
    steps = F.array(*[F.lit(size >> i) for i in range(1, size.bit_length())])
    at = F.aggregate(steps, F.lit(0), lambda acc, step: acc + F.when(F.element_at(table, acc + step) <= key, step).otherwise(0))
    return F.when(key.isNull(), F.lit(0)).otherwise(at)


def _ranged(rows: DataFrame, range_rows: int) -> DataFrame:
    """rows with _range, the number of a row's range, which falls from row to row in the order of with_next().

    Ranges hold about range_rows rows, however many there are: quantiles of doc_id are cut into even sub-ranges, and ids with HOT of the
    rows, null ones among them, by the hash of the text.
    """
    spark = rows.sparkSession
    total, nulls, low, high = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows))
    k = min(n, MOST_BOUNDS)
    quantiles = rows.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k) if k > 1 else []
    least = max(range_rows, int(HOT * total) + 1)
    hot = {r["doc_id"]: r["count"] for r in rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter(F.col("count") >= least).collect()}  # 1 / HOT rows at most
    bounds = sorted({int(x) for x in quantiles} | {x for i in hot for x in (i, i + 1)} | {low, high + 1})
    # 0: null ids; q: from bounds[q - 1] on. Each has a number of sub-ranges.
    cuts = [max(1, -(-nulls // least))] + [max(1, -(-hot[lo] // range_rows)) if lo in hot else max(1, min(hi - lo, -(-n // k))) for lo, hi in zip(bounds, bounds[1:], strict=False)] + [1]
    starts = [0]
    for c in cuts:
        starts.append(starts[-1] + c)
    rows, q = rows.withColumn("_q", _bound_of(bounds, F.col("doc_id"))), F.col("_q")
    pick = lambda xs: F.element_at(_longs(xs), q + 1)
    lows, spans = [0, *bounds], [1, *(hi - lo for lo, hi in zip(bounds, bounds[1:], strict=False)), 1]
    sub = F.floor((F.col("doc_id") - pick(lows)).cast("double") * pick(cuts) / pick(spans)).cast("long")
    sub = F.least(F.greatest(sub, F.lit(0)), pick(cuts) - 1)
    by_hash = [i for i, c in enumerate(cuts) if c > 1 and (i == 0 or bounds[i - 1] in hot)]
    if by_hash:
        hashed = pick(cuts) - 1 - F.floor(F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))), 33) * pick(cuts) / (1 << 31)).cast("long")
        sub = F.when(q.isin(by_hash), hashed).otherwise(sub)
    number = pick(starts[:-1]) + F.when(F.col("doc_id").isNull() & F.lit(0 not in by_hash), F.lit(0)).otherwise(sub)
    return rows.withColumn("_range", number).drop("_q")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text and _next: the text of the row after it in descending doc_id, after the last the first.

    Null ids come last; ties go by the text's hash, then the text. One shuffle carries the texts, dealt by ranges; all that a range needs
    of another is the first text of the next one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = _ranged(rows, range_rows)
    tops = cut(rows.groupBy("_range").agg(F.max("doc_id").alias("_top")))  # a row per range, numbers only
    onward = Window.orderBy(F.desc("_range"))
    after = F.coalesce(F.lead("_range").over(onward), F.max("_range").over(Window.partitionBy()))
    few = lambda df: F.broadcast(df) if df.count() <= MOST_TOPS else df
    # Of a range's rows with its greatest id the first in order; min_by keeps one row a range and task.
    first = rows.withColumnRenamed("_range", "_of").join(few(tops), (F.col("_of") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    first = cut(first.groupBy("_range").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("_head")))
    heads = tops.select("_range", after.alias("_after")).join(first.withColumnRenamed("_range", "_after"), "_after").select("_range", "_head")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    lead = F.lead("text").over(Window.partitionBy("_range").orderBy(*order))
    small = (first.agg(F.sum(F.length("_head"))).first()[0] or 0) <= MOST_CHARS
    return rows.withColumn("_next", lead).join(F.broadcast(heads) if small else heads, "_range", "left").select("doc_id", "text", F.coalesce("_next", "_head").alias("_next"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text; other columns are ignored). A null text counts as empty; its n_chars is 0, its
    fingerprint empty, and it is wholly like its edited text. Texts of any length are read whole. Repeated rows are rows of their own. An empty table gives an empty result."""
    return with_next(docs).mapInArrow(_rows, SCHEMA)
