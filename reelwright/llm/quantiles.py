"""Mergeable quantile summaries by simultaneous bisection.

A summary of n numbers keeps those at the ranks ceil(k n / CUTS), its cut points, with exact counts of the numbers below and up to each. All
cut values of all groups are found at once by bisection: a value interval is halved by whether the counted numbers in its lower half reach the
rank. A counting pass over the numbers (hash aggregates, no sort) counts NODE intervals for each group, which serves as many halvings as NODE
has bits; passes go on until an interval holds few different numbers, and the last halvings are counted inside a task. Groups with few
different numbers need no pass at all. Nothing here grows with the input in one task, on the driver or in a broadcast: numbers are counted
where they lie, groups are cut into intervals, and what is broadcast is a fixed number of buckets in which large groups are.

Summaries are combined by summed bounds: at any value, each summary bounds how many of its numbers lie below and up to it, and so do the sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm.common import cut

#: Cut points of a summary, points of a combined one at most, smallest different numbers that every summary keeps.
CUTS, MOST_POINTS, SMALLEST = 40, 400, 4
#: Bits of an interval's number within the one above it; numbers of a group that a task may take whole; buckets that tell large groups.
BITS, FEW, BUCKETS = 9, 512, 1 << 16
#: Quantiles that are told, for groups of so many rows at least; batches.
PARTS, LEAST, BATCHES = 10, 20, 8
#: (number, target) pairs that are counted at a time.
CELLS = 1 << 21

POINT = "struct<x: bigint, below: bigint, upto: bigint>"
BOUND = "struct<x: bigint, below_least: bigint, below_most: bigint, upto_least: bigint, upto_most: bigint>"


class Nodes(NamedTuple):
    """Some groups' numbers in arrays: x and w (how often); where each group's begin, and the end; rows of the group below these."""

    x: np.ndarray
    w: np.ndarray
    begin: np.ndarray
    base: np.ndarray


def _pairs(begin: np.ndarray, owner: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Of targets (owner: each one's group): slices of them, the numbers of each one's group in a row, and where each one's begin."""
    size = (begin[1:] - begin[:-1])[owner]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        part, first = size[lo:hi], np.cumsum(size[lo:hi]) - size[lo:hi]
        yield slice(lo, hi), np.repeat(begin[:-1][owner[lo:hi]] - first, part) + np.arange(part.sum()), first
        lo = hi


def counts_at(nodes: Nodes, owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows below, and up to, each value in its owner's group."""
    below, upto = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    filled = np.flatnonzero(nodes.begin[1:][owner] > nodes.begin[:-1][owner])
    for part, at, first in _pairs(nodes.begin, owner[filled]):
        size = np.diff(np.append(first, len(at)))
        x, w, v = nodes.x[at], nodes.w[at], np.repeat(value[filled[part]], size)
        below[filled[part]] = np.add.reduceat(np.where(x < v, w, 0), first)
        upto[filled[part]] = np.add.reduceat(np.where(x <= v, w, 0), first)
    return below + nodes.base[owner], upto + nodes.base[owner]


def bisected(nodes: Nodes, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank-th smallest number (of the whole group; it is one of the node's) for each target: all intervals are halved together."""
    out = np.zeros(len(owner), np.int64)
    for part, at, first in _pairs(nodes.begin, owner):
        x, w = nodes.x[at], nodes.w[at]
        size = np.diff(np.append(first, len(at)))
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        left = rank[part] - nodes.base[owner[part]]
        while (low < high).any():
            mid = low + (high - low) // 2
            enough = np.add.reduceat(np.where(x <= np.repeat(mid, size), w, 0), first) >= left
            low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
        out[part] = low
    return out


def smallest(nodes: Nodes, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, number) of the `need` smallest different numbers of each group."""
    size = np.diff(nodes.begin)
    groups = np.flatnonzero(size > 0)
    last = np.full(len(size), np.iinfo(np.int64).min)
    owners, values = [], []
    for k in range(int(need.max(initial=0))):
        x = np.where(nodes.x > np.repeat(last, size), nodes.x, np.iinfo(np.int64).max)
        last[groups] = np.minimum.reduceat(x, nodes.begin[:-1][groups])
        more = groups[(need[groups] > k) & (last[groups] < np.iinfo(np.int64).max)]
        owners.append(more)
        values.append(last[more])
    return (np.concatenate(owners), np.concatenate(values)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def cut_ranks(n: int, cuts: int) -> np.ndarray:
    """1 and ceil(k n / cuts) for k in 1 .. cuts, each once."""
    return np.unique(np.append(-(-np.arange(1, cuts + 1) * n // cuts), 1)) if n > cuts else np.arange(1, n + 1)


def points_of(nodes: Nodes, n: np.ndarray, cuts: int, need: np.ndarray, ranks: list[np.ndarray] | None = None, probes: list[np.ndarray] | None = None) -> pa.ListArray:
    """For each node, POINTs: the numbers at its ranks (None: those of cut_ranks() for groups of n rows, whole in their node), its `need`
    smallest ones, and its probes (with counts, be they numbers of it or not)."""
    size, everything = np.diff(nodes.begin), np.arange(len(n))
    owners, values = [], []
    if ranks is None:  # where all rows have ranks that are asked for, all numbers are
        whole = n <= cuts
        owners.append(np.repeat(everything[whole], size[whole]))
        values.append(nodes.x[np.repeat(whole, size)])
        asked = [cut_ranks(int(n[k]), cuts) for k in everything[~whole]]
        of = np.repeat(everything[~whole], [len(a) for a in asked])
    else:
        asked, of = ranks, np.repeat(everything, [len(a) for a in ranks])
    owners.append(of)
    values.append(bisected(nodes, of, np.concatenate([np.zeros(0, np.int64), *asked])))
    for o, v in (smallest(nodes, need), (np.repeat(everything, [len(p) for p in probes or []]), np.concatenate([np.zeros(0, np.int64), *(probes or [])])) if probes else (of[:0], of[:0])):
        owners.append(o)
        values.append(v)
    both = np.unique(np.stack([np.concatenate(owners), np.concatenate(values)]), axis=1)
    below, upto = counts_at(nodes, both[0], both[1])
    fields = [pa.field(c, pa.int64()) for c in ("x", "below", "upto")]
    offsets = np.searchsorted(both[0], np.arange(len(n) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(both[1]), pa.array(below), pa.array(upto)], fields=fields))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int").alias("_bucket")


def _together(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, each group's in a row in one partition. They are sorted by a number first: names that begin alike are slow to compare."""
    return rows.withColumn("_hash", F.xxhash64(*keys)).sortWithinPartitions("_hash", *keys).drop("_hash")


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that lie together, and where each group begins (and the end)."""
    kept: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows == 0:
            continue
        kept += [] if batch is None else [batch]
        if not kept:
            return
        t = pa.Table.from_batches(kept).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        end = t.num_rows if batch is None else int(starts[-1])  # the last group may go on
        if end:
            yield t.slice(0, end), np.append(starts[starts < end], end)
        kept = t.slice(end).to_batches() if end < t.num_rows else []


def select(numbers: DataFrame, keys: Sequence[str], large: DataFrame, cuts: int, smallest_of: int = 0, probes: DataFrame | None = None) -> DataFrame:
    """keys, n and points (POINTs, by x) of each group of numbers (keys, x, w: how often, over 0; an x may be in many rows): the ones at the
    ranks of `cuts` cuts, and the `smallest_of` smallest different ones. probes (keys, x): only their groups are selected, the probes among
    the points. large: the _bucket of each group that has more than FEW rows; others may be in them."""
    keys = list(keys)
    kinds = dict(numbers.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    told = cut(large.select("_bucket").distinct().withColumn("_large", F.lit(True)))  # BUCKETS rows at most
    rows = numbers.select(*keys, "x", "w", _bucket(F.xxhash64(*keys))).join(F.broadcast(told), "_bucket", "left").drop("_bucket")
    few = rows.filter("_large IS NULL").drop("_large")
    if probes is not None:
        # A table: children of a union that are dealt alike would be taken as dealt already, though their partitions are coalesced apart.
        probes = cut(probes.select(*keys, "x").distinct())
        few = few.join(probes.select(*keys).distinct().hint("shuffle_hash"), keys, "left_semi")
        rest = probes.select(*keys, "x", F.lit(0).cast("long").alias("w"), _bucket(F.xxhash64(*keys))).join(F.broadcast(told), "_bucket", "left_anti")
        few = few.unionByName(rest.drop("_bucket"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _runs(batches, keys):
            x, w = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "w"))
            n = np.add.reduceat(w, begin[:-1])
            probe = np.flatnonzero(w == 0)
            of = np.searchsorted(begin, probe, "right") - 1
            probes = np.split(x[probe], np.searchsorted(of, np.arange(1, len(n)))) if len(probe) else None
            points = points_of(Nodes(x, w, begin, np.zeros(len(n), np.int64)), n, cuts, np.full(len(n), smallest_of), probes=probes)
            yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks().take(pa.array(begin[:-1])) for k in keys), pa.array(n), points], [*keys, "n", "points"])

    schema = f"{key_schema}, n bigint, points array<{POINT}>"
    out = _together(few.repartition(*keys), keys).mapInArrow(whole, schema)
    if told.isEmpty():
        return out
    many = cut(rows.filter("_large").groupBy(*keys, "x").agg(F.sum("w").alias("w")))
    return out.unionByName(_narrowed(many, keys, key_schema, cuts, smallest_of, probes))


def _narrowed(rows: DataFrame, keys: list[str], key_schema: str, cuts: int, smallest_of: int, probes: DataFrame | None) -> DataFrame:
    """select() of large groups, of which each x is one row: counting passes over ever smaller intervals."""
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    levels = max(1, -(-(int(high - low).bit_length() - BITS) // BITS))
    rows = rows.withColumn("node", F.shiftright(F.col("x") - F.lit(low), BITS))
    # Counted rows of each interval: those of a level are summed from the level below.
    counts = [cut(rows.groupBy(*keys, "node").agg(F.sum("w").alias("w")))]
    for _ in range(levels - 1):
        counts.append(counts[-1].groupBy(*keys, F.shiftright("node", BITS).alias("node")).agg(F.sum("w").alias("w")))
    state = None
    schema = f"{key_schema}, node bigint, n bigint, base bigint, need int, ranks array<bigint>, probes array<bigint>"
    for level in range(levels - 1, -1, -1):
        inside = counts[level].groupBy(*keys, F.shiftright("node", BITS).alias("node")).agg(F.collect_list(F.col("node").bitwiseAND((1 << BITS) - 1)).alias("child"), F.collect_list("w").alias("w"))
        if state is None:  # at the top, the interval of all numbers
            state = inside.withColumns({"n": F.aggregate("w", F.lit(0).cast("long"), lambda a, b: a + b), "base": F.lit(0).cast("long"), "need": F.lit(smallest_of), "ranks": F.lit(None).cast("array<bigint>")})
            if probes is None:
                state = state.withColumn("probes", F.lit(None).cast("array<bigint>"))
            else:
                state = state.join(probes.groupBy(*keys).agg(F.collect_list("x").alias("probes")), keys)
        else:
            state = state.join(inside, [*keys, "node"], "left")
        state = state.mapInArrow(_halver(keys, low, level, cuts), schema)
    leaves = rows.groupBy(*keys, "node").agg(F.collect_list("x").alias("x"), F.collect_list("w").alias("w"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                x, w, ranks, probed = ([np.array(v or [], np.int64) for v in b.column(c).to_pylist()] for c in ("x", "w", "ranks", "probes"))
                begin = np.cumsum([0, *map(len, x)])
                base, need, n = (b.column(c).to_numpy().astype(np.int64) for c in ("base", "need", "n"))
                points = points_of(Nodes(np.concatenate(x), np.concatenate(w), begin, base), n, cuts, need, ranks, probed)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("n"), points], [*keys, "n", "points"])

    found = state.join(leaves, [*keys, "node"], "left").mapInArrow(last, f"{key_schema}, n bigint, points array<{POINT}>")
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.flatten(F.collect_list("points"))).alias("points"))


def _halver(keys: list[str], low: int, level: int, cuts: int):  # noqa: ANN202
    """One counting pass for mapInArrow: each node's targets go on to the children that hold them."""
    shift = BITS * (level + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], []
            for k, (node, n, base, need, ranks, probes, child, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "n", "base", "need", "ranks", "probes", "child", "w")), strict=True)):
                for row in narrowed(np.array(child or [], np.int64), np.array(w or [], np.int64), base, need, cut_ranks(n, cuts) if ranks is None else np.array(ranks, np.int64), ((np.array(probes or [], np.int64) - low) >> shift) - (node << BITS), probes or []):
                    out.append(((node << BITS) + row[0], n, *row[1:]))
                    at.append(k)
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["node", "n", "base", "need", "ranks", "probes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, *names])

    return rows


def narrowed(child: np.ndarray, w: np.ndarray, base: int, need: int, ranks: np.ndarray, probe_child: np.ndarray, probes: list[int]) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(child, rows below it, need, ranks, probes) for each child interval in which a target of the node lies, from the children's counted
    rows. Every rank's interval is halved BITS times, all of them at once."""
    below = np.zeros((1 << BITS) + 1, np.int64)
    below[child + 1] = w
    filled = np.flatnonzero(below[1:])
    below = np.cumsum(below) + base
    at = np.zeros(len(ranks), np.int64)
    for half in (1 << k for k in range(BITS - 1, -1, -1)):
        at += np.where(below[at + half] < ranks, half, 0)
    # The k smallest numbers are among the k smallest of the first k children that have any, one less from each next one.
    needs = {int(c): need - k for k, c in enumerate(filled[:need])}
    return [(c, int(below[c]), needs.get(c, 0), ranks[at == c].tolist(), [p for p, o in zip(probes, probe_child, strict=True) if o == c]) for c in sorted({*at.tolist(), *probe_child.tolist(), *needs})]


def summarise(numbers: DataFrame, keys: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """keys, n, points (BOUNDs, by x) of each group of numbers (keys, x long, w long: how often, over 0; an x may be in many rows): its
    cut points and its SMALLEST smallest different numbers. Their bounds are exact."""
    # Groups that share a hash share a bucket as well: their rows may be counted together.
    large = numbers.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count("*").alias("_d")).filter(F.col("_d") > FEW).select(_bucket(F.col("_hash")))
    found = select(numbers, keys, large, cuts, SMALLEST)
    # Narrowing may find more of the small numbers than were asked for.
    asked = F.filter("points", lambda p, i: (i < SMALLEST) | (p["below"] == 0) | (F.call_function("div", p["upto"] * cuts, F.col("n")) > F.call_function("div", p["below"] * cuts, F.col("n"))))
    return found.select(*keys, "n", F.transform(asked, lambda p: F.struct(p["x"].alias("x"), p["below"].alias("below_least"), p["below"].alias("below_most"), p["upto"].alias("upto_least"), p["upto"].alias("upto_most"))).alias("points"))


def combined(group: np.ndarray, n: np.ndarray, begin: np.ndarray, p: dict[str, np.ndarray], most: int = MOST_POINTS) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of summaries (n rows each, points from begin on in p; group: rising from 0) one for each group, by summed bounds at all their points: n,
    where its points begin (and the end), and points. Beyond `most` of these, the SMALLEST first, the last, and those that are nearest to
    evenly spaced ranks stay.

    A summary's bounds are steps: between two points, what reaches up to the one before and what lies below the one after. So a group's
    sums at an x are the steps of all its points before x, and those that the points at x make there."""
    first, last = begin[:-1], begin[1:] - 1
    least, above = np.append(0, p["upto_least"][:-1]), np.append(p["below_most"][1:], 0)  # just below each point, just above it
    least[first], above[last] = 0, n
    above_least, most_below = p["upto_least"], p["below_most"].copy()
    most_below[first] = 0  # the first point is the smallest number
    of = np.repeat(group, np.diff(begin))
    order = np.lexsort((p["x"], of))
    x, of = p["x"][order], of[order]
    starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (of[1:] != of[:-1])))
    owner = of[starts]
    ends = np.searchsorted(owner, np.arange(group[-1] + 2))
    out = {"x": x[starts]}
    for low, high, names in ((least, above_least, ("below_least", "upto_least")), (most_below, above, ("below_most", "upto_most"))):
        step = (high - low)[order]
        before = (np.cumsum(step) - step)[starts]
        before -= before[ends[:-1]][owner]
        for c in names:
            out[c] = before + np.add.reduceat((p[c] - low)[order], starts)
    total = np.add.reduceat(n, np.searchsorted(group, np.arange(group[-1] + 1)))
    if (np.diff(ends) > most).any():
        kept = []
        for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            stay = np.arange(lo, hi)
            if hi - lo > most:
                even = -(-np.arange(1, most - SMALLEST) * total[k] // (most - SMALLEST))
                stay = lo + np.unique(np.concatenate([np.arange(SMALLEST), [hi - lo - 1], nearest({c: v[lo:hi] for c, v in out.items()}, even)]))
            kept.append(stay)
        ends = np.cumsum([0, *map(len, kept)])
        out = {c: v[np.concatenate(kept)] for c, v in out.items()}
    return total, ends, out


def nearest(p: dict[str, np.ndarray], targets: np.ndarray) -> np.ndarray:
    """For each target rank (rising), the point whose rank can be off by the least; the first of equal ones, never one before the last."""
    return np.maximum.accumulate(_off(p, targets).argmin(1))


def _off(p: dict[str, np.ndarray], targets: np.ndarray) -> np.ndarray:
    """By how much each point's rank can be off each target. It is 0 for one point at most, which then has the target's rank for certain."""
    return np.maximum(0, np.maximum(p["below_most"][None] + 1 - targets[:, None], targets[:, None] - p["upto_least"][None]))


def _point_arrays(points: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each list begins (and the end), and all points."""
    flat = points.flatten()
    return np.append(0, np.cumsum(points.value_lengths().to_numpy())).astype(np.int64), {f.name: flat.field(i).to_numpy() for i, f in enumerate(flat.type)}


def _point_list(begin: np.ndarray, points: dict[str, np.ndarray]) -> pa.ListArray:
    names = ["x", "below_least", "below_most", "upto_least", "upto_most"]
    flat = pa.StructArray.from_arrays([pa.array(points[c]) for c in names], fields=[pa.field(c, pa.int64()) for c in names])
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), flat)


def merge(summaries: DataFrame, keys: Sequence[str], most: int = MOST_POINTS) -> DataFrame:
    """keys, n, points: one summary for each group of summaries (keys, n, points), of which a task holds some groups' at a time: as many
    of each as there are batches."""
    keys = list(keys)
    kinds = dict(summaries.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches, keys):
            begin, points = _point_arrays(t.column("points").combine_chunks())
            n, ends, points = combined(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), t.column("n").to_numpy(), begin, points, most)
            yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks().take(pa.array(starts[:-1])) for k in keys), pa.array(n), _point_list(ends, points)], [*keys, "n", "points"])

    grouped = _together(summaries.select(*keys, "n", "points").repartition(*keys), keys)
    return grouped.mapInArrow(rows, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", n bigint, points array<{BOUND}>")


def answers(summaries: DataFrame, keys: Sequence[str], parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """keys, n, points (how many), and for i in 1 .. parts - 1 of summaries of at least `least` rows: i, target (the rank ceil(i n / parts)),
    answer (a number of the summary, by bounds of ranks alone). exact_x (the number of that rank), n_below and n_upto (rows below and up to the
    answer) are told where the bounds leave no doubt, as those of cut points and of groups that are kept whole; they are null elsewhere."""
    keys = list(keys)
    kinds = dict(summaries.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy()
            begin, points = _point_arrays(b.column("points"))
            told = np.arange(1, parts)
            targets = -(-told[None] * n[:, None] // parts)
            best, certain = np.zeros((2, *targets.shape), np.int64), np.zeros(targets.shape, bool)
            for k, (lo, hi) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                off = _off({c: points[c][lo:hi] for c in ("below_most", "upto_least")}, targets[k])
                at = off.argmin(1)
                certain[k], best[0, k], best[1, k] = off[np.arange(len(at)), at] == 0, lo + at, lo + np.maximum.accumulate(at)
            (nearest_at, answer), sure = best.reshape(2, -1), certain.ravel()
            at = pa.array(np.repeat(np.arange(len(n)), parts - 1))
            counts = [pa.array(points[f"{c}_least"][answer], mask=points[f"{c}_least"][answer] != points[f"{c}_most"][answer]) for c in ("below", "upto")]
            columns = [*(b.column(k).take(at) for k in keys), b.column("n").take(at), pa.array(np.diff(begin)).take(at), pa.array(np.tile(told, len(n)).astype(np.int32)), pa.array(targets.ravel()), pa.array(points["x"][answer]), pa.array(points["x"][nearest_at], mask=~sure), *counts]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n", "points", "i", "target", "answer", "exact_x", "n_below", "n_upto"])

    return summaries.filter(F.col("n") >= least).mapInArrow(rows, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, points bigint, i int, target bigint, answer bigint, exact_x bigint, n_below bigint, n_upto bigint")


def counted(told: DataFrame, exact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """told (answers()) with exact_x, n_below and n_upto from each group's points in `exact` (keys, points: POINTs): the points that hold
    the targets' ranks, and those that are the answers."""
    row = told.join(exact.select(*keys, F.col("points").alias("_exact")), list(keys))
    holds = F.filter("_exact", lambda p: (p["below"] < F.col("target")) & (p["upto"] >= F.col("target")))[0]
    given = F.filter("_exact", lambda p: p["x"] == F.col("answer"))[0]
    return row.withColumns({"exact_x": holds["x"], "n_below": given["below"], "n_upto": given["upto"]}).drop("_exact")


def checked(row: DataFrame) -> DataFrame:
    """Answers that have exact counts, with rank_error and within."""
    off = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return row.withColumn("rank_error", off).withColumn("within", 1000 * F.col("rank_error") <= 50 * F.col("n"))


def _batch(record: str) -> Column:
    """CRC-32 of the record's number as text, modulo BATCHES; a missing number counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(record).cast("string"), F.lit("")).cast("binary")), F.lit(BATCHES)).cast("int")


def _numbers(rows: DataFrame, stream: str, grp: str, money: str, w: Column) -> DataFrame:
    """stream, grp, batch, x, w of rows (batch among their columns) that have a group and a finite amount: x is the amount in hundredths,
    rounded, with 1000 more for each batch."""
    finite = F.col(money).isNotNull() & ~F.isnan(money) & (F.abs(money) < F.lit(float("inf")))
    x = F.floor(F.lit(100) * F.col(money) + F.lit(0.5)) + 1000 * F.col("batch")
    return rows.filter(finite & F.col(grp).isNotNull()).select(F.lit(stream).alias("stream"), F.col(grp).cast("string").alias("grp"), "batch", x.cast("long").alias("x"), w.cast("long").alias("w"))


def streams(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, x, w of both streams.

    `value`: a row for each click_id (of repeated ones the greatest client_id and value, which are equal in copies), by client. `price`: every
    line with its item's price, by brand, one row for each different x of a batch of a brand; lines are counted by item and batch before they
    meet their items, so a popular item is few rows.
    """
    once = clicks.groupBy("click_id").agg(F.max("client_id").alias("client_id"), F.max("value").alias("value")).withColumn("batch", _batch("click_id"))
    sold = sale_lines.filter(F.col("item_id").isNotNull()).groupBy("item_id", _batch("vendor_id").alias("batch")).agg(F.count("*").alias("w"))
    priced = sold.join(items.select("item_id", "brand", "price"), "item_id")
    prices = _numbers(priced, "price", "brand", "price", F.col("w")).groupBy("stream", "grp", "batch", "x").agg(F.sum("w").alias("w"))
    return _numbers(once, "value", "client_id", "value", F.lit(1)).unionByName(prices)


def stream_quantiles(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch (-1: all), i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within: each batch's summary and the
    one that is merged from them, asked for the tenths of every group of at least LEAST rows and held against exact counts.

    The merged summary is made from the batches' summaries alone. Where its bounds leave the exact counts open, they come from a selection by
    ranks over all numbers of the group, in which the answers are probes. Rows without an item, group or (finite) amount are left out; a missing record number counts as empty text.
    Repeated clicks count once, repeated lines each time; equal numbers are one point with its count. Other columns are ignored; empty tables
    give an empty result.
    """
    numbers = cut(streams(clicks, sale_lines, items))
    by_batch, by_group = ["stream", "grp", "batch"], ["stream", "grp"]
    parts = cut(summarise(numbers, by_batch))
    whole = cut(answers(merge(parts, by_group), by_group))
    # A batch's cut points have exact counts, and the ranks of the tenths are among its cuts.
    batches = checked(answers(parts, by_batch))
    sure = F.col("exact_x").isNotNull() & F.col("n_below").isNotNull() & F.col("n_upto").isNotNull()
    doubtful = whole.filter(~sure)
    # Large groups without doubtful answers are told as well: a task can't take their rows either.
    large = whole.filter(F.col("n") > FEW).select(_bucket(F.xxhash64(*by_group)))
    exact = select(numbers, by_group, large, PARTS, probes=doubtful.select(*by_group, F.col("answer").alias("x")))
    groups = checked(whole.filter(sure).unionByName(counted(doubtful, exact, by_group))).withColumn("batch", F.lit(-1))
    return batches.unionByName(groups).select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")


SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (SELECT DISTINCT id, hex(encode(coalesce(cast(id AS VARCHAR), ''))) AS h FROM (SELECT click_id AS id FROM clicks UNION SELECT vendor_id FROM sale_lines)),
batches AS (
  SELECT id, cast(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[cast(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % {BATCHES} AS INTEGER) AS batch
  FROM ids, crc_table),
once AS (SELECT click_id, max(client_id) AS client_id, max(value) AS value FROM clicks GROUP BY click_id),
told AS (
  SELECT 'value' AS stream, cast(client_id AS VARCHAR) AS grp, click_id AS id, value AS money FROM once
  UNION ALL SELECT 'price', brand, vendor_id, price FROM sale_lines JOIN items USING (item_id)),
num AS (
  SELECT stream, grp, batch, cast(floor(100 * money + 0.5) AS BIGINT) + 1000 * batch AS x, count(*) AS w
  FROM told JOIN batches ON told.id IS NOT DISTINCT FROM batches.id WHERE grp IS NOT NULL AND money IS NOT NULL GROUP BY ALL),
cum AS (
  SELECT stream, grp, batch, x, cast(sum(w) OVER o AS BIGINT) - w AS below, cast(sum(w) OVER o AS BIGINT) AS upto,
    cast(sum(w) OVER k AS BIGINT) AS n, row_number() OVER o AS place
  FROM num WINDOW k AS (PARTITION BY stream, grp, batch), o AS (PARTITION BY stream, grp, batch ORDER BY x)),
points AS (SELECT * FROM cum WHERE place <= {SMALLEST} OR below = 0 OR upto * {CUTS} // n > below * {CUTS} // n),
part AS (SELECT DISTINCT stream, grp, batch, n FROM cum),
cand AS (SELECT DISTINCT stream, grp, x FROM points),
bound AS (
  SELECT c.stream, c.grp, c.x, part.batch, any_value(part.n) AS n, max(p.upto) FILTER (p.x < c.x) AS before, min(p.below) FILTER (p.x > c.x) AS after,
    max(p.below) FILTER (p.x = c.x) AS below, max(p.upto) FILTER (p.x = c.x) AS upto
  FROM cand c JOIN part USING (stream, grp) JOIN points p ON p.stream = c.stream AND p.grp = c.grp AND p.batch = part.batch GROUP BY ALL),
merged AS (
  SELECT stream, grp, x, sum(coalesce(below, CASE WHEN before IS NULL THEN 0 ELSE coalesce(after, n) END)) AS below_most,
    sum(coalesce(upto, before, 0)) AS upto_least FROM bound GROUP BY ALL),
kept AS (
  SELECT stream, grp, batch, n, count(*) AS points FROM points GROUP BY ALL
  UNION ALL SELECT stream, grp, -1, (SELECT sum(n) FROM part WHERE part.stream = m.stream AND part.grp = m.grp), count(*) FROM merged m GROUP BY ALL),
asked AS (SELECT kept.*, i, (i * n + {PARTS} - 1) // {PARTS} AS target FROM kept, range(1, {PARTS}) AS r(i) WHERE n >= {LEAST}),
exact AS (
  SELECT stream, grp, batch, x, below, upto FROM cum
  UNION ALL
  SELECT stream, grp, -1, x, sum(w) OVER (PARTITION BY stream, grp ORDER BY x) - w, sum(w) OVER (PARTITION BY stream, grp ORDER BY x)
  FROM (SELECT stream, grp, x, sum(w) AS w FROM num GROUP BY ALL)),
summary AS (SELECT stream, grp, batch, x, below AS below_most, upto AS upto_least FROM points UNION ALL SELECT stream, grp, -1, x, below_most, upto_least FROM merged),
best AS (
  SELECT stream, grp, batch, n, points, i, target, arg_min(x, (greatest(0, below_most + 1 - target, target - upto_least), x)) AS x
  FROM asked JOIN summary USING (stream, grp, batch) GROUP BY ALL),
answered AS (SELECT stream, grp, batch, n, points, i, target, max(x) OVER (PARTITION BY stream, grp, batch ORDER BY i) AS answer FROM best),
full_rows AS (
  SELECT a.*, e.x AS exact_x, g.below AS n_below, g.upto AS n_upto, greatest(0, g.below + 1 - target, target - g.upto) AS rank_error
  FROM answered a JOIN exact e ON e.stream = a.stream AND e.grp = a.grp AND e.batch = a.batch AND e.below < target AND e.upto >= target
  JOIN exact g ON g.stream = a.stream AND g.grp = a.grp AND g.batch = a.batch AND g.x = a.answer)
SELECT stream, grp, batch::INTEGER AS batch, i::INTEGER AS i, n::BIGINT AS n, target::BIGINT AS target, exact_x::BIGINT AS exact_x, points::BIGINT AS points, answer::BIGINT AS answer,
  n_below::BIGINT AS n_below, n_upto::BIGINT AS n_upto, rank_error::BIGINT AS rank_error, 1000 * rank_error <= 50 * n AS within
FROM full_rows
"""
