"""Exact n-gram Jaccard join with set-relation skipping.

Screening: a set that links to another one shares t of its shingles with it, so at most 1 - t of them stand in no other set. Shingles are
grouped, half of them by their hash first, then all of those that are left, and sets with too many of their own are out: passages that
many documents share don't make candidates.

Candidate groups come from partition signatures. Sets that may link fall into one or two neighbouring classes of size; in a class, a link
leaves room for fewer differing shingles than the class has parts of the hash range, so two linked sets agree in a whole part. Each set is
posted under the hash of its shingles in each part; sets with a posting in common are chained. Tasks combine equal postings before the
shuffle, so a group of copies sends one per task.

The texts of a small group then meet in one unit of work; a large group is cut by classes of size and into blocks, with a unit for each
pair of blocks, and its units are dealt to tasks in turn. In a unit

- index skipping: lists of a token's sets are ordered by the token's position in the set, then by size. Of a list, a search reads the
  blocks of positions that leave room for the overlap a link needs, and in a block the sizes that may link; the rest is skipped unread;
- answer skipping: a set that links to an answered one takes over its overlaps and corrects them by the lists of the few tokens in which
  the two differ. An answer holds the sets that share enough to matter to any such set, and is dropped once larger sets can't link to its own.

Equal sets are one node throughout. No pair is ever a row: a unit returns each set with its least linked set and its number of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import cut, discard
from reelwright.llm.components import components
from reelwright.llm.shingles import sets_of

N, THRESHOLD = 4, 85
#: Postings that a task combines at a time.
FLUSH = 400_000
#: Shingles and sets of a unit. A group (or band) with more of either is cut into blocks, two of which make a unit: as many as the shingles
#: ask for, or as the sets do, up to FINE.
UNIT, UNIT_SETS, FINE = 1_000_000, 240, 13
#: Entries of answers that a unit holds; beyond that the oldest ones go, whose followers search for themselves.
MOST_HELD = 2_000_000
#: Candidates of a set that are worth another filter before their overlaps are counted.
MANY = 32
#: Rows of a side that may be broadcast.
MOST_BROADCAST = 500_000


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def node_of(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "big", signed=True)


def least_overlap(n: int, t: int = THRESHOLD) -> int:
    """What a set of n must share with any set that it links to: ceil(t n / 100)."""
    return -(-t * n // 100)


def _summaries(n: int):
    """doc_id, text_hash, n, sid of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sids = [], []
            for s in sets_of(batch.column("text"), n):
                sizes.append(len(s))
                sids.append(set_id(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary())], ["doc_id", "text_hash", "n", "sid"])

    return rows


@lru_cache(100_000)
def size_class(n: int, t: int = THRESHOLD) -> tuple[int, int]:
    """The class of sets of n, and the class's largest size. Partners of a set, if not larger, are in its class or the one below."""
    label, low = 0, 1
    while True:
        above = low * 100 // t + 1
        if n < above:
            return label, above - 1
        label, low = label + 1, above


@lru_cache(10_000)
def parts_of(high: int, t: int = THRESHOLD) -> tuple[int, int]:
    """(most shingles in which linked sets of at most `high` can differ, parts to cut the hash range into).

    Linked sets agree in all parts but as many as they have differing shingles. Parts beyond that make up for those that are empty in both.
    """
    most = 2 * high * (100 - t) // (100 + t)
    parts = most + 1
    for _ in range(3):
        empty = parts * np.exp(-0.85 * high / parts)
        parts = most + 1 + int(np.ceil(empty + 3 * np.sqrt(empty)))
    return most, parts


def signatures(s: np.ndarray, t: int = THRESHOLD) -> np.ndarray:
    """Hashes of s in each part that has shingles, in its own class and, as a smaller partner, in the one above. A set with so many empty
    parts that they might be all that it shares with a partner of that kind is posted under its first shingles as well."""
    out = []
    label, high = size_class(len(s), t)
    mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for k in (0, 1):
        top = high if k == 0 else size_class(high + 1, t)[1]
        most, parts = parts_of(top, t)
        if not most:
            continue  # only equal sets link
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # s is sorted, so parts are runs
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        x = np.add.reduceat(mixed, at) + part[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((label + k + 1) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        out.append(x * np.uint64(0xD6E8FEB86659FD93))
        if parts - len(at) >= parts - most:
            out.append(mixed[: len(s) - least_overlap(len(s), t) + 1] ^ np.uint64((label + k + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def combined(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings with one per signature, that of its least node; the other nodes of a signature are posted, once, under that node."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    leader = node[new][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([leader[~new], node[~new]], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    leaders = np.unique(pairs[:, 0])
    return np.concatenate([sig[new], leaders, pairs[:, 0]]), np.concatenate([node[new], leaders, pairs[:, 1]])


def _tokens(n: int, half: bool):
    """token, node of each distinct set of a task; half: of the even tokens only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, nodes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(nodes, [len(x) for x in tokens]))], ["token", "node"])

        for batch in batches:
            for s in sets_of(batch.column("text"), n):
                node = node_of(set_id(s))
                if len(s) and node not in seen:
                    seen.add(node)
                    s = s[s & np.uint64(1) == 0] if half else s
                    tokens.append(s)
                    nodes.append(node)
                    held += len(s)
                    if held >= FLUSH:
                        yield flush()
                        tokens, nodes, held = [], [], 0
        if held:
            yield flush()

    return rows


def _screened(sets: DataFrame, tokens: DataFrame, t: int) -> DataFrame:
    """The rows of sets (node, n) but those with more tokens of their own than a link leaves room for."""
    alone = tokens.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("_max")).filter("node = _max")
    alone = alone.groupBy("node").agg(F.count("*").alias("_alone"))
    room = F.col("n") - F.ceil(F.col("n") * t / 100)
    return sets.join(alone, "node", "left").filter(F.coalesce("_alone", F.lit(0)) <= room).drop("_alone")


def _postings(n: int, t: int):
    """sig, node of each set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            sig, node = combined(np.concatenate(sigs).view(np.int64), np.concatenate(nodes))
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])

        for batch in batches:
            for s in sets_of(batch.column("text"), n):
                x = signatures(s, t)
                sigs.append(x)
                nodes.append(np.full(len(x), node_of(set_id(s)), np.int64))
                held += len(x)
                if held >= FLUSH:
                    yield flush()
                    sigs, nodes, held = [], [], 0
        if held:
            yield flush()

    return rows


def _chains(postings: DataFrame) -> DataFrame:
    """u, v: each node of a signature's list with the one before it."""
    return postings.withColumn("u", F.lag("node").over(Window.partitionBy("sig").orderBy("node"))).filter("u <> node").select("u", F.col("node").alias("v"))


class Group:
    """Sets that may link (at threshold t), with the lists that their join reads. Sets are asked for in order of size, each once."""

    def __init__(self, sets: list[np.ndarray], t: int = THRESHOLD):
        self.t, self.count = t, len(sets)
        self.order = np.argsort([len(s) for s in sets], kind="stable")  # sets are numbered by size
        sets = [sets[i] for i in self.order.tolist()]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, local, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        #: Of each set, one after another: its tokens, rare ones first. Tokens are numbered by rank.
        self.tokens = rank[local]
        self.tokens = self.tokens[np.lexsort((self.tokens, owner))]
        place = np.arange(len(owner)) - np.repeat(self.ends - self.sizes, self.sizes)
        self.width = int(self.sizes.max(initial=0)) + 1
        #: Of each entry: token, position and set in one number, sorted. Units keep this within 63 bits.
        self.entries = np.sort((self.tokens * self.width + place) * self.count + owner)
        self.lists = np.searchsorted(self.entries, np.arange(len(df) + 1) * (self.width * self.count))
        self.owner = (self.entries % self.count).astype(np.int32)
        self.mark, self.hit = np.zeros(len(df), bool), np.zeros(len(sets), bool)
        self.slot = np.full(len(sets), -1, np.int64)
        self.near = np.full(len(sets), -1, np.int64)  # the answered set to derive from
        self.shared = np.zeros(len(sets), np.int64)  # the overlap with it
        self.answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.held = self.searched = 0

    def own(self, x: int) -> np.ndarray:
        return self.tokens[self.ends[x] - self.sizes[x] : self.ends[x]]

    def _distinct(self, ys: np.ndarray) -> np.ndarray:
        self.hit[ys] = True
        out = np.flatnonzero(self.hit)
        self.hit[out] = False
        return out

    def _found(self, x: int, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Sets with an entry that leaves room: at x's i-th token, sizes up to most[i] (rising i: falling); at position j, from least[j]."""
        tokens = self.own(x)[: len(most)]
        lo, hi = self.lists[tokens], self.lists[tokens + 1]
        many = hi - lo > 1
        i = np.flatnonzero(many)
        if not len(i):
            return i
        tokens, most, lo, hi = tokens[i], most[i], lo[i], hi[i]
        reach = np.searchsorted(least, most, side="right")  # positions with sizes in reach
        if int(reach.sum()) * 8 > int((hi - lo).sum()):  # short lists: entry by entry
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
            bound, y, j = np.repeat(most, hi - lo), self.owner[at], self.entries[at] // self.count % self.width
            size, ok = self.sizes[y], j < len(least)
            ok &= (size <= bound) & (size >= least[np.minimum(j, len(least) - 1)])
            return self._distinct(y[ok])
        k = np.repeat(np.arange(len(i)), reach)  # a pair of token and block of positions each
        j = np.arange(len(k)) - np.repeat(np.cumsum(reach) - reach, reach)
        base = (tokens[k] * self.width + j) * self.count
        a = np.searchsorted(self.entries, base + np.searchsorted(self.sizes, least[j]))
        b = np.searchsorted(self.entries, base + np.searchsorted(self.sizes, most[k], side="right"))
        full = np.flatnonzero(b > a)
        if not len(full):
            return full
        a, n = a[full], (b - a)[full]
        return self._distinct(self.owner[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))])

    def _overlaps(self, x: int, ys: np.ndarray) -> np.ndarray:
        """|x and y| of each y."""
        n = self.sizes[ys]
        at = np.repeat(self.ends[ys] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        own = self.own(x)
        self.mark[own] = True
        out = np.add.reduceat(self.mark[self.tokens[at]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        self.mark[own] = False
        return out

    def _linked(self, x: int, ys: np.ndarray, o: np.ndarray) -> np.ndarray:
        return (100 * o >= self.t * (self.sizes[x] + self.sizes[ys] - o)) & (ys != x)

    def _answer(self, x: int, links: np.ndarray, shared: np.ndarray) -> None:
        """Keeps x's overlaps for the larger sets among its links.

        Let y link to such a set z. z lacks of x, and y of z, less than 1 - t of the joint sets, so x and y share (2t - 1) |z| or more.
        """
        later = links > x
        if not later.any():
            return
        n, t = int(self.sizes[x]), self.t
        least = max(1, -(-(2 * t - 100) * n // 100))
        low, high = t * t * n // 10_000, -(-10_000 * n // (t * t))
        positions = np.maximum(low, least + np.arange(max(0, high - least + 1)))
        ys = self._found(x, np.full(n - least + 1, high), positions)
        o = self._overlaps(x, ys)
        ys, o = ys[o >= least], o[o >= least].astype(np.int32)
        self.answers[x] = ys.astype(np.int32), o
        self.held += len(ys)
        links, shared = links[later], shared[later]
        better = links[shared > self.shared[links]]
        self.near[better], self.shared[better] = x, shared[shared > self.shared[links]]
        while self.answers and (self.held > MOST_HELD or self.sizes[next(iter(self.answers))] * 100 < t * n):
            oldest = next(iter(self.answers))
            self.held -= len(self.answers.pop(oldest)[0])
            self.near[self.near == oldest], self.shared[self.near == oldest] = -1, 0

    def _holders(self, tokens: np.ndarray) -> np.ndarray:
        """The sets of the tokens' whole lists, one list after another."""
        return np.concatenate([self.owner[a:b] for a, b in zip(self.lists[tokens].tolist(), self.lists[tokens + 1].tolist(), strict=True)])

    def _listed(self, tokens: np.ndarray, into: int) -> np.ndarray:
        """How many of tokens each set of the present answer has."""
        return np.bincount(self.slot[self._holders(tokens)] + 1, minlength=into + 1)[1:]

    def links(self, x: int) -> np.ndarray:
        """The other sets that link to set number x; to be asked for 0, 1, 2, ... in turn."""
        if (r := int(self.near[x])) >= 0:
            ys, o = self.answers[r]
            self.slot[ys] = np.arange(len(ys))
            a, b = self.own(x), self.own(r)
            more, less = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
            o = o.astype(np.int64)
            if len(more):
                o += self._listed(more, len(ys))
            if len(less):
                o -= self._listed(less, len(ys))
            self.slot[ys] = -1
            return ys[self._linked(x, ys, o)].astype(np.int64)
        self.searched += 1
        n, t = int(self.sizes[x]), self.t
        i = np.arange(n - least_overlap(n, t) + 1)
        most = (100 * n - (100 + t) * i) // t  # sizes that the tokens from the i-th on can still link to
        high = int(most[0])
        j = np.arange(max(0, (100 * high - t * n) // (100 + t)) + 1)
        ys = self._found(x, most[most >= least_overlap(n, t)], -(-(t * n + (100 + t) * j) // 100))
        ys = ys[ys != x]
        if len(ys) > MANY:  # a set that links lacks few of x's tokens, so has most of any of them
            some = self.own(x)[: len(i) + 16]
            lacks = len(some) - np.bincount(self._holders(some), minlength=self.count)[ys]
            ys = ys[(100 + t) * (n - lacks) >= t * (n + self.sizes[ys])]
        if not len(ys):
            return ys
        o = self._overlaps(x, ys)
        keep = self._linked(x, ys, o)
        if keep.any():
            self._answer(x, ys[keep], o[keep])
        return ys[keep]


def joined(sids: list[bytes], sets: list[np.ndarray], copies: np.ndarray, t: int, counts=None) -> list[tuple[bytes, bytes, int]]:
    """(sid, least sid connected to it, links weighted by copies) of each set that links. counts(x, ys): which of its links count here."""
    group = Group(sets, t)
    order, links, root = group.order, np.zeros(len(sids), np.int64), np.arange(len(sids))
    for x in range(len(sids)):
        y, own = order[group.links(x)], int(order[x])
        if counts is not None:
            y = y[counts(own, y)]
        if not len(y):
            continue
        links[own] = copies[y].sum()
        met = root[y]
        if (met != root[own]).any():  # classes of the least numbers, kept flat
            met = np.unique(np.append(met, root[own]))
            root[np.isin(root, met)] = met[0]
    return [(s, sids[root[i]], int(links[i])) for i, s in enumerate(sids) if links[i]]


RESULT = "pairs boolean, sid binary, label binary, links long"


def _units(n: int, t: int):
    """RESULT for rows sorted by (group, band, i, j, blocks), a unit each: a pair counts in the band of its larger set; band -1 has all sets."""

    def one(key: tuple, rows: dict[bytes, tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sids = sorted(rows)
        side, copies, label = (np.array([rows[s][k] for s in sids]) for k in (1, 2, 3))

        def counts(x: int, y: np.ndarray) -> np.ndarray:
            ok = np.maximum(label[y], label[x]) == key[1] if key[1] >= 0 else np.ones(len(y), bool)
            return ok & (side[y] != side[x]) if key[2] != key[3] else ok

        sets = list(sets_of(pa.array([rows[s][0] for s in sids], pa.large_binary()), n))
        alone = key[1] < 0 and key[4] == 1
        return [(not alone, *r) for r in joined(sids, sets, copies, t, None if alone else counts)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["pairs", "sid", "label", "links"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, {}, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                for text, *now, sid, side, copies, label in zip(texts, *(part.column(c).to_pylist() for c in ("group", "band", "i", "j", "blocks", "sid", "side", "copies", "label")), strict=True):
                    if tuple(now) != key:
                        if held:
                            done += one(key, held)
                            if len(done) > 5000:
                                yield out(done)
                                done = []
                        key, held = tuple(now), {}
                    held[sid] = text, side, copies, label
        if held:
            done += one(key, held)
        if done:
            yield out(done)

    return tasks


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _units_of(members: DataFrame, threshold: int, unit: int, unit_sets: int) -> DataFrame:
    """members (sid, n, group, ...) with label, group, band, side, blocks, _first (the number of the band's first unit)."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // threshold + 1)
    label = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("n"))) - 1
    members = members.withColumn("label", label)
    # A group of three classes of size at most is one band, -1; others have a band for each class, met by that class and the one below.
    groups = members.groupBy("group").agg((F.max("label") - F.min("label") <= 2).alias("_one"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    members = members.join(groups, "group").withColumn("band", F.explode(F.when(F.col("_one"), F.array(F.lit(-1))).otherwise(F.array(F.col("label"), F.col("label") + 1))))
    n, sets = F.sum("n"), F.count("*")
    pieces = F.greatest(F.ceil(2 * n / unit), F.least(F.ceil(2 * sets / unit_sets), F.lit(FINE))).cast("int")
    blocks = F.when((n <= unit) & (sets <= unit_sets), 1).otherwise(F.greatest(pieces, F.lit(3)))
    bands = members.groupBy("group", "band").agg(blocks.cast("int").alias("blocks"), (F.max("label") >= F.col("band")).alias("_own")).filter("_own").drop("_own")
    before = Window.partitionBy("group").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_first", F.coalesce(F.sum((F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long")).over(before), F.lit(0)))
    side = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    return members.join(bands, ["group", "band"]).withColumn("side", side).drop("n", "_one")


def classes(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, unit: int = UNIT, unit_sets: int = UNIT_SETS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, sid of every row; sid, label, links of every set that links to another one).

    docs: doc_id, text; other columns are ignored. All texts are read twice, for their sets and for half of their tokens; from there on
    only the texts of sets that the screening left, a text of each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("text_hash"))
    rows = cut(docs.mapInArrow(_summaries(n), "doc_id long, text_hash long, n long, sid binary"))
    # Of each set one row stands for all.
    keys = rows.filter("n > 0").groupBy("sid", "doc_id", "text_hash").agg(F.count("*").alias("_c"), F.max("n").alias("n"))
    sets = keys.groupBy("sid").agg(F.sum("_c").alias("copies"), F.max("n").alias("n"), F.min(F.struct("_c", "doc_id", "text_hash")).alias("_k"))
    sets = sets.select("sid", "copies", "n", F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long").alias("node"), F.col("_k.doc_id").alias("_doc"), F.col("_k.text_hash").alias("_hash"), F.col("_k._c").alias("_rows"))
    token = "token long, node long"
    left = cut(_screened(sets, docs.select("text").mapInArrow(_tokens(n, True), token), threshold))
    texts = docs.join(_bounded(left), docs["doc_id"].eqNullSafe(left["_doc"]) & (docs["text_hash"] == left["_hash"])).drop("doc_id", "text_hash", "_doc", "_hash")
    if not left.filter("_rows > 1").isEmpty():  # rows that are repeated as often as the rarest of their set's: one of them
        once = texts.filter("_rows > 1").groupBy("sid", "copies", "n", "node").agg(F.min("text").alias("text"))
        texts = texts.filter("_rows = 1").drop("_rows").unionByName(once)
    texts = cut(texts.select("sid", "copies", "n", "node", "text"))
    again = cut(_screened(texts.select("node", "n"), texts.select("text").mapInArrow(_tokens(n, False), token), threshold).select("node"))
    texts = texts.join(_bounded(again), "node", "left_semi")
    linked = components(_chains(texts.select("text").mapInArrow(_postings(n, threshold), "sig long, node long")))
    found = linked.select("node", F.col("label").alias("group"))
    members = cut(_units_of(texts.drop("text").join(found, "node").drop("node"), threshold, unit, unit_sets))
    # A group's units go to tasks in turn, from a place of its own on.
    met = texts.select("sid", "text").join(_bounded(members), "sid").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("side", "_o"), "j": F.greatest("side", "_o")})
    at = F.col("_first") + (F.col("j") * (F.col("j") + 1) / 2).cast("long") + F.col("i")
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.select(F.pmod(F.pmod(F.xxhash64("group"), F.lit(parts)) + at, F.lit(parts)).cast("int").alias("_task"), "group", "band", "i", "j", "blocks", "sid", "text", "side", "copies", "label")
    met = met.repartitionById(parts, "_task").sortWithinPartitions("group", "band", "i", "j")
    result = cut(met.mapInArrow(_units(n, threshold), RESULT))
    for done in (left, texts, again, linked, members):
        discard(done)
    whole = result.filter("NOT pairs").select("sid", "label", "links")
    split = result.filter("pairs")
    if split.isEmpty():
        return rows, whole
    connected = components(split.select(F.col("sid").alias("u"), F.col("label").alias("v")))
    split = split.groupBy("sid").agg(F.sum("links").alias("links")).join(connected.withColumnRenamed("node", "sid"), "sid")
    return rows, whole.unionByName(split.select("sid", "label", "links"))


def link_classes(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, unit: int = UNIT, unit_sets: int = UNIT_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs (doc_id, text; other columns, whatever their names, are ignored).

    component_id is the smallest doc_id reachable by links, a row's own doc_id if there is none. Rows with a null or wordless text link to
    nothing; rows with equal sets, repeated rows among them, link to each other. A null doc_id is never the smallest; a class with no other
    ids has a null one. Texts of any length are read whole. An empty table gives an empty result.
    """
    rows, linked = classes(docs, n, threshold, unit, unit_sets)
    sets = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_copies"))
    sets = cut(sets.join(linked, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    least = cut(sets.groupBy("label").agg(F.min("_first").alias("_least"), F.count("*").alias("_m")).filter("_m > 1").drop("_m"))
    sets = sets.join(_bounded(least), "label", "left").select("sid", F.coalesce("_least", "_first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    empty = F.col("n") == 0
    return rows.join(sets, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, unit: int = UNIT, unit_sets: int = UNIT_SETS) -> DataFrame:
    """The rows of docs, with all their columns (any names beside doc_id and text), of which one of each class stays: one with the smallest
    doc_id, null ids last, then the least set and text hashes; of rows that repeat that doc_id and text one. Rows without words, null and
    empty texts among them, all stay. An empty table gives an empty result."""
    rows, linked = classes(docs, n, threshold, unit, unit_sets)
    key = ["doc_id", "text_hash"]
    keys = rows.filter("n > 0").groupBy("sid", *key).agg(F.count("*").alias("_rows"))
    keys = cut(keys.join(linked.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    first = keys.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sid", "text_hash")).alias("_k"), F.count("*").alias("_m"))
    first = cut(first.filter("_m > 1").drop("_m"))
    is_first = F.col("_k").isNull() | F.col("_k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_k.text_hash") == F.col("text_hash"))
    marked = cut(keys.join(_bounded(first), "label", "left").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), is_first.alias("_first"), "_rows").filter("NOT _first OR _rows > 1"))
    # The rows' own columns travel in a struct, so that no name of theirs meets one of these.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = lambda k: own["doc_id"].eqNullSafe(k["_doc"]) & (own["text_hash"] == k["_hash"])
    out = own.join(_bounded(marked), same(marked), "left_anti").select("_row")
    repeated = marked.filter("_first")
    if not repeated.isEmpty():
        by = Window.partitionBy(*key).orderBy(F.xxhash64("_row"))
        out = out.unionByName(own.join(_bounded(repeated), same(repeated), "left_semi").withColumn("_at", F.row_number().over(by)).filter("_at = 1").select("_row"))
    return out.select("_row.*")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i : i + {N} - 1], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o WHERE 100 * i >= {THRESHOLD} * (nx + ny - i)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, cast(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = doc_id), doc_id)) AS component_id,
  cast(coalesce((SELECT count(*) FROM l WHERE l.x = doc_id), 0) AS BIGINT) AS n_links
FROM s
"""
