"""Source divergence audit: how far each source's words are from each other source's of its language, and which words set a source apart.

A language keeps the terms that stand in enough of its documents. Each of its groups (sources) has a smoothed share of every kept term, so
the divergence of two groups is a sum over all kept terms, most of which most groups lack. At first all groups count as lacking all terms (a
product); two partial sums then say what the terms that are there change, both exact. Terms that many groups have fill dense numpy tiles
(terms x groups), in which all pairs of groups are compared at once. Rare terms have sparse postings: each posting against the groups that
lack the term, and each pair of postings of one term. A tile is a chunk of terms and two blocks of groups, so no task holds a group or a term
as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import cut

#: Documents of its language that a term must stand in; ranks of terms that are told.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Shares are whole numbers of this, which is PARTS[0] * PARTS[1]; each factor times 2.9e14 fits 64 bits, so counts below that are exact.
SCALE, PARTS = 1_000_000_000, (32_000, 31_250)
#: A term is heavy if one in so many groups of its language has it.
HEAVY = 4
#: Groups in a block, counted rows in a tile (about), elements of an array at a time.
BLOCK, TILE_ROWS, CELLS = 512, 20_000, 1 << 21
#: Distinct (group, term) that a task holds before it passes them on, and groups' rows that may be broadcast, as counted.
HELD, MOST_BROADCAST = 200_000, 100_000

#: Bytes of UTF-8 text as they count: A-Z lower-cased, other ASCII but letters a space. Bytes of longer code points stay.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed over what a task held; a key may come from many tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_of) in held.items():
                terms = list(n)
                for lo in range(0, len(terms), 50_000):
                    part = terms[lo : lo + 50_000]
                    size = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs_of[t] for t in part], pa.int64())],
                        ["lang", "source", "term", "n", "docs"])
            held.clear()

        total = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch.column("text")), strict=True):
                n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                total -= len(n)
                words = text.as_py().translate(_BYTES).split()
                n.update(words)
                docs_of.update(set(words))
                total += len(n)
                if total > HELD:
                    yield from out()
                    total = 0
        yield from out()

    return _named(docs).select("lang", "source", "text").mapInArrow(rows, "lang string, source string, term string, n long, docs long")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(parts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, total (of the language), groups (that have the term), first (true in one row of a term): of kept terms."""
    sums = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "groups": F.count("*").over(term), "first": F.col("source") == F.min("source").over(term)})
    return sums.filter(F.col("_docs") >= least).select("lang", "source", "term", "n", "total", "groups", "first")


def group_facts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source) that occurs: g (its number in the language), size (groups of the language), v (its kept terms), d and
    lang_d (what shares are parts of: counted words and two for each kept term)."""
    n = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    lang = Window.partitionBy("lang")
    groups = _named(docs).select("lang", "source").distinct().join(n, ["lang", "source"], "left").withColumn("_n", F.coalesce(F.col("_n"), F.lit(0)))
    groups = groups.withColumns({"g": F.row_number().over(lang.orderBy("source")) - 1, "size": F.count("*").over(lang), "_lang_n": F.sum("_n").over(lang)})
    terms = kept.filter("first").groupBy("lang").agg(F.count("*").alias("v"))
    out = groups.join(terms, "lang", "left").withColumn("v", F.coalesce(F.col("v"), F.lit(0)))
    return out.select("lang", "source", "g", "size", "v", (F.col("_n") + 2 * F.col("v")).alias("d"), (F.col("_lang_n") + 2 * F.col("v")).alias("lang_d"))


def share(n: Column, d: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / d), exact in two divisions of whole numbers."""
    big = (n + 2) * PARTS[0]
    return 1 + _div(big, d) * PARTS[1] + _div(F.pmod(big, d) * PARTS[1], d)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def shares(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    whole, rest = np.divmod((n + 2) * PARTS[0], d)
    return 1 + whole * PARTS[1] + rest * PARTS[1] // d


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)): at most about SCALE, as is the sum over all terms; squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


def tile(da: np.ndarray, db: np.ndarray, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """What a chunk's terms change in the divergence of each pair of groups (of d da and db), as if all lacked all of them. a, b: (group's place, term's number, n, heavy) of each counted row of either block."""
    total = np.zeros((len(da), len(db)), np.int64)
    _dense(total, da, db, [x[a[3]] for x in a[:3]], [x[b[3]] for x in b[:3]])
    _sparse(total, da, db, [x[~a[3]] for x in a[:3]], [x[~b[3]] for x in b[:3]])
    return total


def _dense(total: np.ndarray, da: np.ndarray, db: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> None:
    terms = np.union1d(a[1], b[1])
    lacking = apart(shares(np.zeros_like(da), da)[:, None], shares(np.zeros_like(db), db))
    total -= len(terms) * lacking
    step = max(1, CELLS // max(len(da), len(db), 1))
    for lo in range(0, len(terms), step):
        part = terms[lo : lo + step]
        p, q = (_filled(part, x, d) for x, d in ((a, da), (b, db)))
        for k in range(len(da)):
            total[k] += apart(p[:, k : k + 1], q).sum(0)


def _filled(terms: np.ndarray, rows: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(terms), len(d)), np.int64)
    at = np.searchsorted(terms, rows[1])
    at[at == len(terms)] = 0
    mine = terms[at] == rows[1]
    counts[at[mine], rows[0][mine]] = rows[2][mine]
    return shares(counts, d)


def _sparse(total: np.ndarray, da: np.ndarray, db: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> None:
    a0, b0 = shares(np.zeros_like(da), da), shares(np.zeros_like(db), db)
    for rows, d, own, other, sums in ((a, da, a0, b0, total), (b, db, b0, a0, total.T)):
        # A posting against a group that lacks the term: once for each count that a group has, as often as it has it.
        seen, times = np.unique(np.stack([rows[0], rows[2]]), axis=1, return_counts=True)
        step = max(1, CELLS // max(len(other), 1))
        for lo in range(0, seen.shape[1], step):
            at, n = seen[:, lo : lo + step]
            gain = apart(shares(n, d[at])[:, None], other) - apart(own[at][:, None], other)
            np.add.at(sums, at, gain * times[lo : lo + step, None])
    # Pairs of postings of one term: what both have, less what either correction above has counted.
    order = np.argsort(b[1], kind="stable")
    left, right = (np.searchsorted(b[1][order], a[1], side) for side in ("left", "right"))
    pa_, pb_ = shares(a[2], da[a[0]]), shares(b[2], db[b[0]])
    ends = np.cumsum(right - left)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        per = (right - left)[lo:hi]
        x = np.repeat(np.arange(lo, hi), per)
        y = order[np.repeat(left[lo:hi] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
        ga, gb = a[0][x], b[0][y]
        np.add.at(total, (ga, gb), apart(pa_[x], pb_[y]) - apart(pa_[x], b0[gb]) - apart(a0[ga], pb_[y]) + apart(a0[ga], b0[gb]))
        lo = hi


def pair_parts(kept: DataFrame, facts: DataFrame, few: bool, heavy: int = HEAVY, block: int = BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """lang, a, b, value: parts whose sums are the divergence of each two sources of a language, every pair once or more."""
    chunks = max(1, -(-kept.count() // tile_rows))
    blocks = F.floor((F.col("size") - 1) / F.lit(block))
    own = F.floor(F.col("g") / F.lit(block))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    tiled = lambda df: df.withColumn("_ij", F.explode(meets)).select("lang", F.col("_ij.i").alias("i"), F.col("_ij.j").alias("j"), "chunk", own.alias("block"), "g", "d", "source", "v", "term", "n", "heavy")
    rows = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).join(F.broadcast(facts) if few else facts, ["lang", "source"])
    rows = rows.withColumns({"heavy": F.col("groups") * heavy >= F.col("size"), "source": F.lit(None).cast("string")})
    groups = facts.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "heavy": F.lit(False)})
    schema = "lang string, a string, b string, value long"

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lang, i, j, chunk = (k.as_py() for k in key)
        t = t.combine_chunks()
        names = t.column("source")
        block_of, g, d, n = (t.column(c).to_numpy().astype(np.int64) for c in ("block", "g", "d", "n"))
        fact = names.is_valid().to_numpy()
        has = t.column("heavy").to_numpy(zero_copy_only=False).astype(bool)
        code = t.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
        sides = []
        for of in (i, j):
            mine = np.flatnonzero(fact & (block_of == of))
            mine = mine[np.argsort(g[mine])]
            rows_of = np.flatnonzero(~fact & (block_of == of))
            sides.append((mine, d[mine], (np.searchsorted(g[mine], g[rows_of]), code[rows_of], n[rows_of], has[rows_of])))
        (at_a, da, a), (at_b, db, b) = sides
        if da.all():
            total = tile(da, db, a, b)
            if chunk == 0:  # as if all lacked all terms
                v = int(t.column("v")[int(at_a[0])].as_py())
                total += v * apart(shares(np.zeros_like(da), da)[:, None], shares(np.zeros_like(db), db))
        else:  # no kept term
            total = np.zeros((len(da), len(db)), np.int64)
        x, y = np.nonzero(np.triu(np.ones(total.shape, bool), 1) if i == j else np.ones(total.shape, bool))
        return pa.table([pa.array([lang] * len(x), pa.string()), names.take(pa.array(at_a[x])), names.take(pa.array(at_b[y])), pa.array(total[x, y])], ["lang", "a", "b", "value"])

    return tiled(rows).unionByName(tiled(groups)).groupBy("lang", "i", "j", "chunk").applyInArrow(one, schema)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, heavy: int = HEAVY, block: int = BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language and its divergence. Part `term`: at most `top`
    kept terms that the source has more of than its language, by their share of the divergence between the two.

    docs: lang, source, text; other columns are ignored, whatever their names. Null lang, source and text count as empty; every group that
    occurs is told, even without terms (all its pairs then have the value of their smoothed shares, 0 where the language keeps no term).
    Repeated rows are documents of their own. Equal values rank by item, as UTF-8. A long text costs a task its own distinct words. An empty
    table gives an empty result.
    """
    kept = cut(kept_terms(counted(docs), least))
    facts = cut(group_facts(docs, kept))
    few = facts.count() <= MOST_BROADCAST
    sums = pair_parts(kept, facts, few, heavy, block, tile_rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", F.explode(both).alias("_p"), "value").select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")
    rows = kept.join(F.broadcast(facts) if few else facts, ["lang", "source"])
    rows = rows.withColumns({"_p": share(F.col("n"), F.col("d")), "_q": share(F.col("total"), F.col("lang_d"))}).filter(F.col("_p") > F.col("_q"))
    gap = F.col("_p") - F.col("_q")
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _div(gap * gap, F.col("_p") + F.col("_q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
per_doc AS (SELECT r, lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM per_doc GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
cnt AS (SELECT lang, source, term, sum(n) AS n, any_value(total) AS total FROM per_doc JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM docs),
vs AS (SELECT lang, count(*) AS v, sum(total) AS ln FROM kept GROUP BY lang),
ds AS (
  SELECT g.lang, g.source, (coalesce(n, 0) + 2 * v)::HUGEINT AS d, (ln + 2 * v)::HUGEINT AS ld
  FROM grp g JOIN vs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT ds.lang, ds.source, kept.term, 1 + ({SCALE} * (coalesce(cnt.n, 0) + 2))::HUGEINT // d AS p,
    1 + ({SCALE} * (kept.total + 2))::HUGEINT // ld AS q, coalesce(cnt.n, 0) AS n
  FROM ds JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = ds.lang AND cnt.source = ds.source AND cnt.term = kept.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM out
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
