"""Mixing sources to target weights along a time-varying curriculum.

A source's weight over training time t in [0, 1] runs linearly from `first` to `last`; its integral, divided by its value at 1,
is the share of the source's target that training has consumed by t. Inverting it at a document's place in the source's token
stream gives the document's training position, by which the mix is range-sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import cut, hash48, quoted

WEIGHTS = (5, 2, 1)
#: (first, last) of the schedule, for the sources in order, repeating: rich sources fade out, poor ones fade in.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MOST_REPEATS = 3
#: A source's token stream is cut into so many ranges of its documents' hash, which are summed apart.
STREAM_PARTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, _key (the source; null sorts last), _h (place in the source's stream), _part, size, and carried. Null text: size 0."""
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit("")))
    rows = docs.select("doc_id", key.alias("_key"), hash48(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *carried)
    return rows.withColumn("_part", F.floor(F.col("_h") / F.lit((1 << 48) // STREAM_PARTS)))


def targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """_key, source_size, target, _first, _last for each row of per_source (_key, source_size): a row per source, no documents.

    Resharing the excess by weight until no target is above its cap ends where the open sources share by one level per weight what the
    capped ones leave; the capped are those with the smallest caps per weight.
    """
    n = len(weights)
    at = (F.row_number().over(Window.orderBy("_key")) - 1) % n
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("_at") + 1)
    s = per_source.withColumn("_at", at).withColumns({"_w": pick([int(w) for w in weights]), "_cap": most * F.col("source_size")})
    sched = SCHEDULES * -(-n // len(SCHEDULES))
    s = s.withColumns({"_first": pick([a for a, _ in sched[:n]]), "_last": pick([b for _, b in sched[:n]])})
    order, all_rows = Window.orderBy(F.col("_cap") / F.col("_w"), "_key"), Window.partitionBy()
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_total": F.sum("source_size").over(all_rows), "_weights": F.sum("_w").over(all_rows)})
    s = s.withColumns({"_capped": F.coalesce(F.sum("_cap").over(below), F.lit(0)), "_closed": F.coalesce(F.sum("_w").over(below), F.lit(0))})
    level = (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_closed"))
    # Sources in order of cap per weight: the first whose cap is above the level set by those before it is open, as are all after it.
    open_level = F.when(F.col("_cap") / F.col("_w") >= level, level)
    s = s.withColumn("_level", F.first(open_level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))
    return s.select("_key", "source_size", target.alias("target"), F.col("_first").cast("double").alias("_first"), F.col("_last").cast("double").alias("_last"))


def when_consumed(share: Column, first: Column, last: Column) -> Column:
    """The t at which the integral of first + (last - first) t, as a share of the whole, reaches `share`: the quadratic, solved stably."""
    c = share * (first + last) / 2
    root = F.sqrt(F.greatest(first * first + 2 * (last - first) * c, F.lit(0.0)))
    return F.when(share <= 0, F.lit(0.0)).otherwise(F.least(2 * c / (first + root), F.lit(1.0)))


def placed(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """rows (sizes()) with source_size, target, _first, _last, _at (words before it in its source's stream), taken and copies."""
    parts = rows.groupBy("_key", "_part").agg(F.sum("size").alias("_sum"))
    goal = targets(parts.groupBy("_key").agg(F.sum("_sum").alias("source_size")), weights, most)
    stream = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(goal, "_key").withColumn("_before", F.coalesce(F.sum("_sum").over(stream), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_key", "_part").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.sum("size").over(within) - F.col("size")).join(parts, ["_key", "_part"])
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    left = F.round(F.col("target")).cast("long") - F.col("_passes") * F.col("source_size")
    rows = rows.withColumns({"_at": F.col("_before") + F.col("_at"), "_passes": passes.cast("long")})
    taken = F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_at")))
    rows = rows.withColumn("taken", F.least(taken, most * F.col("size")).cast("long"))
    return rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position of every row of docs, range-sorted by position.

    A source's stream repeats its documents in hash order until its target is filled: whole passes, then a last partial one, whose last
    document may be taken in part. `copies` is taken over size, rounded: what a row-wise mix repeats. `position` is the training time of
    the document's first word (null if nothing is taken). A document without words has size and taken 0; repeated rows are documents of
    their own; an empty table gives an empty result.
    """
    rows = placed(cut(sizes(docs)), weights, most)  # one scan of the texts; the rest needs numbers only
    position = F.when(F.col("taken") > 0, when_consumed(F.col("_at") / F.col("target"), F.col("_first"), F.col("_last")))
    out = rows.select("doc_id", "size", "source_size", "target", "taken", "copies", position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, each as often as its `copies` says, range-sorted by each copy's training
    position; equal positions by doc_id. A text without words, or null, is taken no time. Rows that repeat a doc_id are documents of their
    own, taken in one order of hash, doc_id and size; a null source is one, and comes last. An empty table gives an empty one. Texts are
    counted whole."""
    rows = placed(sizes(docs, F.struct(*[quoted(c) for c in docs.columns]).alias("_row")), weights, most).filter("copies > 0")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("_at") + F.col("_pass") * F.col("source_size")) / F.col("target")
    rows = rows.withColumn("_position", when_consumed(share, F.col("_first"), F.col("_last")))
    return rows.orderBy("_position", "doc_id").select("_row.*")


SQL = f"""
WITH base AS (
  SELECT doc_id, (source IS NULL)::INT || coalesce(source, '') AS k, cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT k, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(k)) - 1 AS i FROM base GROUP BY k),
w AS (
  SELECT *, [5, 2, 1][i % 3 + 1] AS w, [1.5, 1.0, 0.5][i % 3 + 1]::DOUBLE AS f, [0.5, 1.0, 1.5][i % 3 + 1]::DOUBLE AS l, {MOST_REPEATS} * source_size AS cap FROM src),
cum AS (
  SELECT *, cap::DOUBLE / w AS r, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS ws,
    coalesce(sum(cap) OVER o, 0)::BIGINT AS capped, coalesce(sum(w) OVER o, 0)::BIGINT AS closed
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT arg_min((total - capped)::DOUBLE / (ws - closed)::DOUBLE, (r, k)) AS level FROM cum WHERE r >= (total - capped)::DOUBLE / (ws - closed)::DOUBLE),
goal AS (SELECT k, source_size, f, l, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM cum, lev),
place AS (
  SELECT *, cast(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos FROM base),
took AS (
  SELECT doc_id, size, source_size, target, pos, f, l,
    cast(least(p * size + greatest(0, least(size, cast(round(target) AS BIGINT) - p * source_size - pos)), {MOST_REPEATS} * size) AS BIGINT) AS taken
  FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE cast(floor(target / source_size) AS BIGINT) END AS p FROM place JOIN goal USING (k))),
inv AS (SELECT *, pos / target AS share, pos / target * (f + l) / 2 AS c FROM took)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN size = 0 THEN 0 ELSE cast(round(taken / size) AS INTEGER) END AS copies,
  CASE WHEN taken > 0 THEN CASE WHEN share <= 0 THEN 0.0::DOUBLE ELSE least(2 * c / (f + sqrt(greatest(f * f + 2 * (l - f) * c, 0.0::DOUBLE))), 1.0::DOUBLE) END END AS position
FROM inv
"""
