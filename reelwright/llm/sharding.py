"""Sharding by weighted rendezvous hashing.

Each shard draws an exponential variate from the MD5 of (record key, shard), divided by its weight; the record goes to the smallest.
A record's shard depends on its key and the shards alone, so adding a shard moves rows only into the new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import hash48

SHARDS = 24
COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Sub-buckets of a shard for numbering its rows, and rows of their counts that may be broadcast, as counted; more are joined by a shuffle.
SLOT_BUCKETS, MOST_BROADCAST = 4096, 200_000


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    h = hash48(F.concat(key, F.lit("/"), shard.cast("string")))
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 48))) / weight


def assign(df: DataFrame, key: Column, weights: Sequence[float], out: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds `out` (0 .. len(weights)-1) and `grown`, the shard if one more of weight 1 is there. A null key counts as the text "null"."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    best = F.array_min(F.transform(shards, lambda s: F.struct(_draw(key, s["i"], s["w"]).alias("d"), s["i"].alias("i"))))
    n = len(weights)
    df = df.withColumn("_best", best)
    added = _draw(key, F.lit(n), F.lit(1.0)) < F.col("_best.d")
    return df.withColumns({out: F.col("_best.i").cast("int"), grown: F.when(added, n).otherwise(F.col("_best.i")).cast("int")}).drop("_best")


def _sub(key: Column, buckets: int) -> Column:
    return hash48(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("#"))) % buckets


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, slot_buckets: int = SLOT_BUCKETS, whole: bool = False, order: tuple[Column, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text, any more columns); whole: all its
    columns instead of the first, and then the others; a column of docs that has one of their names gets "_in" after it.

    Slots are numbered gaplessly in each shard, by sub-bucket, doc_id, checksum and size: no task holds a whole shard. order: (a whole
    number, anything that orders) in whose order a shard's slots rise instead, the number cutting it into sub-buckets. A null text
    counts as empty (crc32 0, size 8); rows with a null doc_id share the key "null"; equal rows get neighbouring slots; an empty
    table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns} | set(COLUMNS)
    names = {}
    for c in docs.columns:
        new = c
        while new.lower() in COLUMNS or new != c and new.lower() in taken:
            new += "_in"
        names[c] = new
        taken.add(new.lower())
    sub = _sub(F.col("doc_id"), slot_buckets) if order is None else order[0].cast("long")
    row = [F.struct(*[F.col(f"`{c}`").alias(new) for c, new in names.items()]).alias("_row")] if whole else []
    keyed = assign(docs.select("doc_id", "text", sub.alias("_sub"), *([order[1].alias("_order")] if order else []), *row), F.col("doc_id"), weights)
    # The counts need no text, so this second scan reads few columns.
    counts = keyed.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    few = (order is None and len(weights) * slot_buckets <= MOST_BROADCAST) or counts.count() <= MOST_BROADCAST
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "grown_shard", "_sub", *(["_order"] if order else []), *(["_row"] if whole else []))
    by = Window.partitionBy("shard", "_sub").orderBy(*(["_order"] if order else []), F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    rows = rows.withColumn("_at", F.row_number().over(by).cast("long") - 1)
    slot = F.col("_start") + F.col("_at")
    return rows.join(F.broadcast(starts) if few else starts, ["shard", "_sub"]).select(
        *(["_row.*"] if whole else ["doc_id"]), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")


SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (
  SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
base AS (
  SELECT rid, doc_id, coalesce(cast(doc_id AS VARCHAR), 'null') AS key, cast(length(h) // 2 + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, t[cast(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
draws AS (
  SELECT rid, i AS shard,
    -ln((cast('0x' || substr(md5(key || '/' || i), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) AS d
  FROM base, range({SHARDS + 1}) AS r(i)),
best AS (
  SELECT rid, arg_min(shard, d) FILTER (shard < {SHARDS}) AS shard, arg_min(shard, d) AS grown_shard FROM draws GROUP BY rid)
SELECT doc_id, size, cast(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, cast(shard AS INTEGER) AS shard,
  cast(row_number() OVER (PARTITION BY shard
    ORDER BY cast('0x' || substr(md5(key || '#'), 1, 12) AS BIGINT) % {SLOT_BUCKETS}, doc_id NULLS LAST, text_crc32, size) - 1 AS BIGINT) AS slot,
  cast(grown_shard AS INTEGER) AS grown_shard
FROM base JOIN best USING (rid)
"""
