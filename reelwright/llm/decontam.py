"""Benchmark decontamination on a distributed positional inverted index.

The index has a posting (document, term, next term, place) for each place of each term that a test item uses with the word after it,
which is a small part of a corpus, while single common words are much of it: it is built for a set of test items, and other items need an
index of theirs (build_index() of single terms makes one for any query of those terms). A test window is looked up from its rarest
postings: their lists, adjusted by the terms' offsets in the item, are intersected to diagonals (document, item, shift), and only for the
few diagonals on which rarest, second and third rarest all stand are the lists of all the item's terms fetched. Unbroken runs of a
window's length or more are exact phrase matches. proximity_matches() gives documents with all terms within a span, in any order.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import cut, lower_ascii, quoted, scratch

WINDOW = 10
#: Rarest postings of a window whose lists are intersected first.
RAREST = 3
#: A side of so many rows at most, as counted, is broadcast; a larger one is shuffled.
MOST_BROADCAST = 500_000
# Fixed value: what separates words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What follows the last word; no word has this character.
END = "#"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def _keys() -> list[Column]:
    """_id, _text: what makes a document, its doc_id and its text's hash. Repeated rows are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _text and text (null: empty)."""
    return docs.select("doc_id", *_keys(), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded(df: DataFrame, n: int) -> DataFrame:
    """df, marked for broadcast if n, its counted rows, allows it."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def item_terms(items: DataFrame) -> DataFrame:
    """_item, _row, _n (words), _k (place), term, next (the word after it, END after the last) for each word of items (item_id, text); a null
    id is named "null"."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("_item"), words(F.coalesce(F.col("text"), F.lit(""))).alias("_w")).distinct()
    rows = rows.withColumn("_row", F.xxhash64("_w"))
    pair = F.posexplode(_pairs("_w")).alias("_k", "_p")
    return rows.select("_item", "_row", F.size("_w").alias("_n"), pair).select("_item", "_row", "_n", "_k", "_p.term", "_p.next").filter(f"term <> '{END}'")


def _pairs(w: str) -> Column:
    """Each word with the next one; after the last word, END with END, whose place is the number of words."""
    end = F.lit(END)
    return F.arrays_zip(F.concat(F.col(w), F.array(end)).alias("term"), F.concat(F.slice(F.col(w), 2, F.greatest(F.size(w) - 1, F.lit(0))), F.array(end, end)).alias("next"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """_id, _text, term, next, pos: a posting for each place in docs of one of terms (term, and next if the word after it must fit as well),
    and one of END at each document's end, as a table in the shared folder."""
    on = [c for c in ("term", "next") if c in terms.columns]
    spark = docs.sparkSession
    vocabulary = terms.select(*on).union(spark.range(1).select(*[F.lit(END).alias(c) for c in on])).distinct()
    vocabulary = cut(vocabulary)
    tokens = keyed(docs).select("_id", "_text", words(F.col("text")).alias("_w")).select("_id", "_text", F.posexplode(_pairs("_w")).alias("pos", "_p")).select("_id", "_text", "pos", "_p.term", "_p.next")
    path = scratch(spark, "postings")
    tokens.join(bounded(vocabulary, vocabulary.count()), on).select("_id", "_text", "term", "next", "pos").write.parquet(path)
    return spark.read.schema("_id long, _text long, term string, next string, pos int").parquet(path)


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _text, _item, pos: each document word that stands in an occurrence of a window of two words or more of an item.

    items: item_terms(); index: of their terms with the words after them. A window of n words is a run of n - 1 such postings.
    """
    of_item = ["_item", "_row"]
    items = cut(items.filter("_k < _n - 1"))
    df = index.groupBy("term", "next").agg(F.count("*").alias("_df"))
    known = items.join(df, ["term", "next"], "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    # A window that begins at _s has the postings _s .. _s + length - 1 of its item.
    length = F.least(F.col("_n"), F.lit(window)) - 1
    starts = F.sequence(F.greatest(F.lit(0), F.col("_k") - length + 1), F.least(F.col("_k"), F.col("_n") - 1 - length))
    slots = known.select(*of_item, "_n", "_k", "term", "next", "_df", F.explode(starts).alias("_s"))
    by_window = Window.partitionBy(*of_item, "_s")
    slots = slots.withColumns({"_rank": F.row_number().over(by_window.orderBy("_df", "_k")), "_least": F.min("_df").over(by_window)})
    rare = slots.filter((F.col("_rank") <= RAREST) & (F.col("_least") > 0)).groupBy(*of_item, "_k", "_n", "term", "next").agg(F.bit_or(F.expr("shiftleft(1, _rank - 1)")).alias("_ranks"))
    rare = cut(rare)
    shift = (F.col("pos") - F.col("_k")).alias("_shift")
    found = index.join(bounded(rare, rare.count()), ["term", "next"]).select("_id", "_text", *of_item, "_n", shift, "_ranks")
    needed = F.expr(f"shiftleft(1, least(_n - 1, {window - 1}, {RAREST})) - 1")
    found = found.groupBy("_id", "_text", *of_item, "_n", "_shift").agg(F.bit_or("_ranks").alias("_ranks")).filter(F.col("_ranks").bitwiseAND(needed) == needed)
    found = cut(found.drop("_ranks"))
    hit_docs = cut(found.select("_id", "_text").distinct())
    lists = index.join(bounded(hit_docs, hit_docs.count()), ["_id", "_text"], "left_semi")
    wanted = found.join(bounded(items.drop("_n"), items.count()), of_item).withColumn("pos", F.col("_shift") + F.col("_k"))
    cells = lists.join(wanted, ["_id", "_text", "term", "next", "pos"]).select("_id", "_text", *of_item, "_n", "_shift", "_k", "pos").distinct()
    line = Window.partitionBy("_id", "_text", *of_item, "_shift")
    cells = cells.withColumn("_run", F.col("_k") - F.row_number().over(line.orderBy("_k")))
    cells = cells.withColumn("_long", F.count("*").over(Window.partitionBy("_id", "_text", *of_item, "_shift", "_run")))
    # A posting stands for its word and the next one.
    return cells.filter(F.col("_long") >= length).select("_id", "_text", "_item", F.explode(F.array("pos", F.col("pos") + 1)).alias("pos"))


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """query, _id, _text, pos: places of a query's rarest term around which, within `span` words on either side, all its other terms stand.

    queries (query, terms array). Lists are intersected from the rarest on, by blocks of `span` places, so each join is an equi-join.
    """
    terms = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    sized = terms.join(index.groupBy("term").agg(F.count("*").alias("_df")), "term", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    of_query = Window.partitionBy("query")
    sized = cut(sized.withColumns({"_rank": F.row_number().over(of_query.orderBy("_df", "term")), "_least": F.min("_df").over(of_query), "_all": F.count("*").over(of_query)}).filter("_least > 0"))
    at = index.join(sized.filter("_rank = 1").select("query", "term", "_all"), "term").select("query", "_all", "_id", "_text", F.col("pos").alias("_at"))
    near = at.select("*", F.explode(F.array(*[F.floor(F.col("_at") / span) + d for d in (-1, 0, 1)])).alias("_block"))
    others = index.join(sized.filter("_rank > 1").select("query", "term", "_rank"), "term").withColumn("_block", F.floor(F.col("pos") / span))
    both = near.join(others, ["query", "_id", "_text", "_block"], "left").filter(F.col("pos").isNull() | (F.abs(F.col("pos") - F.col("_at")) <= span))
    full = both.groupBy("query", "_all", "_id", "_text", "_at").agg(F.count_distinct("_rank").alias("_seen")).filter("_seen = _all - 1")
    return full.select("query", "_id", "_text", F.col("_at").alias("pos"))


def _gathered(places: DataFrame) -> DataFrame:
    """_id, _text, _item, _row of places (and term, pos, _need, _span) where some stretch of _span words holds _need different terms."""
    of_item = ["_id", "_text", "_item", "_row"]
    # Places in units of the span, so that the frame is one unit for every item; a distance of span - 1 is inside, one of span is not.
    ahead = Window.partitionBy(*of_item).orderBy(F.col("pos") / (F.col("_span") - F.lit(0.5))).rangeBetween(Window.currentRow, 1)
    return places.withColumn("_there", F.size(F.collect_set("term").over(ahead))).filter(F.col("_there") == F.col("_need")).select(*of_item).distinct()


def near_items(docs: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """_id, _text, n_near: how many items have all their words, in any order, within some stretch of the document that is at most twice as
    long as the item (documents with none are left out).

    items: item_terms(); index: any postings of docs, by which terms are called rare. Lists of each item's rarest terms are brought together
    first; only documents where these stand close are read for the other terms.
    """
    of_item = ["_item", "_row"]
    terms = items.groupBy(*of_item, "term").agg((2 * F.max("_n")).alias("_span"))
    rarity = terms.join(index.groupBy("term").agg(F.count("*").alias("_df")), "term", "left").withColumn("_rank", F.row_number().over(Window.partitionBy(*of_item).orderBy(F.coalesce("_df", F.lit(0)), "term")))
    ranked = cut(rarity.withColumn("_all", F.count("*").over(Window.partitionBy(*of_item))))
    seeds = ranked.filter(F.col("_rank") <= RAREST).withColumn("_need", F.least(F.col("_all"), F.lit(RAREST))).select(*of_item, "term", "_span", "_need")
    close = cut(_gathered(build_index(docs, seeds).join(bounded(seeds, seeds.count()), "term")))
    read = cut(close.select("_id", "_text").distinct())
    some = docs.select("doc_id", "text", *_keys()).join(bounded(read, read.count()), ["_id", "_text"], "left_semi").select("doc_id", "text")
    all_terms = ranked.select(*of_item, "term", "_span", F.col("_all").alias("_need"))
    places = build_index(some, all_terms).join(close, ["_id", "_text"]).join(bounded(all_terms, all_terms.count()), [*of_item, "term"])
    return _gathered(places).groupBy("_id", "_text").agg(F.count_distinct("_item").alias("n_near"))


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(_id, _text, n_words of every document), (_id, _text, n_hit, n_items, items_sha256 of those with a hit), item_terms() and index."""
    items = cut(item_terms(benchmark))
    index = build_index(docs, items.filter("_n > 1").select("term", "next"))
    found = phrase_matches(index.filter(f"term <> '{END}'"), items, window)
    single = items.filter("_n = 1").select("_item", "term")
    if not single.isEmpty():
        words_alone = build_index(docs, single.select("term"))
        found = found.unionByName(words_alone.join(bounded(single, single.count()), "term").select("_id", "_text", "_item", "pos"))
    hit = found.groupBy("_id", "_text").agg(F.count_distinct("pos").alias("n_hit"), F.collect_set("_item").alias("_items")).select(
        "_id", "_text", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"))
    return index.filter(f"term = '{END}'").groupBy("_id", "_text").agg(F.max("pos").cast("long").alias("n_words")), hit, items, index


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _text, n_hit, n_items, items_sha256 of the documents with a hit."""
    return _scanned(docs, benchmark, window)[1]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items all of whose words stand close together, see near_items())
    of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words and no hits; a null or wordless item has no window; an item repeated under one id counts once, a null
    id is named "null". Repeated rows have equal results. Empty tables: no rows, or no hits.
    """
    lengths, found, items, index = _scanned(docs, benchmark, window)
    near = near_items(docs, items, index.filter(f"term <> '{END}'"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = docs.select("doc_id", *_keys()).join(lengths, ["_id", "_text"], "left").join(found, ["_id", "_text"], "left").join(near, ["_id", "_text"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, in which no window of benchmark occurs. Null and empty texts stay, as do
    all rows of an empty benchmark; repeated rows share their fate."""
    found = cut(hits(docs, benchmark, window).select("_id", "_text"))
    rows = docs.select(*_keys(), F.struct(*[quoted(c) for c in docs.columns]).alias("_row"))
    return rows.join(bounded(found, found.count()), ["_id", "_text"], "left_anti").select("_row.*")


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_LOW}, '{_W}') AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, '{_W}') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS phrase FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
m AS (SELECT dp.rid, dp.n, dp.p, bw.item FROM dp JOIN bw ON bw.n = dp.n AND bw.phrase = array_to_string(dp.w[dp.p : dp.p + dp.n - 1], ' ')),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM m) GROUP BY rid),
it AS (SELECT DISTINCT item, w, len(w) AS n, list_distinct(w) AS ds FROM b WHERE len(w) > 0),
pl AS (SELECT rid, item, it.w AS iw, 2 * n AS span, len(ds) AS need, t.term, t.pos FROM d JOIN it ON list_has_all(d.w, it.ds),
  LATERAL (SELECT unnest(d.w) AS term, unnest(range(len(d.w))) AS pos) t WHERE list_contains(it.ds, t.term)),
near AS (SELECT rid, count(DISTINCT item) AS n_near FROM (SELECT p.rid, p.item FROM pl p JOIN pl q ON q.rid = p.rid AND q.item = p.item AND q.iw = p.iw AND q.pos BETWEEN p.pos AND p.pos + p.span - 1
  GROUP BY p.rid, p.item, p.iw, p.pos, p.need HAVING count(DISTINCT q.term) = p.need) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY encode(item))) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, cast(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid) LEFT JOIN near USING (rid)
"""
