"""The pipeline, stage by stage, against brute force on a small fixture."""

import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from reelwright.llm.common import quoted
from test_operators import prose
from tests_llm_shared import brute_classes, brute_hits, documents_rows


def test_stages(spark, tmp_path):
    rows, labels, items = documents_rows()
    rows += [(None, None, None, None, None), (9000, "", "en", "s1", 0), (9001, "  ", None, None, 2), (None, prose(random.Random(1), 40, 3000), None, "s2", 31), (9002, prose(random.Random(2), 6000, 3000), "en", "s0", 30000)]
    labels.append((9002, 1, 0))
    rows = [(*r, "own slot", "x", "dotted") for r in rows]  # columns that the last stage has, too
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, _row string, `a.b c` string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    toxic = {i for i, _, t in labels if t}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = docs.collect(), out.collect()
        seen[name] = after
        if name != "sharding":
            assert out.columns == columns
        if name == "toxicity":
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if r["doc_id"] not in toxic)
        if name == "near_duplicates":
            some = [(r["doc_id"], r["text"]) for r in before]
            firsts = {c for i, n, c, _ in brute_classes(some) if n and i == c}
            wordless = [i for i, t in some if not (t or "").split()]
            assert Counter(r["doc_id"] for r in after) == Counter([*firsts, *wordless])
        if name == "decontamination":
            dirty = {x[0] for x in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if x[-1]}
            assert dirty and Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if r["doc_id"] not in dirty)
        if name == "mixing":
            n = Counter(r["doc_id"] for r in after)
            assert set(n) <= {r["doc_id"] for r in before} and max(n.values()) <= 3 and not set(n) & {9000, 9001}
        if name == "sharding":
            assert Counter((r["text"], r["slot_in"]) for r in after) == Counter((r["text"], r["slot"]) for r in before)
            placed = [(r["doc_id"], r["text"]) for r in docs.select("*", *(c.alias(n) for c, n in zip(corpus_pipeline.written_order(docs), ("f", "k"), strict=True))).orderBy("f", "k").collect()]
            for s in {r["shard"] for r in after}:  # a shard keeps the order of the training positions
                own = [(r["doc_id"], r["text"]) for r in sorted(after, key=lambda r: r["slot"]) if r["shard"] == s]
                left = iter(placed)
                assert all(x in left for x in own)
            for s in {r["shard"] for r in after}:
                assert sorted(r["slot"] for r in after if r["shard"] == s) == list(range(sum(r["shard"] == s for r in after)))
        docs = out
    ran = corpus_pipeline.run(spark, sf)
    assert Counter((r["doc_id"], r["shard"]) for r in ran.collect()) == Counter((r["doc_id"], r["shard"]) for r in seen["sharding"])


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_written_order_over_several_files(spark, tmp_path):
    rows = spark.range(1000, numPartitions=3).withColumn("doc_id", 1000 - quoted("id")).orderBy("doc_id")
    rows.write.option("maxRecordsPerFile", 70).parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    file, row = corpus_pipeline.written_order(docs)
    assert len(docs.inputFiles()) > 12
    assert [r["doc_id"] for r in docs.orderBy(file, row).collect()] == list(range(1, 1001))


def test_near_copies_share_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]
    rows = [(1, words), (2, [*words, *(f"x{i}" for i in range(20))]), (3, [*words, *(f"y{i}" for i in range(30))])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and sum(n.startswith("op") for n in __spark_entry__.queries()) == 13


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op2_skipjoin", "op4_sharding", "op5_decontam", "op8_warc", "op10_mixing"])
def test_oracles(spark, name):
    import duckdb

    from reelwright.llm import queries

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in res.fetchall())
