"""Operators 11 to 13 against brute force and their SQL, on small tables with hard rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_operators import DOCS, documents, hard_rows, prose

from reelwright.llm import divergence, quality, quantiles

DATA = Path("/root/testdata/sf0.001")


def twin(spark, query, sql, names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    got = query(*(spark.read.parquet(f"{DATA}/{n}.parquet") for n in names))
    res = con.execute(sql)
    assert [d[0] for d in res.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(res.fetchall(), key=repr)


# 11. divergence


def brute_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        words = [w.translate(lower) for w in term.findall(text or "")]
        key = (lang or "", source or "")
        groups[key[0]].add(key[1])
        counts[key].update(words)
        docs[key[0]].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def share(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        far = lambda p, q: (p - q) ** 2 // (p + q)
        q = share(total)
        for s in sources:
            p = share(counts[lang, s])
            pairs = [(o, sum(far(p[t], x) for t, x in share(counts[lang, o]).items())) for o in sources if o != s]
            terms = [(t, far(p[t], q[t])) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("heavy", "block", "tile_rows"), [(4, 512, 20_000), (2, 2, 7), (1, 3, 50), (10**6, 4, 30)])
def test_divergence(spark, heavy, block, tile_rows):
    """All terms in tiles, all in postings, and both; groups in one block and in several."""
    r = random.Random(30)
    rows = hard_rows(31) + [(500 + i, " ".join(f"{'Ärger' if r.random() < 0.2 else 'W'}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(1 + i % 9))}" for _ in range(r.randrange(1, 40))), r.choice(["en", "fr", None]), f"s{r.randrange(9)}") for i in range(150)]
    rows = [(*x, *([None] * (4 - len(x)))) for x in rows] + [(900, "only one here", "xx", "a"), (901, None, "xx", "b"), (902, "", "en", "empty")]
    got = divergence.audit(documents(spark, rows), least=3, top=4, heavy=heavy, block=block, tile_rows=tile_rows)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 3, 4)


def test_divergence_sums_are_exact():
    r = np.random.default_rng(3)
    d = r.integers(10**6, 10**14, 5)
    n = r.integers(0, 10**13, (4, 5))
    assert (divergence.shares(n, d) == [[1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(row, d, strict=True)] for row in n]).all()


def test_divergence_of_nothing(spark):
    assert divergence.audit(documents(spark, []).filter("false")).count() == 0


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
def test_divergence_twin(spark):
    twin(spark, divergence.audit, divergence.SQL, ["documents"])


# 12. quality


def line_counts(line):
    """By plain Python, as quality.COUNTS names them."""
    words = line.split()
    symbol = lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:?'\"()-"
    letters = [c for c in line if c.isascii() and c.isalpha() or ord(c) >= 128]
    return [len(line), sum(c.isascii() and c.isupper() for c in line), len(letters), sum(c.isascii() and c.isdigit() for c in line), sum(c in ".,;:?'\"()-" for c in line), sum(map(symbol, line)),
            len(words), sum(symbol(w[-1]) for w in words), sum(all(map(symbol, w)) for w in words), sum(a == b for a, b in itertools.pairwise(words)), sum(a == b for a, b in zip(words, words[2:], strict=False))]


def odd_texts():
    r = random.Random(40)
    texts = ["", "\n", "one", "A!! B!! C!!", "a | b | | c\n\na a a b a\na a a b a\n", " \t x\n", "Äé 12, ök. Ä", "x" * 300 + " y", "same same\nsame same", "\n\n\n"]
    return texts + ["\n".join(" ".join(r.choice(["ab", "AB!!", "|", "c.", "é$", "7"]) for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 7))) for _ in range(40)]


@pytest.mark.parametrize("segment", [1 << 20, 16])
def test_lines_are_counted(monkeypatch, segment):
    monkeypatch.setattr(quality, "SEGMENT", segment)
    texts = [t for t in odd_texts() if segment > 100 or "x" * 300 not in t]  # a word longer than a segment counts as two
    got = quality.count_lines([t.encode() for t in texts])
    lines = [x for t in texts for x in t.split("\n")]
    want = np.array([line_counts(x) for x in lines])
    if segment < 100:  # what stands two words back is not carried over
        want[:, -1] = got.counts[:, -1]
    assert (got.counts == want).all()
    assert got.begin.tolist() == np.cumsum([0, *(t.count("\n") + 1 for t in texts)]).tolist()


def test_line_marginals_are_those_of_all_paths():
    r = np.random.default_rng(5)
    begin = np.array([0, 1, 4, 10])
    score, tie = r.normal(size=(10, 2)), r.normal(size=(2, 2))
    node, pairs, total = quality._passes(score, tie, begin)
    for k, (lo, hi) in enumerate(itertools.pairwise(begin)):
        paths = list(itertools.product(range(2), repeat=hi - lo))
        weight = np.array([math.exp(sum(score[lo + t, y] for t, y in enumerate(p)) + sum(tie[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        assert math.isclose(total[k], math.log(weight.sum()))
        for t in range(hi - lo):
            assert math.isclose(node[lo + t, 1], weight[[p[t] == 1 for p in paths]].sum() / weight.sum())
        for i, j in itertools.product(range(2), repeat=2):
            assert math.isclose(pairs[k, i, j], sum(w * sum((a, b) == (i, j) for a, b in itertools.pairwise(p)) for p, w in zip(paths, weight, strict=True)) / weight.sum(), abs_tol=1e-12)


def test_field_gradients_are_right():
    r = np.random.default_rng(6)
    begin, labels, weight = np.array([0, 2, 3, 8]), np.array([1, 0, 1]), np.array([0.2, 0.5, 0.3])
    x = r.normal(size=(8, quality.FEATURES))
    field = quality.Field(r.normal(size=(quality.FEATURES, 2)) * 0.1, r.normal(size=(2, 2)))
    grads, _ = quality.gradients(field, x, begin, labels, weight)
    for which, at in [(0, (0, 0)), (0, (7, 1)), (0, (40, 0)), (1, (0, 0)), (1, (0, 1)), (1, (1, 1))]:
        loss = []
        for step in (1e-5, -1e-5):
            moved = quality.Field(field.emit.copy(), field.tie.copy())
            moved[which][at] += step
            loss.append(quality.gradients(moved, x, begin, labels, weight)[1])
        assert math.isclose((loss[0] - loss[1]) / 2e-5, grads[which][at], rel_tol=1e-4, abs_tol=1e-8)


def labelled(spark):
    r = random.Random(41)
    rows, labels = [], []
    for i in range(240):
        lines = [prose(r, r.randrange(3, 20)).capitalize() + "." for _ in range(r.randrange(1, 8))]
        if i % 4 == 0:
            lines = [x.upper().replace(" ", "!! ") if i % 8 else " ".join(w + "$$$" for w in x.split()) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 4 != 0), 0))
    labels += [(100, None, 1), (None, 1, 0), (3, 1, 0), (9999, 0, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    rows, labels = labelled(spark)
    extra = hard_rows(42)[60:] + [(7000, "\n" * 5000), (7001, "good words here. " * 20_000), (5, rows[5][1])]
    rows = rows + [x for x in extra if x[0] is None or x[0] >= 100]
    docs = documents(spark, rows)
    field = quality.fit(docs, labels)
    got = quality.score(docs, field).collect()
    assert len(got) == len(rows)
    texts = sorted((repr(r[0]), r[1] or "") for r in rows)
    alone = sorted((i, float(field.scores([t.encode()])[0])) for i, t in texts)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-9) for a, b in zip(sorted((repr(r["doc_id"]), r["score"]) for r in got), alone, strict=True))
    unseen = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert len(unseen) > 30 and all((r["score"] >= 0.7) == bool(r["predicted"]) for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in unseen) >= 0.97 * len(unseen)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert (a.emit == b.emit).all() and (a.tie == b.tie).all()


def test_quality_without_labels(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows[:5])
    assert {r["predicted"] for r in quality.score(docs, quality.fit(docs, labels.filter("false"))).collect()} == {1}
    assert quality.score(spark.createDataFrame([], DOCS), quality.fit(docs, labels.filter("quality = 1"))).count() == 0


# 13. quantiles


def brute_counts(xs, v):
    return sum(x < v for x in xs), sum(x <= v for x in xs)


def numbers(seed=50):
    r = random.Random(seed)
    groups = {"tiny": [5], "ties": [3] * 900 + [1, 2, 9, 11, 12, 13], "even": list(range(0, 3000, 3)), "wide": [int(r.lognormvariate(8, 3)) for _ in range(2500)], "few": [r.randrange(30) for _ in range(200)], "below": [-r.randrange(10**6) for _ in range(700)]}
    return groups


@pytest.mark.parametrize("most", [512, 8])
def test_summaries_hold_cut_points_and_counts(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "FEW", most)  # 8: all but the smallest are narrowed by counting passes
    groups = numbers()
    rows = [(g, x, w) for g, xs in groups.items() for x, w in Counter(xs).items()]
    got = {r["g"]: r for r in quantiles.summarise(spark.createDataFrame(rows, "g string, x long, w long"), ["g"]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        ordered = sorted(xs)
        n = len(xs)
        cuts = {ordered[-(-k * n // quantiles.CUTS) - 1] for k in range(1, quantiles.CUTS + 1)} | set(sorted(set(xs))[: quantiles.SMALLEST])
        assert got[g]["n"] == n and [p["x"] for p in got[g]["points"]] == sorted(cuts)
        for p in got[g]["points"]:
            assert (p["below_least"], p["upto_least"]) == (p["below_most"], p["upto_most"]) == brute_counts(xs, p["x"])


def test_merging_bounds_counts(spark):
    r = random.Random(51)
    xs = [int(r.gauss(0, 1) * 10 ** r.randrange(2, 5)) for _ in range(4000)]
    rows = [("a", b, x, w) for b in range(6) for x, w in Counter(xs[b::6]).items()] + [("b", 0, 7, 30), ("b", 1, 7, 5)]
    parts = quantiles.summarise(spark.createDataFrame(rows, "g string, b int, x long, w long"), ["g", "b"])
    for most in (quantiles.MOST_POINTS, 50):
        got = {r["g"]: r for r in quantiles.merge(parts, ["g"], most).collect()}
        points = got["a"]["points"]
        assert got["a"]["n"] == 4000 and 4 <= len(points) <= most and points[0]["x"] == min(xs) and points[-1]["x"] == max(xs)
        for p in points:
            below, upto = brute_counts(xs, p["x"])
            assert p["below_least"] <= below <= p["below_most"] and p["upto_least"] <= upto <= p["upto_most"]
    told = quantiles.answers(quantiles.merge(parts, ["g"]), ["g"]).collect()
    for r in told:
        if r["g"] == "a":
            below, upto = brute_counts(xs, r["answer"])
            assert max(0, below + 1 - r["target"], r["target"] - upto) <= 0.05 * 4000
    assert {r["answer"] for r in told if r["g"] == "b"} == {7} and len(told) == 18


def test_merging_merged_summaries(spark):
    xs = list(range(5000))
    rows = [("a", b // 4, b, x, 1) for b in range(8) for x in xs[b::8]]
    parts = quantiles.summarise(spark.createDataFrame(rows, "g string, h int, b int, x long, w long"), ["g", "h", "b"])
    whole = quantiles.merge(quantiles.merge(parts, ["g", "h"]), ["g"]).first()
    assert whole["n"] == 5000
    for p in whole["points"]:
        assert p["below_least"] <= p["x"] <= p["below_most"] and p["below_most"] - p["below_least"] <= 0.05 * 5000


def test_halving_keeps_targets():
    child, w = np.array([3, 200, 511]), np.array([5, 1, 4])
    got = quantiles.narrowed(child, w, 100, 3, np.array([101, 105, 106, 110]), np.array([200, 400]), [7, 8])
    assert got == [(3, 100, 3, [101, 105], []), (200, 105, 2, [106], [7]), (400, 106, 0, [], [8]), (511, 106, 1, [110], [])]


def test_streams_with_hard_rows(spark, monkeypatch):
    """Nulls in any column, repeated and tied rows, amounts that aren't numbers, clashing columns; counts by brute force."""
    monkeypatch.setattr(quantiles, "FEW", 60)
    r = random.Random(52)
    clicks = [(i, r.choice([1, 1, 1, 2, None]), r.choice([None, float("nan"), float("inf")]) if r.random() < 0.05 else round(r.lognormvariate(2, 2), 2), 3) for i in range(1500)]
    clicks += clicks[:40] + [(None, 1, 2.5, 3)]
    items = [(i, f"b{i % 3}" if i % 7 else None, None if i % 11 == 3 else float(i % 13) + 0.005) for i in range(40)]
    lines = [(r.choice([7, 8, None, r.randrange(45)]), r.choice([1, 2, 3, None])) for _ in range(2000)]
    frames = [spark.createDataFrame(clicks, "click_id long, client_id long, value double, batch int"), spark.createDataFrame(lines, "item_id long, vendor_id long"), spark.createDataFrame(items, "item_id long, brand string, price double")]
    import zlib

    batch = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 8
    x = lambda v, b: math.floor(100 * v + 0.5) + 1000 * b
    groups = defaultdict(list)
    for i, c, v, _ in {row[0]: row for row in clicks}.values():
        if c is not None and v is not None and math.isfinite(v):
            groups["value", str(c), batch(i)].append(x(v, batch(i)))
    of = {i: (b, p) for i, b, p in items}
    for i, v in lines:
        b, p = of.get(i, (None, None))
        if b is not None and p is not None:
            groups["price", b, batch(v)].append(x(p, batch(v)))
    for (s, g, _), xs in list(groups.items()):
        groups[s, g, -1] = groups.get((s, g, -1), []) + xs
    got = quantiles.stream_quantiles(*frames).collect()
    assert len(got) == sum(9 for xs in groups.values() if len(xs) >= 20)
    for row in got:
        xs = sorted(groups[row["stream"], row["grp"], row["batch"]])
        assert row["n"] == len(xs) and row["target"] == -(-row["i"] * len(xs) // 10) and row["exact_x"] == xs[row["target"] - 1]
        assert (row["n_below"], row["n_upto"]) == brute_counts(xs, row["answer"])
        assert row["rank_error"] == max(0, row["n_below"] + 1 - row["target"], row["target"] - row["n_upto"]) and row["within"]
        assert min(4, len(set(xs))) <= row["points"] <= min(len(xs), 400) and xs[0] <= row["answer"] <= xs[-1]


def test_summaries_of_repeated_rows(spark, monkeypatch):
    """An x in many rows counts as one x with their sum, in groups that a task takes whole and in narrowed ones."""
    for most in (512, 8):
        monkeypatch.setattr(quantiles, "FEW", most)
        groups = numbers()
        told = [{(r["g"]): (r["n"], r["points"]) for r in quantiles.summarise(spark.createDataFrame(rows, "g string, x long, w long"), ["g"]).collect()} for rows in ([(g, x, 1) for g, xs in groups.items() for x in xs], [(g, x, w) for g, xs in groups.items() for x, w in Counter(xs).items()])]
        assert told[0] == told[1] and set(told[0]) == set(groups)


def test_answers_tell_exact_counts_or_none(spark):
    """Exact counts come with the answer where the bounds leave no doubt: everywhere in batches and where batches are kept whole."""
    r = random.Random(53)
    groups = {"small": [r.randrange(500) for _ in range(120)], "large": [r.randrange(10**6) for _ in range(3000)], "ties": [7] * 2000 + [9] * 900}
    rows = [(g, b, x, 1) for g, xs in groups.items() for b in range(4) for x in xs[b::4]]
    parts = quantiles.summarise(spark.createDataFrame(rows, "g string, b int, x long, w long"), ["g", "b"])
    sure = Counter()
    for keys, frame in ((["g", "b"], parts), (["g"], quantiles.merge(parts, ["g"]))):
        for t in quantiles.answers(frame, keys).collect():
            xs = sorted(groups[t["g"]][t["b"] :: 4] if "b" in keys else groups[t["g"]])
            below, upto = brute_counts(xs, t["answer"])
            assert t["exact_x"] in (None, xs[t["target"] - 1]) and t["n_below"] in (None, below) and t["n_upto"] in (None, upto)
            sure[len(keys), t["g"]] += None not in (t["exact_x"], t["n_below"], t["n_upto"])
    assert all(sure[2, g] == 36 for g in groups) and sure[1, "small"] == sure[1, "ties"] == 9 and sure[1, "large"] < 9


def test_only_doubtful_groups_are_selected_again(spark, monkeypatch):
    """The pass over all numbers that settles merged answers takes no group whose batches' summaries settle them."""
    import zlib

    r = random.Random(54)
    # Clients 60 to 69 have 450 clicks each, which a task takes whole, and 99 has 1500, which is narrowed; the others' batches keep all.
    clicks = [(i, i % 30 if i < 3000 else 60 + i % 10 if i < 7500 else 99, round(r.lognormvariate(3, 2), 2)) for i in range(9000)]
    frames = [spark.createDataFrame(clicks, "click_id long, client_id long, value double"), spark.createDataFrame([], "item_id long, vendor_id long"), spark.createDataFrame([], "item_id long, brand string, price double")]
    selected, select = [], quantiles.select
    monkeypatch.setattr(quantiles, "select", lambda numbers, keys, *a, **k: selected.append((keys, select(numbers, keys, *a, **k))) or selected[-1][1])
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        got = [t for t in quantiles.stream_quantiles(*frames).collect() if t["batch"] == -1]
        again = [[t["grp"] for t in f.collect()] for keys, f in selected if "batch" not in keys]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    groups = defaultdict(list)
    for i, c, v in clicks:
        groups[str(c)].append(math.floor(100 * v + 0.5) + 1000 * (zlib.crc32(str(i).encode()) % 8))
    assert len(got) == 41 * 9
    for t in got:
        xs = sorted(groups[t["grp"]])
        assert t["exact_x"] == xs[t["target"] - 1] and (t["n_below"], t["n_upto"]) == brute_counts(xs, t["answer"])
    assert len(again) == 1 and sorted(again[0]) == [*map(str, range(60, 70)), "99"]


def test_quantiles_of_nothing(spark):
    frames = [spark.createDataFrame([], "click_id long, client_id long, value double"), spark.createDataFrame([], "item_id long, vendor_id long"), spark.createDataFrame([], "item_id long, brand string, price double")]
    assert quantiles.stream_quantiles(*frames).count() == 0


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
def test_quantiles_twin(spark):
    twin(spark, quantiles.stream_quantiles, quantiles.SQL, ["clicks", "sale_lines", "items"])
