"""Each operator against brute force on small tables with hard rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reelwright.llm import components, decontam, language, mixing, pii, sharding, shingles, skipjoin, syncmers, toxicity, warc, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id string, size string, _row string, _sid string"
EMPTY = {"documents": DOCS, "pages": "page_id long, url string, html string, _host string, digest string"}


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); more columns have names that operators use."""
    full = [(*r, *([None] * (4 - len(r))), len(r[1] or ""), "x", "y", "z", "r", "s") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def hard_rows(seed=1):
    r = random.Random(seed)
    rows = [(i, prose(r, r.randrange(1, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "Zwei Wörter"), (105, "x" * 3000), (106, prose(r, 4000)), (107, "ÄÖÜ é ñ   \U0001f600 end"), (None, "no id here at all"), (None, "no id here at all"), (None, None)]
    return rows + [rows[3], rows[3], (61, rows[3][1]), (62, rows[4][1].upper()), (63, rows[5][1] + " more")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


# 1. syncmers


def test_syncmers_are_context_free():
    r = random.Random(2)
    middle = "".join(r.choice("abcdefgh ") for _ in range(200))
    a, b = "".join(r.choice("xyz") for _ in range(57)) + middle, middle + "".join(r.choice("uvw") for _ in range(33))
    ha, pa_ = syncmers.anchors(a)
    hb, pb = syncmers.anchors(b)
    ours = {(int(h), int(p) - 57) for h, p in zip(ha, pa_, strict=True) if p >= 57}
    assert ours == {(int(h), int(p)) for h, p in zip(hb, pb, strict=True) if p + syncmers.K <= len(middle)}
    n = len(syncmers.anchors(middle)[0])
    assert 0.1 < n / len(middle) < 0.3  # 2 in 11 of the k-mers


def test_likeness():
    r = random.Random(3)
    a, b = (" ".join(str(r.random()) for _ in range(200)) for _ in range(2))
    s = syncmers.sketch
    assert syncmers.likeness(s(a), s(a)) == 1 and syncmers.likeness(s(""), s("")) == 1 and syncmers.likeness(s("ab"), s("")) == 0
    half = syncmers.likeness(s(a), s(syncmers.edited(a, b)))
    assert 0.15 < half < 0.55 and syncmers.likeness(s(a), s(b)) < 0.05


def test_anchors_are_closed_syncmers():
    """By the definition, k-mer by k-mer: the least hash of its s-mers is that of its first or last one."""
    m32 = 0xFFFFFFFF

    def mix(x):
        x = (x ^ x >> 16) * 0x7FEB352D & m32
        x = (x ^ x >> 15) * 0x846CA68B & m32
        return x ^ x >> 16

    def h(smer):
        c = [ord(x) * 0x9E3779B1 & m32 for x in smer]
        pair = lambda i: c[i] * 0x01000193 + c[i + 1] & m32
        return mix((pair(0) * 0x85EBCA77 + pair(2)) * 0xC2B2AE3D + c[4] & m32)

    r = random.Random(14)
    for n in [15, 16, 20, 24, 25, 60, 300]:
        for _ in range(20):
            text = "".join(r.choice("abcdeé \U0001f600") for _ in range(n))
            want = []
            for p in range(n - syncmers.K + 1):
                inner = [h(text[p + q : p + q + syncmers.S]) for q in range(syncmers.K - syncmers.S + 1)]
                if min(inner) in (inner[0], inner[-1]):
                    want.append(p)
            assert syncmers.anchors(text)[1].tolist() == (want or [0])
            if n >= 2 * syncmers.K - syncmers.S - 1:  # long enough for one at least
                assert want


def test_short_texts_have_anchors():
    r = random.Random(4)
    texts = {"".join(r.choice("abcdefgh .") for _ in range(n)) for n in range(1, 30) for _ in range(40)} | {"Eser thed nt of.", "Is nd of thlying.", "Ered. pathetic loser"}
    prints = [syncmers.sketch(t) for t in sorted(texts)]
    assert all(len(p) for p in prints)
    short = [p for t, p in zip(sorted(texts), prints, strict=True) if 15 <= len(t) <= 23]
    assert sum(syncmers.likeness(a, b) == 1 for i, a in enumerate(short) for b in short[:i]) == 0


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_fingerprints(spark, partitions):
    rows = hard_rows()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = syncmers.fingerprint_documents(documents(spark, rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda x: -x[0])
    ids = Counter(i for i, _ in ordered)
    for r in got:
        if r["doc_id"] is None or ids[r["doc_id"]] > 1:
            continue
        at = next(k for k, (i, _) in enumerate(ordered) if i == r["doc_id"])
        text = ordered[at][1]
        if at + 1 < len(ordered):
            after = ordered[at + 1][1]
            want = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            assert r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert r["edited_fingerprint"] == syncmers.text_of(syncmers.sketch(want))
            assert r["near_next"] == syncmers.likeness(syncmers.sketch(text), syncmers.sketch(after))
        assert r["n_chars"] == len(text) and r["fingerprint"] == syncmers.text_of(syncmers.sketch(text))
    assert syncmers.fingerprint_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("how", [{}, {"range_rows": 3}])
def test_successors(spark, monkeypatch, how):
    import xxhash

    monkeypatch.setattr(syncmers, "HOT", 0.1)
    monkeypatch.setattr(syncmers, "MOST_BOUNDS", 5 if how else 1024)
    r = random.Random(15)
    rows = [(r.choice([None, 7, 7, 8, *range(0, 400, 3), 10**15 + r.randrange(10**9)]), r.choice(["", prose(r, 3), prose(r, 6)])) for _ in range(300)] + [(7, f"text {i}") for i in range(60)] + [(None, f"null {i}") for i in range(60)]
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1]), x[1]))
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = syncmers.with_next(documents(spark, rows), **how)
    assert Counter(map(tuple, got.collect())) == want


def test_last_document_meets_the_first(spark):
    rows = [(1, "a" * 40), (2, "b" * 40), (3, "c" * 40)]
    got = {r["doc_id"]: r["edited_sha256"] for r in syncmers.fingerprint_documents(documents(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {3: sha("c" * 20 + "b" * 20), 2: sha("b" * 20 + "a" * 20), 1: sha("a" * 20 + "c" * 20)}


# 2. Jaccard join


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return Counter((r[0], len(s), min((x for x in least[root(i)] if x is not None), default=None), n) for i, (r, s, n) in enumerate(zip(rows, sets, links, strict=True)))


def near_rows(seed=4):
    """Groups of copies with a few words changed, some just about the threshold; a passage that many share."""
    r = random.Random(seed)
    rows, n = [], 1000
    passage = prose(r, 60)
    for _ in range(6):
        base = prose(r, r.randrange(40, 160), 5000).split()
        for _ in range(r.randrange(2, 30)):
            words = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 22))):
                words[r.randrange(len(words))] = f"n{r.randrange(9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + i, f"{prose(r, r.randrange(5, 40), 5000)} {passage} {prose(r, r.randrange(0, 40), 5000)}") for i in range(40)]
    return rows


@pytest.mark.parametrize("how", [{}, {"unit": 150, "unit_sets": 3}, {"unit": 2000, "unit_sets": 16}])
def test_jaccard_join(spark, how):
    rows = hard_rows() + near_rows()
    got = skipjoin.link_classes(documents(spark, rows), **how)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got.collect()) == brute_classes(rows)


def test_jaccard_join_of_nothing(spark):
    assert skipjoin.link_classes(documents(spark, [])).count() == 0
    assert skipjoin.link_classes(documents(spark, [(1, None), (2, "")])).filter("component_id = doc_id AND n_shingles = 0 AND n_links = 0").count() == 2


def test_linked_sets_share_a_signature():
    import numpy as np

    r = random.Random(15)
    for n in [*range(1, 60), 100, 137, 400, 1500]:
        for _ in range(40):
            a = {r.randrange(1 << 64) for _ in range(n)}
            cut, add = r.randrange(0, n // 7 + 2), r.randrange(0, n // 7 + 2)
            b = set(list(a)[cut:]) | {r.randrange(1 << 64) for _ in range(add)}
            if b and a != b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = (skipjoin.signatures(np.array(sorted(s), np.uint64)) for s in (a, b))
                assert len(np.intersect1d(x, y))
    # Sparse parts: shingles whose hashes crowd into a corner of the range.
    for _ in range(200):
        a = {r.randrange(1 << 57) for _ in range(50)}
        b = set(list(a)[4:]) | {r.randrange(1 << 57) for _ in range(3)}
        if 100 * len(a & b) >= 85 * len(a | b):
            x, y = (skipjoin.signatures(np.array(sorted(s), np.uint64)) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_combined_postings_connect_the_same():
    import numpy as np

    sig, node = np.array([5, 5, 5, 7, 7, 9]), np.array([3, 1, 1, 2, 1, 4])
    s, v = skipjoin.combined(sig, node)
    lists = defaultdict(set)
    for a, b in zip(s.tolist(), v.tolist(), strict=True):
        lists[a].add(b)
    assert lists == {5: {1}, 7: {1}, 9: {4}, 1: {1, 2, 3}}


def test_skipping_gives_all_links(monkeypatch):
    r = random.Random(6)
    base = [r.randrange(10**6) for _ in range(300)]
    sets = []
    for k in range(80):
        s = set(base[k % 3 :: 1])
        for _ in range(r.randrange(0, 40)):
            s.discard(r.choice(base))
            s.add(r.randrange(10**6))
        sets.append(sorted(s))
    import numpy as np

    sets = [np.array(s, np.uint64) for s in sets] + [np.array(sorted({r.randrange(10**6) for _ in range(250)}), np.uint64) for _ in range(20)]
    full = [set(s.tolist()) for s in sets]
    for held in (skipjoin.MOST_HELD, 40):  # and where old answers go
        monkeypatch.setattr(skipjoin, "MOST_HELD", held)
        group = skipjoin.Group(sets)
        for x, own in enumerate(group.order.tolist()):
            want = [y for y in range(len(sets)) if y != own and 100 * len(full[own] & full[y]) >= 85 * len(full[own] | full[y])]
            assert sorted(group.order[group.links(x)].tolist()) == want
        assert group.searched < 60 or held == 40  # most sets took over an answer


@pytest.mark.parametrize("t", [70, 80, 90])
def test_skipping_at_other_thresholds(t):
    import numpy as np

    for seed in range(25):
        r = random.Random(seed)
        bases = [[r.randrange(10**6) for _ in range(r.choice([7, 20, 60, 200]))] for _ in range(r.choice([1, 3]))]
        sets = set()
        for _ in range(r.randrange(2, 50)):
            base = r.choice(bases)
            s = set(base)
            for _ in range(r.randrange(0, len(base) // r.choice([4, 8, 15]) + 1)):
                s.discard(r.choice(base))
                if r.random() < 0.7:
                    s.add(r.randrange(10**6))
            sets.add(tuple(sorted(s)))
        sets = sorted(x for x in sets if x)
        group = skipjoin.Group([np.array(x, np.uint64) for x in sets], t)
        for x, own in enumerate(group.order.tolist()):
            want = [y for y in range(len(sets)) if y != own and 100 * len(set(sets[own]) & set(sets[y])) >= t * len(set(sets[own]) | set(sets[y]))]
            assert sorted(group.order[group.links(x)].tolist()) == want


def test_alike_but_unlinked_sets_stay_cheap():
    import numpy as np

    r = np.random.default_rng(1)
    group = skipjoin.Group([np.sort(r.choice(200, 60, replace=False)).astype(np.uint64) for _ in range(2000)])
    assert not any(len(group.links(x)) for x in range(2000)) and group.held == 0


def test_shingles_are_words(monkeypatch):
    import pyarrow as pa

    r = random.Random(1)
    texts = [None, "", "  ", "a", "A b", "a b c d e", "x" * 5000 + " y", "X" * 5000 + " y", "ab " * 500] + ["".join(r.choice("abAB  \n\té\x85 ") for _ in range(r.randrange(60))) for _ in range(1000)]
    got = [s.tolist() for s in shingles.sets_of(pa.array(texts), 4)]
    of: dict = {}
    for text, s in zip(texts, got, strict=True):
        assert len(s) == len(shingle_set(text)) and s == sorted(set(s)) and of.setdefault(shingle_set(text), s) == s
    assert len({tuple(s) for s in of.values()}) == len(of)
    monkeypatch.setattr(shingles, "PIECE", 64)
    monkeypatch.setattr(shingles, "_powers", {})
    assert [s.tolist() for s in shingles.sets_of(pa.chunked_array([texts[:7], texts[7:]]), 4)] == got


def test_keep_one(spark):
    rows = hard_rows() + near_rows()
    kept = skipjoin.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    classes = {c[:1] + c[2:3]: 1 for c in brute_classes(rows)}
    wordless = [r for r in rows if not shingle_set(r[1])]
    firsts = {c for _, c in classes if c is not None}
    assert sum(got.values()) == len(wordless) + len({c for c in firsts if c not in {w[0] for w in wordless}}) + 1  # and the class without ids
    assert all((r[0], r[1]) in got for r in wordless)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (200, 201)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 3. language

LANGS = {"aa": "the and thing with from over under", "bb": "und der die das nicht über schön", "cc": "le la est où été garçon"}


def spoken(r, lang, n):
    return " ".join(r.choice(LANGS[lang].split()) for _ in range(n))


def test_gradients_are_right():
    import numpy as np

    net = language.Net(["a", "b"], hidden=3, seed=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    xs, y, w = r.integers(1, 255, (6, 4)), np.array([0, 1, 1, 0]), np.ones((6, 4))
    g, _ = net.gradients(xs, y, w)
    for k in ("v", "b", "u0", "u1", "x0"):
        flat = net.p[k].reshape(-1)
        for i in ([int(xs[0, 0]), int(xs[3, 2]) + 256] if k == "x0" else range(min(4, flat.size))):
            old = flat[i]
            up = []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                up.append(net.gradients(xs, y, w)[1])
            flat[i] = old
            assert abs((up[0] - up[1]) / 2e-3 - g[k].reshape(-1)[i]) < 2e-3


def test_network_reads_as_defined():
    """Byte by byte: two gated units over each window, a softmax of both states, the mean over all bytes."""
    import numpy as np

    net = language.Net(["a", "b", "c"], hidden=4, seed=3)
    H, p = 4, net.p
    texts = ["", "short", "é" * 40, "x" * 64, " ".join(str(i) for i in range(90))]

    def states(window, d):
        h, out = np.zeros(H), []
        for byte in window if d == 0 else window[::-1]:
            x, u = p[f"x{d}"][:, byte], p[f"u{d}"]
            z, r = (np.clip((x[k : k + H] + u[k : k + H] @ h) / 4 + 0.5, 0, 1) for k in (0, H))
            new = np.clip(x[2 * H :] + u[2 * H :] @ (r * h), -1, 1)
            h = (1 - z) * h + z * new
            out.append(h)
        return out if d == 0 else out[::-1]

    for text, got in zip(texts, language.pooled(net, texts), strict=True):
        data, total = text.encode(), np.zeros(3)
        for lo in range(0, len(data), 64):
            window = data[lo : lo + 64].ljust(64, b"\0")
            for f, b in list(zip(states(window, 0), states(window, 1), strict=True))[: len(data) - lo]:
                o = np.exp(p["v"] @ np.concatenate([f, b]) + p["b"][:, 0])
                total += o / o.sum()
        assert np.allclose(got, total / max(1, len(data)), atol=1e-4)


def test_language(spark):
    r = random.Random(7)
    rows = [(i, spoken(r, lang, r.randrange(8, 60)), lang) for i in range(240) for lang in [r.choice(list(LANGS))]]
    hard = [(1000, None), (1001, ""), (1002, "123 !? 45"), (1003, "und der"), (None, "the and"), (1004, spoken(r, "cc", 9000))]
    net = language.fit(documents(spark, rows), sample=200)
    got = {r["doc_id"]: r for r in language.identify(documents(spark, rows + hard), net).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if held(i)]
    assert sum(right) / len(right) > 0.95
    assert all(got[i]["held_out"] == held(i) for i, *_ in rows + hard)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1004]["lang_pred"] == "cc" and all(0 <= x["score"] <= 1 for x in got.values())
    assert language.identify(documents(spark, []), net).count() == 0
    none = language.fit(documents(spark, [(1, "abc")]))
    assert language.identify(documents(spark, [(1, "abc")]), none).first()["lang_pred"] == "und"


def test_learning_leaves_held_out_rows_alone(spark):
    rows = [(i, "the and thing", "aa") for i in range(50) if not held(i)] + [(i, "und der die", "bb") for i in range(200) if held(i)]
    assert language.fit(documents(spark, rows)).labels == ["aa"]


# 4. sharding


def test_sharding(spark):
    rows = hard_rows()
    weights = (1.0, 2.0, 0.5, 1.0)
    got = sharding.shard_documents(documents(spark, rows), weights, slot_buckets=7).collect()
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(documents(spark, rows), (*weights, 1.0)).collect()}

    def place(i, ws):
        key = "null" if i is None else str(i)
        draw = lambda s: -math.log((int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / ws[s]
        return min(range(len(ws)), key=draw)

    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for r in got:
        assert r["shard"] == place(r["doc_id"], weights) and r["grown_shard"] == more[r["doc_id"]] and r["grown_shard"] in (r["shard"], 4)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    whole = sharding.shard_documents(documents(spark, rows), whole=True)
    assert Counter(r["text"] for r in whole.collect()) == Counter(t for _, t, *_ in rows) and len(set(whole.columns)) == len(whole.columns)


def test_weights_attract_rows(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = Counter(r["shard"] for r in sharding.assign(df, F.col("doc_id"), (1.0, 3.0)).collect())
    assert abs(n[1] / 20000 - 0.75) < 0.02


# 5. decontamination


def brute_hits(rows, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    out = []
    for i, t, *_ in rows:
        words, hit, found = split(t), set(), set()
        for item, text in items:
            own = split(text)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("null" if item is None else str(item))
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def brute_near(rows, items):
    """Items all of whose words stand within a stretch of twice the item's length."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    out = []
    for i, t, *_ in rows:
        words, near = split(t), set()
        for item, text in items:
            own = split(text)
            if own and any(set(own) <= set(words[p : p + 2 * len(own)]) for p in range(len(words))):
                near.add("null" if item is None else str(item))
        out.append((i, len(near)))
    return Counter(out)


def leak_rows():
    r = random.Random(8)
    items = [(i, prose(r, n, 60)) for i, n in enumerate((25, 12, 10, 9, 3, 40, 1))] + [(7, None), (8, ""), (9, "w1 " * 15), (None, "null item of four"), (3, "w5 w6 w7 w8")]
    rows = hard_rows()
    for k in range(30):
        text = r.choice(items)[1] or ""
        words = text.split()
        a = r.randrange(0, max(1, len(words) - 9))
        cut = words[a : a + r.randrange(8, 20)]
        rows.append((300 + k, f"{prose(r, 30, 60)} {' '.join(cut).upper()}! {prose(r, 20, 60)} {'; '.join(cut) if k % 3 == 0 else ''}"))
    return rows + [(400, "w1 " * 40), (401, items[5][1] + " " + items[5][1]), (402, "w1-" * 10)], items


def test_decontamination(spark, monkeypatch):
    rows, items = leak_rows()
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, _k string")
    rows += [(600 + k, " ".join(random.Random(k).sample(t.split(), len(t.split())))) for k, (_, t) in enumerate(items) if t]  # their words in another order
    docs = documents(spark, rows)
    want, near = brute_hits(rows, items), brute_near(rows, items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for most in (decontam.MOST_BROADCAST, 0):  # with and without broadcasts
        monkeypatch.setattr(decontam, "MOST_BROADCAST", most)
        got = decontam.contamination(docs, bench).collect()
        assert Counter(tuple(r[c] for c in columns) for r in got) == want
        assert Counter((r["doc_id"], r["n_near"]) for r in got) == near
    assert max(n for _, n in near) > 1
    kept = decontam.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    dirty = {x[0] for x in want if x[-1]}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i not in dirty)
    assert decontam.contamination(documents(spark, []), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x x beta y y y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 50 + "beta gamma"), (4, "alpha beta")])
    q = spark.createDataFrame([("abc", ["alpha", "beta", "gamma"]), ("a", ["alpha"]), ("z", ["alpha", "missing"])], "query string, terms array<string>")
    index = decontam.build_index(docs, q.select(F.explode("terms").alias("term")))
    got = decontam.proximity_matches(index, q, 5)
    near = {(r["query"], r["_id"]) for r in got.collect()}
    assert near == {("abc", 2), ("a", 1), ("a", 2), ("a", 3), ("a", 4)}  # in 1, alpha and gamma are 7 apart, and beta 4 of both
    assert {(r["query"], r["_id"]) for r in decontam.proximity_matches(index, q, 8).collect()} >= {("abc", 1)}


# 6. toxicity


def test_toxicity(spark):
    r = random.Random(9)
    bad = ["wretch", "fiend", "swine"]

    def text(toxic, n=60):
        words = prose(r, n, 300).split()
        for _ in range(2 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad)
        return " ".join(words)

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(documents(spark, rows), labels)
    hard = [(1000, None), (1001, ""), (1002, "..."), (1003, text(False, 5000)), (1004, text(False, 3000) + " wretchh"), (1005, "the swinee there")]
    got = {x["doc_id"]: x for x in toxicity.score(documents(spark, rows + hard), scorer).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400) if held(i))
    assert [got[i]["predicted"] for i in range(1000, 1006)] == [0, 0, 0, 0, 1, 1]  # unseen misspellings share n-grams
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] and all(0 <= x["score"] <= 1 for x in got.values())
    clean = toxicity.keep_clean(documents(spark, rows + hard), scorer)
    assert clean.columns == documents(spark, []).columns and {x["doc_id"] for x in clean.collect()} == {i for i, x in got.items() if not x["predicted"]}
    assert toxicity.score(documents(spark, []), scorer).count() == 0


def test_scores_are_those_of_the_worst_passage():
    import numpy as np

    r = np.random.default_rng(5)
    scorer = toxicity.Scorer(r.standard_normal(toxicity.BUCKETS), -0.5)

    def buckets(word):
        marked, out = f"<{word}>", []
        for n in range(3, 7):
            for i in range(len(marked) - n + 1):
                h = 0
                for ch in marked[i : i + n]:
                    h = h * 0x01000193 + ord(ch) & 0xFFFFFFFF
                h ^= n * 0x9E3779B1 & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                out.append((h ^ h >> 13) & toxicity.BUCKETS - 1)
        return out

    pick = random.Random(6)
    texts = ["", "...", "a", "Übel word", *(" ".join("".join(pick.choice("abcdeü") for _ in range(pick.randrange(1, 12))) for _ in range(pick.randrange(1, 40))) for _ in range(30))]
    for text, got in zip(texts, scorer.scores(texts), strict=True):
        words = re.findall(r"[^\W_]+", text.lower())
        best = None
        for lo in range(0, len(words), toxicity.PASSAGE):
            ids = [b for w in words[lo : lo + toxicity.PASSAGE] for b in buckets(w)]
            mean = sum(scorer.logit[b] for b in ids) / max(len(ids), toxicity.LEAST) - 0.5
            best = mean if best is None else max(best, mean)
        assert abs(got - 1 / (1 + math.exp(-(-0.5 if best is None else best)))) < 1e-9


def test_toxicity_gradients_are_right(monkeypatch):
    import numpy as np

    seen = []
    real = toxicity.gradients
    monkeypatch.setattr(toxicity, "gradients", lambda params, d, worst: (seen.append((params, d)), real(params, d, worst))[1])
    r = random.Random(7)
    toxicity.train([(prose(r, 30, 40) + (" wretch" if i % 2 else ""), i % 2) for i in range(12)], steps=1)
    params, d = seen[0]
    params = [p.copy() for p in params]
    for worst in (False, True):
        grads, _ = real(params, d, worst)
        for p, g in zip(params, grads, strict=True):
            flat, by = p.reshape(-1), g.reshape(-1)
            for i in np.argsort(-np.abs(by))[:4].tolist():
                old, up = flat[i], []
                for step in (1e-3, -1e-3):
                    flat[i] = old + step
                    up.append(real(params, d, worst)[1])
                flat[i] = old
                assert abs((up[0] - up[1]) / 2e-3 - by[i]) < 1e-4 + 0.02 * abs(by[i])


def test_repeated_rows_teach_the_same(spark):
    rows = [(i, prose(random.Random(i), 20) + (" wretch" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    once = toxicity.fit(documents(spark, rows), labels)
    again = toxicity.fit(documents(spark, rows + rows[:20]), labels)
    assert (once.logit == again.logit).all() and once.bias == again.bias
    said = [(*r, r"aa" if r[0] % 2 else "bb") for r in rows]
    a, b = (language.fit(documents(spark, x)) for x in (said, [*said[::-1]]))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_toxicity_without_labels(spark):
    none = toxicity.fit(documents(spark, [(1, "a b")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(documents(spark, [(1, "a b")]), none).first()["predicted"] == 0


# 7. personal data


def brute_base(text):
    spans = lambda p: [m.span() for m in re.finditer(p, text)]
    digits = lambda s: re.sub("[^0-9]", "", text[s[0] : s[1]])
    out = [("email", *s) for s in spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", *s) for s in spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in text[s[0] : s[1]].split("."))]
    out += [("card", *s) for s in spans(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))]
    out += [("phone", *s) for s in spans(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(s)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data(spark):
    r = random.Random(10)
    rows = [(i, "".join(r.choice("a1.@-+ (9)4") for _ in range(80))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "ü mail jan.1@mail.example.com, ip 10.1.2.3. card 4111111111111111"), (1003, "call +1 (269) 555-3296 4524132264652876 now"), (1004, "x " * 40000 + "a@b.cc"), (1005, "9" * 20000), (1006, "password=101a821562d3999d51 At Anin"), (1004, "again 1.2.3.4"), (None, "+44 20 7946 0958")]
    got = pii.find(documents(spark, rows)).collect()
    want = Counter((i, hashlib.sha256(brute_base(t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((x["doc_id"], x["base_sha256"]) for x in got) == want
    by = {x["doc_id"]: x for x in got}
    for x in got:
        spans = x["spans"].split(",") if x["spans"] else []
        assert len(spans) == x["n_email"] + x["n_ip"] + x["n_card"] + x["n_phone"]
    assert by[1003]["spans"] == "card:23:39,phone:5:22" and by[1003]["n_added"] == 2
    assert by[1006]["spans"] == "" and by[1000]["spans"] == by[1001]["spans"] == ""
    texts = {i: t for i, t in rows}
    for i in (1002, 1003, 1006):
        assert set(filter(None, brute_base(texts[i]).split(","))) <= set(by[i]["spans"].split(","))
    assert pii.find(documents(spark, [])).count() == 0


def test_personal_data_query_counts_the_patterns(spark, tmp_path):
    from reelwright.llm import queries

    rows = [(1, "call +1 (269) 555-3296 4524132264652876 now"), (2, "an eva (at) mail.example.net oder a@b.cc 1.2.3.4"), (3, None), (4, "card 4111111111111111, +44 20 7946 0958")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op7_pii(spark, str(tmp_path)).collect()}
    for i, text in rows:
        kinds = [s.split(":")[0] for s in brute_base(text or "").split(",") if s]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(brute_base(text or "").encode()).hexdigest()
        assert got[i]["n_added"] == len(list(filter(None, got[i]["spans"].split(",")))) - len(kinds)
    assert got[1]["n_added"] == 2 and got[2]["n_added"] == 1 and got[2]["n_email"] == 1


def test_field_learns_its_table():
    field = pii.train()
    wrong = 0
    for row in pii.LABELLED:
        words, labels = pii._marked(row)
        wrong += [pii.LABELS[i] for i in field.decode([words])[0]] != labels
    assert wrong == 0
    # Islands decoded side by side are what each is alone.
    islands = [pii._marked(r)[0] for r in pii.LABELLED]
    assert all((a == b).all() for a, b in zip(field.decode(islands), [field.decode([w])[0] for w in islands], strict=True))


def test_field_reads_every_word(spark):
    rows = [r for r in pii.LABELLED if re.search(r"\[(email|ip|card|phone)\|", r)]
    plain = [re.sub(r"\[(?:email|ip|card|phone)\|((?:[^\[\]]|\[[^\[\]]*\])*)\]", r"\1", r) for r in rows]
    field = pii.train()
    for row, text in zip(rows, plain, strict=True):
        marked = re.findall(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[[^\[\]]*\])*)\]", row)
        assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(field, [text], [[]])[0]] == marked
    texts = ["an eva (at) mail.example.net oder", "an max [at] example.com und", "word " * 500 + "an eva (at) mail.example.net oder" + " word, wörd" * 500, "plain words, and no more; at last. " * 100]
    got = {x["doc_id"]: x["spans"] for x in pii.find(documents(spark, list(enumerate(texts))), field).collect()}
    assert got == {0: "email:3:28", 1: "email:3:23", 2: "email:2503:2528", 3: ""}


def test_islands_give_the_labels_of_whole_texts():
    r, field = random.Random(12), pii.train()
    words = [w for row in pii.LABELLED for w in pii._marked(row)[0]]
    texts = [[r.choice(words) for _ in range(r.randrange(40))] for _ in range(300)] + [[]]
    assert field.label(texts).tolist() == [y for path in field.decode(texts) for y in path.tolist()]


def test_plain_text_has_no_spans(spark):
    from pathlib import Path

    r, field = random.Random(13), pii.train()
    words = [w for row in pii.LABELLED for w, y in zip(*pii._marked(row), strict=True) if y == "O" and w.isalpha() and w not in ("dot", "punkt", "punto", "point")]
    texts = [" ".join(r.choice(words) for _ in range(10000)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz    .,'-") for _ in range(60000))]
    numbers = []
    while len(numbers) < 400:
        x = "".join(r.choice("0123456789") for _ in range(r.randrange(13, 20)))
        if not pii.luhn(x):
            numbers.append(x)
    texts += [f"{r.choice(words)} {x} {r.choice(words)}" for x in numbers] + ["iban DE89370400440532013001 x", "GB29 NWBK 6016 1331 9268 19 is one", "to DE89 3704 0044 0532 0130 00 now"]
    assert not any(pii.added_spans(field, texts, [[] for _ in texts]))
    if Path("/root/testdata/sf0.001").is_dir():  # the spans are those of whole texts
        docs = [pii.TOKEN.findall(x["text"] or "") for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
        assert field.label(docs).tolist() == [y for path in field.decode(docs) for y in path.tolist()]


def test_marginals_are_those_of_all_paths():
    """One step of training from zero weights moves by the gradient, which brute force over all labellings gives."""
    import itertools

    import numpy as np

    row = "call [phone|+1 555-0199] now"
    words, gold = pii._marked(row)
    n = len(pii.LABELS)
    allowed = lambda a, b: pii.LABELS[b][0] != "I" or a < n and pii.LABELS[a][1:] == pii.LABELS[b][1:]
    paths = [p for p in itertools.product(range(n), repeat=len(words)) if all(allowed(a, b) for a, b in zip((n, *p), p, strict=False))]
    expect = np.zeros((len(words), n))
    for p in paths:  # all weights 0: every allowed path is as likely as another
        expect[range(len(words)), p] += 1 / len(paths)
    truth = np.zeros((len(words), n))
    truth[range(len(words)), [pii.LABELS.index(y) for y in gold]] = 1
    field = pii.train([row], steps=1)
    sign = np.sign(truth - expect).sum(0)  # of the bias: the first step of Adam goes 0.15 along the gradient's sign
    moved = field.own[0]
    assert ((np.sign(np.round((truth - expect).sum(0), 9)) == np.sign(np.round(moved, 9))) | (sign == 0)).all()


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    field = pii.train(steps=20)
    words = "call +1 (269) 555-3296 now".split()
    e, n = field.scores(words), len(pii.LABELS)
    best = max(itertools.product(range(n), repeat=len(words)), key=lambda p: field.pair[n, p[0]] + sum(e[t, p[t]] for t in range(len(p))) + sum(field.pair[p[t - 1], p[t]] for t in range(1, len(p))))
    assert np.array_equal(field.decode([words])[0], best)


# 8. WARC


def archive(n=12, pack=warc.member):
    payloads = [(f"<p>{i}</p>" * (i * 50 + 1)).encode() for i in range(n)]
    return payloads, [pack(warc.record(i, f"http://h/{i}", p, hashlib.sha1(p).hexdigest())) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("pack", [warc.member, bytes])
def test_salvage(pack):
    import io

    payloads, parts = archive(pack=pack)
    read = lambda data: list(warc.read_archive(io.BytesIO(data)))
    assert [r.payload for r in read(b"".join(parts))] == payloads
    r = random.Random(11)
    for _ in range(25):
        bad, k = list(parts), r.randrange(len(parts))
        x = bytearray(bad[k])
        for _ in range(3):
            x[r.randrange(len(x))] ^= 1 << r.randrange(8)
        kind = r.randrange(3)
        bad[k] = bytes(x) if kind == 0 else bytes(x[: len(x) // 2]) if kind == 1 else b"garbage" + bad[k]
        data = b"".join(bad)
        got = read(data)
        found = [g.payload for g in got if isinstance(g, warc.Record)]
        assert [p for i, p in enumerate(payloads) if i != k] == [p for p in found if p != payloads[k]]
        at = 0
        for g in got:  # records and gaps cover the file without holes
            start = g.offset if isinstance(g, warc.Record) else g.start
            assert start == at
            at = g.end
        assert at == len(data)
        if kind == 2:
            assert payloads[k] in found


def test_plain_records_with_long_headers():
    """Headers beyond the first read, whole and cut off; the record after a cut one is found."""
    import io

    digest = hashlib.sha1(b"body").hexdigest()
    long = [warc.record(i, "http://h.example/" + "x" * n, b"body", digest) for i, n in enumerate((10, 70_000, 300_000, 5))]
    read = lambda data: list(warc.read_archive(io.BytesIO(data)))
    assert [len(r.headers["warc-target-uri"]) for r in read(b"".join(long))] == [27, 70_017, 300_017, 22]
    got = read(long[0] + long[1][:69_000] + b"\r\n" + long[2] + long[3])
    assert [type(g) for g in got] == [warc.Record, warc.Gap, warc.Record, warc.Record] and got[1].end - got[1].start == 69_002
    assert [type(g) for g in read(long[0] + long[2][:250_000])] == [warc.Record, warc.Gap]


def test_warc_query(spark):
    long = "é" * 600
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999), (5, "u\r\nv", None), (6, "http://a/6", ""), (None, "http://a/7", long), (9, "http://a/9", long)]
    df = spark.createDataFrame([(*r, "h", "d") for r in rows], EMPTY["pages"]).repartition(3)
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.archive_pages(spark, df).collect())

    def want(r):
        p = (r[2] or "").encode()
        revisit = r[2] == long and r[0] != 9
        return r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None

    assert got == Counter(map(want, rows))
    assert warc.archive_pages(spark, df.limit(0)).count() == 0


def test_long_urls_are_archived(spark, tmp_path):
    rows = [(1, "data:," + "x" * 70000, "<p>a</p>", "h", "d"), (2, "http://h/", "<p>b</p>", "h", "d"), (3, "data:," + "y" * 3000000, "<p>c</p>", "h", "d")]
    df = spark.createDataFrame(rows, EMPTY["pages"])
    assert sorted(r["page_id"] for r in warc.archive_pages(spark, df).collect()) == [1, 2, 3]
    manifest = warc.write_archives(df.coalesce(1), str(tmp_path))
    with pytest.raises(Exception, match="4 written"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1), whole=True).collect()
    path = manifest.first()["path"]
    data = open(path.removeprefix("file:"), "rb").read()
    open(path.removeprefix("file:"), "wb").write(data[:-5])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(manifest, whole=True).collect()


def test_gaps_are_rows(spark, tmp_path):
    _, parts = archive(3)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"???" + parts[1] + parts[2][:-9])
    paths = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")
    rows = warc.read_archives(paths).orderBy("start").collect()
    assert [r["gap"] is None for r in rows] == [True, False, True, False] and [r["page_id"] for r in rows if r["gap"] is None] == [0, 1]
    assert rows[1]["end"] - rows[1]["start"] == 3


# 9. HTML

NAV = "<nav><ul><li><a href='/a'>Menu &amp; more</a></li></ul></nav><!-- ad --><div class='ad box'>Buy</div>"


def page(body, article=True):
    inner = f"<article><h1>T&eacute;st</h1>{body}</article>" if article else f"<div id=main>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{NAV}{inner}<aside>side</aside><section class='comments'><p>reader</p></section><footer>&copy; x</footer>"


def test_content():
    c = wrapper.content
    assert c(page("<p>One  two\n three</p><p><b>Bold &lt;x&gt; &amp;amp;<br><p>Next<ul><li>i<li>j</ul>")) == "Tést\nOne two three\nBold <x> &amp;\nNext\ni\nj"
    assert c("") == "" and c("plain text") == "plain text" and c("<p>a<p>b") == "a\nb" and c("a < b") == "a < b" and c("<p>cut <b") == "cut"
    assert c("<body><div>x<form>f</form></div><p>y") == "x\ny"
    assert c("<div>" * 5000 + "deep") == "deep"


def blocks(text):
    return wrapper.tree(wrapper.parse(text))


def some_blocks(r, depth=3):
    if not depth:
        return ""
    return "".join(f"<{t}{c}>{r.choice(['', 'a', 'b'])}{some_blocks(r, depth - 1)}</{t}>" for _ in range(r.randrange(5)) for t, c in [r.choice([("div", ""), ("div", " class=x"), ("section", ""), ("ul", "")])])


def brute_match(a, b):
    """Simple tree matching as defined: of equal roots, one and the best mapping of their children in order."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i + 1][j], m[i][j + 1], m[i][j] + brute_match(x, y))
    return 1 + m[-1][-1]


def test_simple_tree_matching():
    r = random.Random(21)
    for _ in range(300):
        a, b = blocks(some_blocks(r)), blocks(some_blocks(r))
        assert wrapper.match(a, b, {}) == brute_match(a, b) == wrapper.match(b, a, {})
        pairs = wrapper._mapped(a.kids, b.kids, {})
        assert sum(brute_match(a.kids[i], b.kids[j]) for i, j in pairs) == brute_match(a, b) - 1
        for pairs in (pairs, wrapper.aligned(a.kids, b.kids, {})):  # order-keeping, of equal labels
            assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:], strict=False))
            assert all(a.kids[i].label == b.kids[j].label for i, j in pairs)
    x, y = blocks("<p>1</p><ul></ul><p>2</p><ol></ol>"), blocks("<ul></ul><p>2</p><p>3</p><ol></ol>")
    assert wrapper.aligned(x.kids, y.kids, {}) == [(1, 0), (2, 1), (3, 3)]


def template_of(pages, most=wrapper.REFERENCES):
    slots, counts = wrapper.induce(sorted(set(pages))[:most]), {}
    w = wrapper.Wrapper(slots)
    for p in pages:
        wrapper.counted(w, p, counts)
    return wrapper.Wrapper(slots, *wrapper.judged(slots, counts)[:2])


def story(r, n):
    return "".join(f"<p>{prose(r, r.randrange(10, 60))}</p>" for _ in range(n))


@pytest.mark.parametrize("tag", ["article", "div class=post"])
def test_alignment_decides_without_kinds(monkeypatch, tag):
    """Menus, adverts, notices and footers whose texts vary go by their slots alone: no kinds of elements, no names, no article."""
    monkeypatch.setattr(wrapper, "NOT_CONTENT", frozenset(["script", "style", "head", "title"]))
    monkeypatch.setattr(wrapper, "NAMES", frozenset())
    r = random.Random(22)

    def made(i):
        menu = "".join(f"<li><a href=/{k}>{prose(r, 1)}</a></li>" for k in range(6))
        own = f"<h1>Title {i}</h1>{story(r, r.randrange(3, 12))}"
        advert = prose(random.Random(i % 5), 8)  # one of a few
        return own, f"<body><div class=u1><ul>{menu}</ul></div><div class=u2>{advert}</div><{tag}>{own}</{tag.split()[0]}><div class=u3>About us</div><div class=u4>&copy; {prose(r, 4)}</div>"

    pages = [made(i) for i in range(30)]
    w = template_of([p for _, p in pages])
    assert [wrapper.content(p, w) for _, p in pages] == [wrapper.content(own) for own, _ in pages]


def own_words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))


def layouts(r, i):
    """(blocks of the article, page) of hosts without an article element, every text the page's own, with menus, adverts and notices around."""
    w = lambda n: own_words(r, n)
    menu = "<ul class=m>" + "".join(f"<li><a href=/{k}>{k} home</a></li>" for k in range(5)) + "</ul>"
    adverts = ["Buy shoes at half the price", "Fly to Rome now", "New phones are here today"]
    p = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    lead, main = w(25), [w(40) for _ in range(4)]
    yield [lead, *main], f'<body>{menu}<div class="lead">{lead}</div><div class="main">{p(main)}</div><div class=f>All rights reserved</div></body>'
    title, author, body, end = w(5), w(3), [w(40) for _ in range(3)], w(30)
    yield [title, author, *body, end], f'<body><div class=x>Welcome to us</div><h1>{title}</h1><div class="author">{author}</div><div class="body">{p(body)}</div><div class="end">{end}</div></body>'
    sections = [w(30), w(35), w(160)]
    yield sections, "<body><main>" + "".join(f"<section>{x}</section>" for x in sections) + "</main></body>"
    title, body = w(6), [w(50) for _ in range(r.randrange(3, 8))]
    yield [title, *body], f"<body><div class=u1>{adverts[i % 3]}</div><div class=post><h1>{title}</h1>{p(body)}</div><div class=u3>&copy; host.example &middot; {w(4)}</div><div class=u4>{adverts[(i + 1) % 3]}</div></body>"


@pytest.mark.parametrize("layout", range(4))
def test_text_of_the_pages_own_stays(layout):
    """Leads, authors, sections and closing blocks that differ on every page are kept, however short and alike in shape."""
    r = random.Random(27)
    pages = [list(layouts(r, i))[layout] for i in range(30)]
    w = template_of([p for _, p in pages])
    assert [wrapper.content(p, w) for _, p in pages] == ["\n".join(own) for own, _ in pages]


def test_random_hosts_keep_all_that_varies(spark):
    """A brute-force judge: of a host's blocks, those whose text differs on every page are the article, the others template."""
    r = random.Random(28)
    rows, want = [], {}
    for h in range(12):
        kinds = [r.choice(["own", "same", "few"]) for _ in range(r.randrange(2, 6))]
        fixed = [own_words(r, r.randrange(3, 10)) for _ in kinds]
        for i in range(12):
            texts = [own_words(r, r.randrange(4, 30)) if k == "own" else f if k == "same" else f"{f} {'abc'[i % 3]}" for k, f in zip(kinds, fixed, strict=True)]
            body = [own_words(r, 60) for _ in range(3)]
            blocks = [f'<div class="b{k}">{x}</div>' for k, x in enumerate(texts)]
            at = len(blocks) // 2
            page = "".join(blocks[:at]) + f'<div class="text">{"".join(f"<p>{x}</p>" for x in body)}</div>' + "".join(blocks[at:])
            rows.append((100 * h + i, f"http://h{h}.example/{i}", f"<body>{page}</body>", "h", "d"))
            kept = [x if k == "own" else None for x, k in zip(texts, kinds, strict=True)]
            want[100 * h + i] = "\n".join([x for x in kept[:at] if x] + body + [x for x in kept[at:] if x])
    got = {x["page_id"]: x["text"] for x in wrapper.extract(spark.createDataFrame(rows, EMPTY["pages"]).repartition(3)).collect()}
    assert got == want


def test_names_alone_remove_nothing():
    for own in ('<div class="layout-with-sidebar"><p>one</p></div>', '<div class="post no-comments"><p>one</p></div>', '<p class="related-work">one</p>', '<div id="social-contract">one</div>', "<menu><li>one</li></menu>", '<div class="comments">one</div>'):
        assert wrapper.content(f"<body>{own}</body>") == wrapper.content(f"<body><article>{own}</article></body>") == "one"
    r = random.Random(23)
    pages = [f'<body><div class=nav-bar><a href=/>Home</a></div><div class="layout-with-sidebar"><div class="post no-comments"><h1>T {i}</h1>{story(r, 4)}<p class="related-work">see {i}</p></div></div></body>' for i in range(12)]
    got = [wrapper.content(p, template_of(pages)) for p in pages]
    assert all(x.startswith(f"T {i}\n") and x.endswith(f"see {i}") and "Home" not in x for i, x in enumerate(got))


def test_readers_comments_go_where_alignment_agrees():
    r = random.Random(24)
    pages = [f"<body><article><h1>T {i}</h1>{story(r, 6)}</article><section class=comments>{story(r, r.randrange(1, 4))}</section></body>" for i in range(12)]
    w = template_of(pages)
    assert all(wrapper.content(p, w).count("\n") == 6 for p in pages)


def test_near_copies_keep_their_text():
    r = random.Random(25)
    base = [f"<p>{prose(r, 40)}</p>" for _ in range(8)]
    pages = []
    for i in range(9):
        own = list(base)
        own[i % 8] = f"<p>{prose(r, 45)}</p>"
        pages.append(f"<body><nav>menu</nav><article><h1>Same</h1>{''.join(own)}</article><footer>end</footer></body>")
    w = template_of(pages)
    assert all(wrapper.content(p, w).startswith("Same\n") and wrapper.content(p, w).count("\n") == 8 for p in pages)
    # A third of a host are copies with a longer article than all others.
    others = [f"<body><nav>menu</nav><article><h1>T {i}</h1>{story(r, 3)}</article><footer>end</footer></body>" for i in range(18)]
    w = template_of(pages + others)
    assert all(wrapper.content(p, w).count("\n") == 8 for p in pages)


def test_deep_and_wide_pages():
    import time

    deep = "<div>" * 20000 + "text" + "</div>" * 20000
    assert wrapper.content("<div>" * 210 + "<nav>NAVTEXT</nav>in") == "in" and wrapper.content(deep) == "text"
    assert wrapper.content(deep, template_of([deep, "<p>x</p>" + deep, deep + "<p>y</p>"])) == "text"
    r = random.Random(26)
    rows = lambda n: "".join(f"<tr>{''.join(f'<td>{r.random()}</td>' for _ in range(r.randrange(2, 6)))}</tr>" for _ in range(n))
    pages = [f"<body><table>{rows(1800)}</table></body>" for _ in range(3)]
    start = time.perf_counter()
    assert len(wrapper.induce(pages)) > 1800 and time.perf_counter() - start < 5
    assert wrapper.content(pages[0], template_of(pages)) == wrapper.content(pages[0])


def test_long_pages_lose_their_template():
    def long(i, n):
        return "<body>" + "".join(f"<p>{i} line {k}</p>" for k in range(n)) + "<p>Read our terms</p><div>All rights reserved</div></body>"

    pages = [long(i, n) for i, n in enumerate((201, 300, 250, 220, 1))]
    w = template_of(pages)
    for i, n in ((0, 201), (1, 300), (7, 330)):
        assert wrapper.content(long(i, n), w) == "\n".join(f"{i} line {k}" for k in range(n))


def test_templates_drop_what_stays(spark):
    def plain(i):
        return f"<html><body><div>Welcome to our site</div><div><p>Story {i} is new</p><p>Line {i * 7}</p></div><div>All rights reserved</div></body></html>"

    rows = [(i, f"http://h.example/{i}", plain(i)) for i in range(40)] + [(100, "http://solo.example/x", plain(1)), (101, None, plain(2)), (102, "http://h.example/e", None), (103, "http://h.example/e", ""), (104, "http://h.example/1", plain(1)), (105, "http://H.example/y", page("<p>in</p>"))]
    df = spark.createDataFrame([(*r, "h", "d") for r in rows], EMPTY["pages"]).repartition(4)
    got = {r["page_id"]: r for r in wrapper.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"Story {i} is new\nLine {i * 7}" for i in range(40)) and got[104]["text"] == got[1]["text"]
    assert got[100]["text"].startswith("Welcome") and got[102]["text"] == got[103]["text"] == "" and got[105]["text"] == "Tést\nin"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrapper.extract(df.limit(0)).count() == 0


def test_three_pages_have_a_template(spark):
    rows = [(3 * h + i, f"http://h{h}.example/{i}", f"<div>Top</div><p>Text {h} {i}</p>", "h", "d") for h in range(20) for i in range(3)]
    rows += [(100 + i, "http://two.example/", f"<div>Top</div><p>Text {i % 2}</p>", "h", "d") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, EMPTY["pages"]).repartition(4)).collect()}
    assert all(got[3 * h + i] == f"Text {h} {i}" for h in range(20) for i in range(3))
    assert all(got[100 + i] == f"Top\nText {i % 2}" for i in range(6))


def test_salted_templates_give_the_same(spark, monkeypatch):
    rows = [(i, "http://h.example/", f"<div>Top</div><p>Text {i}</p>", "h", "d") for i in range(20)]
    df = spark.createDataFrame(rows, EMPTY["pages"])
    a = sorted(map(tuple, wrapper.extract(df).collect()))
    monkeypatch.setattr(wrapper, "MOST_CHARS", -1)
    monkeypatch.setattr(wrapper, "MOST_KEYS", -1)
    assert sorted(map(tuple, wrapper.extract(df).collect())) == a and a[0][2] == "Text 0"


# 10. mixing


def brute_targets(totals):
    """Reshare the excess over the caps by weight until none is above."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, total = {s: 3 * totals[s] for s in names}, sum(totals.values())
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > cap[s]]
        if not over:
            return fixed | goal
        fixed |= {s: cap[s] for s in over}


def test_mixing(spark):
    r = random.Random(12)
    rows = hard_rows() + [(500 + i, prose(r, r.randrange(1, 50)), "en", s) for i, s in enumerate(["big"] * 150 + ["tiny", "small", "small", "Z", "é", "", "", None])]
    got = mixing.mix(documents(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for row in rows:
        totals[row[3] if len(row) > 3 else None] += size(row[1])
    want = brute_targets(totals)
    source = {row[0]: (row[3] if len(row) > 3 else None) for row in rows}
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((row[0], size(row[1])) for row in rows)
    taken = Counter()
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == totals[s] and abs(x["target"] - want[s]) < 1e-6
        assert 0 <= x["taken"] <= 3 * x["size"] and (x["position"] is None) == (x["taken"] == 0)
        taken[s] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in totals)
    positions = [x["position"] for x in got if x["position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    again = mixing.mix(documents(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    whole = mixing.mixed_rows(documents(spark, rows))
    copies = Counter()
    for x in got:
        copies[x["doc_id"]] += x["copies"]
    assert whole.columns == documents(spark, []).columns and Counter(x["doc_id"] for x in whole.collect()) == +copies
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [(1, None)])).first()["taken"] == 0


@pytest.mark.parametrize(("first", "last"), [(1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (0.0, 2.0)])
def test_positions_invert_the_integral(spark, first, last):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("s"))
    for r in df.select("s", mixing.when_consumed(F.col("s"), F.lit(first), F.lit(last)).alias("t")).collect():
        t = r["t"]
        assert abs((first * t + (last - first) * t * t / 2) / ((first + last) / 2) - r["s"]) < 1e-9
