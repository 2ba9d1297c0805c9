"""Features of images against plain loops: colours, brush, regions, borders, edges."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwright.functions import exprs, pixels

R = np.random.default_rng(9)
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def masks(n=40, h=9, w=11):
    return np.stack([R.random((h, w)) < p for p in R.uniform(0.1, 0.9, n)])


def brute_regions(mask, steps):
    label, out = 0, np.full(mask.shape, -1)
    for at in zip(*np.nonzero(mask), strict=True):
        if out[at] < 0:
            todo = deque([at])
            out[at] = label
            while todo:
                y, x = todo.popleft()
                for dy, dx in steps:
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and out[q] < 0:
                        out[q] = label
                        todo.append(q)
            label += 1
    return out


@pytest.mark.parametrize("corners", [True, False])
def test_regions(corners):
    stack = masks()
    got = pixels.regions(stack, corners)
    steps = AROUND if corners else [(-1, 0), (0, -1), (0, 1), (1, 0)]
    for k, mask in enumerate(stack):
        want = brute_regions(mask, steps)
        pairs = {(int(a), int(b)) for a, b in zip(got[k].ravel(), want.ravel(), strict=True)}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert len({int(x) for k in range(2) for x in got[k].ravel() if x >= 0}) == sum(brute_regions(m, steps).max() + 1 for m in stack[:2])  # no number in two images


def border_area(mask):
    """Follows the outer border of each region, pixel by pixel, and takes the polygon's area; the greatest one."""
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    labels, best = brute_regions(mask, AROUND), 0.0
    inside = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]
    for k in range(labels.max() + 1):
        ys, xs = np.nonzero(labels == k)
        start = (int(ys[0]), int(xs[0]))  # the first in reading order: what is left of it is outside
        on = lambda p, k=k: inside(p) and labels[p] == k
        path, at, back, moves = [start], start, 0, set()
        while True:
            for i in range(1, 9):
                d = (back + i) % 8
                q = (at[0] + ring[d][0], at[1] + ring[d][1])
                if on(q):
                    break
            else:
                break
            if (at, q) in moves:
                break
            moves.add((at, q))
            path.append(q)
            before = (at[0] + ring[(d - 1) % 8][0], at[1] + ring[(d - 1) % 8][1])  # the last one that was off
            at, back = q, ring.index((before[0] - q[0], before[1] - q[1]))
        best = max(best, abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(path, path[1:] + path[:1], strict=True))) / 2)
    return best


def test_areas_of_outer_borders():
    shapes = []
    m = np.zeros((12, 14), bool)
    m[1:8, 2:9] = True
    shapes.append((m, 36.0))  # 7 x 7 pixels, 6 x 6 between their middles
    ring = m.copy()
    ring[3:6, 4:7] = False
    shapes.append((ring, 36.0))  # a hole counts
    island = ring.copy()
    island[4, 5] = True
    shapes.append((island, 36.0))
    diamond = np.zeros((12, 14), bool)
    diamond[[1, 2, 2, 3], [5, 4, 6, 5]] = True
    shapes.append((diamond, 2.0))
    shapes.append((np.eye(12, 14, dtype=bool), 0.0))
    shapes.append((np.zeros((12, 14), bool), 0.0))
    got = pixels.largest_areas(np.stack([m for m, _ in shapes]))
    assert got.tolist() == [a for _, a in shapes]
    for m, a in shapes:
        assert border_area(m) == a
    stack = masks(200)
    assert pixels.largest_areas(stack).tolist() == [border_area(m) for m in stack]


def test_brush():
    mask = np.zeros((1, 16, 24), bool)
    mask[0, 2:10, 3:12] = True
    opened = pixels._brushed(pixels._brushed(mask, False), True)
    assert mask.sum() - opened.sum() == 8  # two pixels of each corner
    thin = np.zeros((1, 9, 9), bool)
    thin[0, 4] = True
    assert not pixels._brushed(thin, False).any()
    edge = np.ones((1, 6, 6), bool)
    assert pixels._brushed(edge, False).all() and pixels._brushed(edge, True).all()  # what is beyond the image changes nothing


def test_colours():
    rgb = np.array([[[0, 255, 0], [0, 0, 255], [255, 255, 0], [10, 10, 10], [0, 0, 0], [255, 0, 1]]], np.uint8)
    assert pixels.hsv(rgb)[0].tolist() == [[60, 255, 255], [120, 255, 255], [30, 255, 255], [0, 0, 10], [0, 0, 0], [0, 255, 255]]
    many = R.integers(0, 256, (200, 50, 3)).astype(np.uint8)
    h, s, v = np.moveaxis(pixels.hsv(many).astype(float), -1, 0)
    c = many.astype(float)
    spread = np.ptp(c, axis=-1)
    assert (v == c.max(-1)).all() and (np.abs(s - 255 * spread / np.maximum(v, 1)) <= 0.6).all() and h.min() >= 0 and h.max() < 180


@pytest.mark.parametrize(("colour", "is_skin"), [((200, 140, 110), True), ((40, 30, 26), True), ((30, 22, 19), True), ((120, 118, 119), False), ((0, 0, 255), False), ((255, 40, 10), True), ((90, 30, 5), True), ((190, 150, 60), False)])
def test_skin_tones(colour, is_skin):
    """Among them tones that only one of the three ranges has."""
    image = np.tile(np.array(colour, np.uint8), (1, 8, 8, 1))
    assert pixels.skin_masks(pixels.hsv(image)).all() == is_skin
    h, s, v = pixels.hsv(image)[0, 0, 0].tolist()
    ranges = [((0, 48, 40), (20, 255, 255)), ((0, 30, 20), (15, 200, 200)), ((0, 20, 100), (15, 150, 255))]
    assert is_skin == any(all(a <= x <= b for a, x, b in zip(low, (h, s, v), high, strict=True)) for low, high in ranges)


def brute_edges(rgb):
    height, width, _ = rgb.shape
    grey = [[(int(r) * 9798 + int(g) * 19235 + int(b) * 3735 + 16384) >> 15 for r, g, b in row] for row in rgb]
    px = lambda y, x: grey[min(max(y, 0), height - 1)][min(max(x, 0), width - 1)]
    d = {}
    for y in range(height):
        for x in range(width):
            dx = sum(k * (px(y + i, x + 1) - px(y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (px(y + 1, x + i) - px(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            d[y, x] = dx, dy
    m = lambda y, x: sum(map(abs, d.get((y, x), (0, 0))))
    thin = set()
    for (y, x), (dx, dy) in d.items():
        slope = abs(dy) * 32768
        if slope < abs(dx) * 13573:
            top = m(y, x) > m(y, x - 1) and m(y, x) >= m(y, x + 1)
        elif slope > abs(dx) * (13573 + 65536):
            top = m(y, x) > m(y - 1, x) and m(y, x) >= m(y + 1, x)
        else:
            s = -1 if (dx < 0) != (dy < 0) else 1
            top = m(y, x) > m(y - 1, x - s) and m(y, x) > m(y + 1, x + s)
        if top and m(y, x) > 50:
            thin.add((y, x))
    kept = {p for p in thin if m(*p) > 150}
    todo = deque(kept)
    while todo:
        y, x = todo.popleft()
        for dy, dx in AROUND:
            q = (y + dy, x + dx)
            if q in thin and q not in kept:
                kept.add(q)
                todo.append(q)
    out = np.zeros((height, width), bool)
    for p in kept:
        out[p] = True
    return out


def test_edges():
    noise = R.integers(0, 256, (6, 13, 17, 3)).astype(np.uint8)
    soft = np.clip(np.cumsum(R.integers(-25, 26, (14, 13, 17, 1)), axis=2) + np.cumsum(R.integers(-25, 26, (14, 13, 17, 1)), axis=1) + 128, 0, 255).astype(np.uint8).repeat(3, -1)
    for stack in (noise, soft):
        got = pixels.traced(stack)
        assert all((g == brute_edges(i)).all() for g, i in zip(got, stack, strict=True))
        assert 0 < got.mean() < 1
    plain = np.full((1, 5, 5, 3), 77, np.uint8)
    assert not pixels.traced(plain).any()


def test_features_of_columns(spark):
    blue = np.zeros((24, 24, 3), np.uint8)
    blue[:, :, 2] = 255
    blue[3:11, 3:11] = blue[15:20, 15:20] = (200, 140, 110)
    rows = [(24, 24, blue.tobytes()), (1, 1, bytes([255, 0, 0])), (1, 1, None), (2, 2, b"x"), (None, 1, b"abc"), (0, 0, b""), (-1, -1, b"abc"), (24, 24, blue.tobytes())]
    df = spark.createDataFrame(rows, "h int, w int, d binary").coalesce(1)
    got = [r["f"] for r in df.select(pixels.image_features(F.col("h"), F.col("w"), F.col("d")).alias("f")).collect()]
    assert got[0] == got[7] and got[1]["sat_mean"] == 1.0 and got[1]["sat_distinct"] == 1 and got[1]["edge_share"] == 0.0 and got[1]["sat255_mean"] == 255.0
    assert all(x is None for k in range(2, 7) for x in got[k])
    assert got[0]["skin_share"] == (64 - 8 + 25 - 8) / 576 and got[0]["skin_largest"] == (49 - 6) / 576 and got[0]["sat_distinct"] == 2
    assert math.isclose(got[0]["edge_share"], brute_edges(blue).mean())
    p = np.array([89, 487]) / 576
    assert math.isclose(got[0]["sat255_entropy"], float(-(p * np.log2(p)).sum()))
    some = df.select(pixels.image_features(F.col("h"), F.col("w"), F.col("d"), ["skin_share"]).alias("f"))
    assert some.schema["f"].dataType.fieldNames() == ["skin_share"] and some.first()["f"]["skin_share"] == got[0]["skin_share"]
    flat = df.select(pixels.image_features(F.col("h"), F.col("w"), F.col("d")).alias("f")).select(exprs.cartoon_by_features(F.col("f.sat255_mean"), F.col("f.edge_share")).alias("c"), exprs.skin_verdict(F.col("f.skin_share"), F.col("f.skin_largest"))["flag"].alias("s")).first()
    assert flat["c"] and not flat["s"]


def test_large_images_are_quick():
    frame = R.integers(0, 256, (1, 540, 960, 3)).astype(np.uint8)
    frame[0, 100:400, 200:700] = (200, 140, 110)
    got = pixels.stack_features(frame)
    assert 0.2 < got["skin_largest"][0] < 0.4


def test_images_are_dealt_to_all_cores(spark, tmp_path):
    """However small the file that they are made from."""
    from reelwright.plans import catalog
    from reelwright.sources import shared

    spark.range(100).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.q49_pixels(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
    rows = shared.dealt(spark.range(1000), "id", 100)
    assert rows.rdd.getNumPartitions() == 10 and rows.distinct().count() == 1000
