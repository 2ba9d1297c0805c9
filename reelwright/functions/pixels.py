"""Features of images: saturation, skin, edges. Images of one size are stacked, and numpy works on a whole stack at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: sat_*: of the ratio (greatest - least) / greatest; sat255_*: of the saturation in 0 .. 255; skin_largest, skin_share and edge_share: of the
#: image's pixels.
FEATURES = {"sat_mean": "double", "sat_distinct": "int", "sat255_mean": "double", "sat255_entropy": "double", "skin_share": "double", "skin_largest": "double", "edge_share": "double"}
# Fixed values.
#: (least, greatest) hue in half degrees, saturation and value of the three ranges of skin tones.
SKIN = (((0, 48, 40), (20, 255, 255)), ((0, 30, 20), (15, 200, 200)), ((0, 20, 100), (15, 150, 255)))
#: A round brush of 5 x 5.
BRUSH = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], bool)
#: Gradients (sums of absolute Sobel differences) over the first may belong to an edge, over the second do.
WEAK, STRONG = 50, 150
#: Grey is a weighted sum of red, green and blue, in parts of 2^15.
GREY = (9798, 19235, 3735)
#: Pixels in a stack, about.
STACK = 1 << 21
#: Small images for a task: ten seconds' work, about.
TASK = 25_000


def saturation(rgb: np.ndarray) -> np.ndarray:
    """(greatest - least) / greatest of each pixel's channels, in single precision; 0 for black."""
    c = rgb.astype(np.float32) / np.float32(255)
    high = c.max(-1)
    return (high - c.min(-1)) / np.where(high > 0, high, np.float32(1))


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 .. 179), saturation and value in 0 .. 255: whole numbers, with quotients in parts of 2^12."""
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    high = np.maximum(np.maximum(r, g), b)
    spread = high - np.minimum(np.minimum(r, g), b)
    steps = np.maximum(np.arange(256), 1)
    per_value, per_spread = np.rint((255 << 12) / steps).astype(np.int32), np.rint((180 << 12) / (6 * steps)).astype(np.int32)
    s = (spread * per_value[high] + (1 << 11)) >> 12
    turn = np.where(high == r, g - b, np.where(high == g, b - r + 2 * spread, r - g + 4 * spread))
    h = (turn * per_spread[spread] + (1 << 11)) >> 12
    return np.stack([np.where(h < 0, h + 180, h), s, high], -1)


def _shifted(x: np.ndarray, dy: int, dx: int, fill: object) -> np.ndarray:
    """x of the pixel dy below and dx to the right; fill beyond the image."""
    h, w = x.shape[1:]
    out = np.full_like(x, fill)
    out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = x[:, max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _brushed(mask: np.ndarray, grow: bool) -> np.ndarray:
    """Grown or shrunk by the brush; what is beyond the image changes nothing."""
    out = mask.copy()
    for i, j in np.argwhere(BRUSH) - 2:
        if abs(i) < mask.shape[1] and abs(j) < mask.shape[2]:
            out = out | _shifted(mask, i, j, False) if grow else out & _shifted(mask, i, j, True)
    return out


def skin_masks(colours: np.ndarray) -> np.ndarray:
    """Pixels (of hsv()) in a range of skin tones, after an opening and a closing by the brush."""
    mask = np.zeros(colours.shape[:-1], bool)
    for low, high in SKIN:
        mask |= ((colours >= low) & (colours <= high)).all(-1)
    opened = _brushed(_brushed(mask, False), True)
    return _brushed(_brushed(opened, True), False)


def regions(mask: np.ndarray, corners: bool) -> np.ndarray:
    """The number of each pixel's region of neighbours in its image (corners: those count), -1 outside the mask. Runs of pixels in a row are
    joined to the runs that touch them in the row above: each takes the least number it meets until none changes."""
    n, h, w = mask.shape
    edges = np.diff(np.pad(mask.reshape(n * h, w).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    stop = np.nonzero(edges == -1)[1]
    reach, width = int(corners), w + 2
    above = (row - 1) * width
    # In the row above: the first run that ends after this one's start, and the first that starts after its end.
    lo = np.searchsorted(row * width + stop, above + start - reach, "right")
    hi = np.searchsorted(row * width + start, above + stop + reach, "left")
    touching = np.where(row % h > 0, np.maximum(hi - lo, 0), 0)
    below = np.repeat(np.arange(len(row)), touching)
    upper = np.repeat(lo - (np.cumsum(touching) - touching), touching) + np.arange(touching.sum())
    least = np.arange(len(row))
    while len(below):
        a, b = least[below], least[upper]
        if (a == b).all():
            break
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
    out = np.full(mask.size, -1, np.int64)
    size = stop - start
    out[np.repeat(row * w + start - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(least, size)
    return out.reshape(mask.shape)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: what a walk from beyond the image, not over corners, can't reach."""
    outside = regions(np.pad(~mask, ((0, 0), (1, 1), (1, 1)), constant_values=True), corners=False)
    return (outside != outside[:, :1, :1])[:, 1:-1, 1:-1]


def largest_areas(mask: np.ndarray) -> np.ndarray:
    """Of each image, the greatest area within the outer border of a region (corners count), as the polygon through the middles of the
    border's pixels has: of the squares between four pixels, those with four pixels of the region count whole, those with three half."""
    labels = regions(filled(mask), corners=True)
    squares = np.stack([labels[:, :-1, :-1], labels[:, :-1, 1:], labels[:, 1:, :-1], labels[:, 1:, 1:]])
    label, corners = squares.max(0), (squares >= 0).sum(0)
    area = np.bincount(label[label >= 0], weights=np.maximum(corners - 2, 0)[label >= 0] / 2, minlength=1)
    return np.where(labels >= 0, area[np.minimum(labels, len(area) - 1)], 0).reshape(len(mask), -1).max(1)


def traced(rgb: np.ndarray) -> np.ndarray:
    """Edges: pixels whose gradient is greatest across the edge and over STRONG, or over WEAK and connected to such by others like them."""
    grey = (rgb.astype(np.int32) @ np.array(GREY, np.int32) + (1 << 14)) >> 15
    g = np.pad(grey, ((0, 0), (1, 1), (1, 1)), mode="edge")
    dx = (g[:, :-2, 2:] + 2 * g[:, 1:-1, 2:] + g[:, 2:, 2:]) - (g[:, :-2, :-2] + 2 * g[:, 1:-1, :-2] + g[:, 2:, :-2])
    dy = (g[:, 2:, :-2] + 2 * g[:, 2:, 1:-1] + g[:, 2:, 2:]) - (g[:, :-2, :-2] + 2 * g[:, :-2, 1:-1] + g[:, :-2, 2:])
    m = np.abs(dx) + np.abs(dy)
    at = lambda i, j: _shifted(m, i, j, 0)
    # Directions by the tangents of 22.5 and 67.5 degrees, in parts of 2^15.
    across, up = np.abs(dx).astype(np.int64) * 13573, np.abs(dy).astype(np.int64) << 15
    flat, steep = up < across, up > across + (np.abs(dx).astype(np.int64) << 16)
    falls = (dx ^ dy) < 0
    greatest = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(falls, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))))
    thin = greatest & (m > WEAK)
    labels = regions(thin, corners=True)
    kept = np.zeros(int(labels.max(initial=0)) + 1, bool)
    kept[labels[thin & (m > STRONG)]] = True
    return thin & kept[np.maximum(labels, 0)]


def stack_features(rgb: np.ndarray, only: Sequence[str] = tuple(FEATURES)) -> dict[str, np.ndarray]:
    """The named FEATURES of a stack of images (images x height x width x 3)."""
    n, pixels = len(rgb), rgb.shape[1] * rgb.shape[2]
    out: dict[str, np.ndarray] = {}
    if {"sat_mean", "sat_distinct"} & set(only):
        sat = saturation(rgb).reshape(n, -1)
        out["sat_mean"] = sat.mean(1, dtype=np.float64)
        ordered = np.sort(sat, 1)
        out["sat_distinct"] = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(1)
    if {"sat255_mean", "sat255_entropy", "skin_share", "skin_largest"} & set(only):
        colours = hsv(rgb)
        s = colours[..., 1].reshape(n, -1)
        out["sat255_mean"] = s.mean(1)
        if "sat255_entropy" in only:
            bins = np.minimum(s * 10 // 255, 9) + 10 * np.arange(n)[:, None]
            share = np.bincount(bins.ravel(), minlength=10 * n).reshape(n, 10) / pixels
            out["sat255_entropy"] = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(1)
        if {"skin_share", "skin_largest"} & set(only):
            mask = skin_masks(colours)
            out["skin_share"] = mask.reshape(n, -1).mean(1)
            out["skin_largest"] = largest_areas(mask) / pixels
    if "edge_share" in only:
        out["edge_share"] = traced(rgb).reshape(n, -1).mean(1)
    return {f: out[f] for f in only}


def _table(h: Sequence, w: Sequence, d: Sequence, only: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of features; None where the bytes are not height x width pixels of three."""
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, (height, width, data) in enumerate(zip(h, w, d, strict=True)):
        if data is not None and height and width and height > 0 and width > 0 and height == height and len(data) == height * width * 3:
            sizes.setdefault((int(height), int(width)), []).append(i)
    out = {f: np.full(len(d), None, object) for f in only}
    for (height, width), rows in sizes.items():
        step = max(1, STACK // (height * width))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            stack = np.frombuffer(b"".join(d[i] for i in part), np.uint8).reshape(len(part), height, width, 3)
            for f, values in stack_features(stack, only).items():
                out[f][part] = values.tolist()
    return out


def features(height: int | None, width: int | None, data: bytes | None) -> tuple | None:
    """FEATURES of one image; None where the bytes are others."""
    row = _table([height], [width], [data], tuple(FEATURES))
    values = tuple(v[0] for v in row.values())
    return None if values[0] is None else values


def image_features(height: Column, width: Column, data: Column, only: Sequence[str] = tuple(FEATURES)) -> Column:
    """A struct of the named FEATURES; its fields are null where the bytes don't make an image. Others aren't computed."""
    names = [f for f in FEATURES if f in only]

    @F.pandas_udf(", ".join(f"{f} {FEATURES[f]}" for f in names))
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, w, d in batches:
            table = _table(h.tolist(), w.tolist(), d.tolist(), names)
            yield pd.DataFrame({f: pd.Series(table[f], dtype="Int32" if FEATURES[f] == "int" else "Float64") for f in names})

    return of(height, width, data)
