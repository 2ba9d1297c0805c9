"""Quality: a linear-chain conditional random field over a document's lines.

Every line is good or bad. What speaks for either are shares counted in its bytes and words (capitals, symbols, repeated words, ...), and the
same shares of the lines before and after it; a matrix of weights ties neighbouring labels. Forward and backward passes in numpy, over all
documents of a batch line by line, give each line's marginal probability of being good; a document's score is their mean, weighted by the
lines' lengths. Weights are trained by the gradient of the conditional likelihood (Adam, full batch), each line carrying its document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import bounded_sample

#: Training rows of each label: about so many, by hash of doc_id; of a longer one, so many lines in a row, at a place set by its text.
SAMPLE, MOST_LINES = {1: 2500, 0: 2500}, 256
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
#: Bytes, and documents, that are worked on at a time.
SEGMENT, DOCS = 1 << 20, 200
#: The score from which on a document counts as good, and the share of the good ones' weight in training: over that score, so that a text of a
#: few words, which says little for either, is kept.
GOOD, PRIOR = 0.7, 0.75

COUNTS = ("chars", "upper", "letters", "digits", "marks", "symbols", "words", "symbol_ends", "symbol_words", "repeats", "second_repeats")
OWN = 16
#: Own features of the line, the one before and the one after, and whether there is none before or after.
FEATURES = 3 * OWN + 2

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0xC0)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_MARK = np.isin(_BYTE, list(b".,;:?'\"()-"))
_SYMBOL = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~_DIGIT & ~_MARK
_START = (_BYTE & 0xC0) != 0x80  # of a code point
_PLACE = np.random.default_rng(7).integers(1, 1 << 62, 64, np.uint64) | np.uint64(1)


class Lines(NamedTuple):
    """Counts (a row for each line), whether it equals the one before, its first and last byte, and where each document's lines begin."""

    counts: np.ndarray
    same: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray


def count_lines(texts: list[bytes]) -> Lines:
    """Lines end with a line feed or the text. Bytes are counted in segments, so a long text or line needs no more memory at a time."""
    begin = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    total = int(begin[-1])
    counts = {c: np.zeros(total, np.int64) for c in COUNTS}
    digest = np.zeros(total, np.uint64)
    ends = np.append(np.flatnonzero(data == 10), len(data))  # of each line
    starts = np.append(0, ends[:-1] + 1)
    before = (-1, np.uint64(0), np.uint64(0))  # line of the last word, its hash, and that of the word before it in the line
    lo = 0
    while lo < len(data):
        hi = min(lo + SEGMENT, len(data))
        if hi < len(data):  # a segment ends after a space, if it has one
            space = np.flatnonzero(_SPACE[data[hi - 4096 if hi - 4096 > lo else lo : hi]])
            hi = hi - min(4096, hi - lo) + int(space[-1]) + 1 if len(space) else hi
        before = _count_segment(data[lo:hi], int(np.searchsorted(ends, lo)), counts, digest, before)
        lo = hi
    n = np.stack([counts[c] for c in COUNTS], 1)
    same = np.zeros(total, bool)
    same[1:] = (digest[1:] == digest[:-1]) & (n[1:] == n[:-1]).all(1) & (n[1:, 0] > 0)
    same[begin[:-1]] = False
    filled = ends > starts
    first, last = np.zeros(total, np.uint8), np.zeros(total, np.uint8)
    first[filled], last[filled] = data[starts[filled]], data[ends[filled] - 1]
    return Lines(n, same, first, last, begin)


def _count_segment(b: np.ndarray, line: int, counts: dict[str, np.ndarray], digest: np.ndarray, before: tuple) -> tuple:
    feeds = b == 10
    edges = np.append(0, np.flatnonzero(feeds) + 1)
    rows = line + np.arange(len(edges))
    ok = rows < len(digest)

    def add(name: str, flag: np.ndarray) -> None:
        sums = np.append(0, np.cumsum(flag))
        counts[name][rows[ok]] += (sums[np.append(edges[1:], len(b))] - sums[edges])[ok]

    add("chars", _START[b] & ~feeds)
    for name, kind in (("upper", _UPPER), ("letters", _LETTER), ("digits", _DIGIT), ("marks", _MARK), ("symbols", _SYMBOL)):
        add(name, kind[b])
    inside = ~_SPACE[b]
    begins = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if not len(begins):
        return before
    stops = np.flatnonzero(inside & ~np.append(inside[1:], False))
    of = line + np.searchsorted(edges, begins, "right") - 1
    word = np.cumsum(np.bincount(begins, minlength=len(b))) - 1
    place = np.arange(len(b)) - begins[np.maximum(word, 0)]
    code = np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 63], np.uint64(0))
    code = np.add.reduceat(code, begins) + (stops - begins).astype(np.uint64)
    plain = np.append(0, np.cumsum(~_SYMBOL[b]))
    for name, flag in (("words", np.ones(len(begins), bool)), ("symbol_ends", _SYMBOL[b[stops]]), ("symbol_words", plain[stops + 1] == plain[begins]), ("repeats", _again(of, code, before[0], before[1], 1)), ("second_repeats", _again(of, code, before[0], before[2], 2))):
        np.add.at(counts[name], of[flag], 1)
    place_in = np.arange(len(begins)) - np.searchsorted(of, of)
    np.add.at(digest, of, code * _PLACE[place_in & 63])
    one_back = code[-2] if len(code) > 1 and of[-2] == of[-1] else before[1] if len(code) == 1 and before[0] == of[-1] else np.uint64(0)
    return int(of[-1]), code[-1], one_back


def _again(of: np.ndarray, code: np.ndarray, line: int, carried: np.uint64, back: int) -> np.ndarray:
    """Words that equal the one `back` places before in their line."""
    out = np.zeros(len(code), bool)
    out[back:] = (code[back:] == code[:-back]) & (of[back:] == of[:-back])
    if len(code) and line == of[0] and carried and back == 1:  # of the segment before
        out[0] = code[0] == carried
    return out


def features(lines: Lines) -> np.ndarray:
    """FEATURES for each line, all within 0 .. 2."""
    c = dict(zip(COUNTS, lines.counts.T.astype(np.float64), strict=True))
    chars, words, letters = np.maximum(c["chars"], 1), np.maximum(c["words"], 1), np.maximum(c["letters"], 1)
    own = np.stack(
        [np.ones(len(chars)), c["upper"] / letters, np.minimum(1, 4 * c["symbols"] / chars), c["symbol_ends"] / words, c["symbol_words"] / words, c["repeats"] / words, c["second_repeats"] / words,
         c["digits"] / chars, np.minimum(1, 4 * c["marks"] / chars), np.minimum(2, c["letters"] / words / 8), 1 / (1 + c["words"] / 4), np.log1p(c["words"]) / 8, c["words"] == 0, np.isin(lines.last, list(b".?!")), _UPPER[lines.first], lines.same], 1)
    none_before, none_after = np.zeros(len(own), bool), np.zeros(len(own), bool)
    none_before[lines.begin[:-1]] = True
    none_after[lines.begin[1:] - 1] = True
    zero = np.zeros((1, OWN))
    before = np.where(none_before[:, None], 0, np.concatenate([zero, own[:-1]]))
    after = np.where(none_after[:, None], 0, np.concatenate([own[1:], zero]))
    return np.concatenate([own, before, after, none_before[:, None], none_after[:, None]], 1)


class Field(NamedTuple):
    """Weights of the features for each label (bad, good), and of neighbouring labels."""

    emit: np.ndarray
    tie: np.ndarray

    def marginals(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        return _passes(x @ self.emit, self.tie, begin)[0][:, 1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        lines = count_lines(texts)
        good = self.marginals(features(lines), lines.begin)
        weight = lines.counts[:, 0] + 1.0  # a line break counts, too
        return np.clip(np.add.reduceat(good * weight, lines.begin[:-1]) / np.add.reduceat(weight, lines.begin[:-1]), 0, 1)


def _passes(score: np.ndarray, tie: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each line's labels; of each neighbouring pair's, summed over a document, by document; and log partition sums. Documents
    go in step, longest first: at step t those that have a line t."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    start, size = begin[:-1][order], size[order]
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    up, down = np.zeros_like(score), np.zeros_like(score)  # log sums over labels of the lines before, and after
    for t in range(1, steps):
        at = start[: active[t]] + t
        prev = up[at - 1] + score[at - 1]
        up[at] = np.logaddexp(prev[:, :1] + tie[0], prev[:, 1:] + tie[1])
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        following = down[at + 1] + score[at + 1]
        down[at] = np.logaddexp(following[:, :1] + tie[:, 0], following[:, 1:] + tie[:, 1])
    joint = up + score + down
    total = np.logaddexp(joint[:, 0], joint[:, 1])
    node = np.exp(joint - total[:, None])
    pairs = np.zeros((len(begin) - 1, 2, 2))
    left = np.ones(len(score), bool)
    left[begin[1:] - 1] = False  # the last line of a document has no pair
    left = np.flatnonzero(left)
    owner = np.searchsorted(begin, left, "right") - 1
    for i in range(2):
        for j in range(2):
            np.add.at(pairs[:, i, j], owner, np.exp(up[left, i] + score[left, i] + tie[i, j] + score[left + 1, j] + down[left + 1, j] - total[left]))
    return node, pairs, total[begin[:-1]]


def gradients(field: Field, x: np.ndarray, begin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[Field, float]:
    """Of the weighted mean of the documents' negative log likelihoods, each divided by its lines; and that mean."""
    score = x @ field.emit
    node, pairs, total = _passes(score, field.tie, begin)
    size = np.diff(begin)
    share = weight / size
    owner = np.repeat(np.arange(len(size)), size)
    y = labels[owner]
    truth = np.add.reduceat(score[np.arange(len(x)), y], begin[:-1]) + field.tie[labels, labels] * (size - 1)
    err = node.copy()
    err[np.arange(len(x)), y] -= 1
    tie = (pairs * share[:, None, None]).sum(0)
    for k in range(2):
        tie[k, k] -= (share * (size - 1))[labels == k].sum()
    return Field(x.T @ (err * share[owner][:, None]), tie), float(((total - truth) * share).sum())


def train(x: np.ndarray, begin: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """From features of lines and labels of documents. Without documents of both labels, a field that gives the only one (none: good)."""
    if len(labels) == 0 or labels.min() == labels.max():
        emit = np.zeros((FEATURES, 2))
        emit[0, int(labels[0]) if len(labels) else 1] = 40.0
        return Field(emit, np.zeros((2, 2)))
    weight = np.where(labels == 1, PRIOR / labels.sum(), (1 - PRIOR) / (len(labels) - labels.sum()))
    params = [np.zeros((FEATURES, 2)), np.zeros((2, 2))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        grads, _ = gradients(Field(*params), x, begin, labels, weight)
        rate = RATE * (1 - 0.8 * step / steps)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g + RIDGE * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2: rows the field may not learn from. A null id counts as empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Field:
    """Trained on a bounded sample of the labelled rows that aren't held out. Lines are counted in the tasks that hold the texts; what comes
    to the driver are features, of MOST_LINES lines of a document at most. Null labels, ids and texts teach nothing; of rows that repeat an
    id, the one whose text has the least hash does. Without rows of both labels: train()."""
    usable = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    picks = [bounded_sample(usable.filter(F.col("quality") == y), F.col("doc_id"), n, "quality") for y, n in (sample or SAMPLE).items()]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # 2 x 5000 rows of two numbers at most
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lines = count_lines([batch.column("text")[k].as_py().encode()])
                x = features(lines)
                at = int(lines.counts.sum()) % max(1, len(x) - MOST_LINES + 1)
                x = x[at : at + MOST_LINES].astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1).cast(pa.int64()), batch.column("quality").slice(k, 1).cast(pa.int32()), pa.array([x.tobytes()], pa.binary())], ["doc_id", "quality", "x"])

    got = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in rows.mapInArrow(taught, "doc_id long, quality int, x binary").collect())
    blocks = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in got]
    begin = np.cumsum([0, *map(len, blocks)])
    return train(np.concatenate([np.zeros((0, FEATURES)), *blocks]).astype(np.float64), begin, np.array([y for _, y, _ in got], np.int64))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, field: Field, good: float = GOOD) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text; other columns are ignored). A null or empty text is one empty line. Texts and lines of any
    length are read whole, in segments. Repeated rows are rows of their own and score alike; an empty table gives an empty result."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                text = part.column("text")
                p = field.scores([t or b"" for t in text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= good).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(rows, SCHEMA)
