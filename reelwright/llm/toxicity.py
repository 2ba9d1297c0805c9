"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 6, with boundary marks), hashed into BUCKETS embeddings, so a misspelling shares most of
its vectors with the word it imitates. A passage of PASSAGE words is the average of all its n-grams' embeddings, which a linear softmax
turns into probabilities; a document is as toxic as its worst passage, so length does not dilute it. Embeddings and softmax are trained
jointly in numpy (Adam, full batch), each step through each document's present worst passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import bounded_sample, held_out

BUCKETS, SIZE, PASSAGE = 1 << 16, 8, 4
#: A passage with fewer n-grams is averaged over so many, the missing ones being zero: a lone short word is little evidence.
LEAST = 40
#: Training rows of each label: about so many, by hash of doc_id.
SAMPLE = {1: 1500, 0: 3500}
STEPS = 120
#: Distinct words that a task remembers before it starts afresh.
CACHE = 400_000
WORD = re.compile(r"[^\W_]+")
#: Words, or n-grams, that are worked on at a time.
CHUNK = 1 << 18


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of all words, and where each word's begin; every word has one at least."""
    parts = [_subwords(words[lo : lo + CHUNK // 8]) for lo in range(0, len(words), CHUNK // 8)]
    counts = np.concatenate([n for _, n in parts])
    return np.concatenate([i for i, _ in parts]), np.cumsum(counts) - counts


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids, word by word, and how many each word has."""
    joined = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(w) + 2 for w in words], np.int32)
    ends = np.repeat(np.cumsum(lens, dtype=np.int32), lens)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    ids, of = [], []
    at = np.arange(len(c), dtype=np.int32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, 7):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
        if n >= 3:
            ok = at[: len(h)] + n <= ends[: len(h)]
            x = h[ok] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            ids.append(((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32))
            of.append(owner[: len(h)][ok])
    ids, of = np.concatenate(ids), np.concatenate(of)
    return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def _summed(ids: np.ndarray, by_owner: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Sums by id of each owner's value, an owner having counts entries of ids in a row. Chunk by chunk, so nothing as long as ids is made."""
    out, ends, lo = np.zeros(size), np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK)))
        out += np.bincount(ids[ends[lo] - counts[lo] : ends[hi - 1]], np.repeat(by_owner[lo:hi], counts[lo:hi]), size)
        lo = hi
    return out


class Scorer:
    """logit: of each bucket, its embedding's pull towards label 1 over label 0; bias likewise. The average of a passage's embeddings,
    put through the softmax, is the sigmoid of the average of its buckets' logits."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit, bias
        self._clear()

    def __getstate__(self) -> dict:
        return {"logit": self.logit, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        docs = [WORD.findall(t.lower()) for t in texts]
        if len(self.words) > CACHE:
            self._clear()
        if new := list(dict.fromkeys(w for d in docs for w in d if w not in self.words)):
            ids, starts = subwords(new)
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, np.add.reduceat(self.logit[ids], starts)])
            self.counts = np.concatenate([self.counts, np.diff(np.append(starts, len(ids)))])
        lens = np.array([len(d) for d in docs])
        tokens = np.fromiter((self.words[w] for d in docs for w in d), np.int64, int(lens.sum()))
        best = np.full(len(docs), self.bias)
        if len(tokens):
            starts, owner = passages(lens)
            mean = np.add.reduceat(self.sums[tokens], starts) / np.maximum(np.add.reduceat(self.counts[tokens], starts), LEAST) + self.bias
            first = np.searchsorted(owner, np.flatnonzero(lens))
            best[lens > 0] = np.maximum.reduceat(mean, first)
        return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


def passages(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each passage of each document begins in the joined tokens, and whose it is."""
    per = -(-lens // PASSAGE)
    owner = np.repeat(np.arange(len(lens)), per)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(np.cumsum(lens) - lens, per) + inside * PASSAGE, owner


def train(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 1) -> Scorer:
    """From (text, label) rows. Without rows of both labels, a scorer that gives the only label (none: 0) to all."""
    ys = np.array([y for _, y in rows], np.float64)
    if len(rows) == 0 or ys.min() == ys.max():
        return Scorer(np.zeros(BUCKETS), 40.0 if len(rows) and ys[0] else -40.0)
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, len(words)) for w in WORD.findall(t.lower()) or [" "]], np.int32) for t, _ in rows]
    lens, tokens = np.array([len(d) for d in docs]), np.concatenate(docs)
    del docs
    ids, starts = subwords(list(words))
    counts = np.diff(np.append(starts, len(ids)))
    del words
    begin, owner = passages(lens)
    first = np.searchsorted(owner, np.arange(len(lens)))
    spans = np.diff(np.append(begin, len(tokens)))
    grams = np.maximum(np.add.reduceat(counts[tokens], begin), LEAST)  # of each passage
    r = np.random.default_rng(seed)
    params = [r.uniform(-0.1, 0.1, (BUCKETS, SIZE)), r.standard_normal((2, SIZE)) * 0.3, np.array([1.0, -1.0])]
    weight = np.where(ys == 1, 0.5 / ys.sum(), 0.5 / (len(ys) - ys.sum()))
    data = Rows(tokens, ids, starts, counts, begin, owner, first, spans, grams, ys, weight)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        # Each document's worst passage; in the first steps all of them, as no word stands out yet.
        grads, _ = gradients(params, data, step > steps // 5)
        rate = 0.05 * (1 - 0.8 * step / steps)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    emb, soft, bias = params
    return Scorer(emb @ (soft[1] - soft[0]), float(bias[1] - bias[0]))


class Rows(NamedTuple):
    """Training rows as arrays: words of all documents; n-grams of all words, where each word's begin and how many it has; where passages
    begin, whose they are, each document's first, their lengths in words and n-grams; labels and weights of documents."""

    tokens: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    spans: np.ndarray
    grams: np.ndarray
    ys: np.ndarray
    weight: np.ndarray


def gradients(params: list[np.ndarray], d: Rows, worst: bool) -> tuple[list[np.ndarray], float]:
    """Of the weighted mean cross entropy, by embeddings, softmax and bias; and that loss. worst: each document's worst passage counts,
    else the mean over all of them."""
    emb, soft, bias = params
    dirn = soft[1] - soft[0]
    per_word = np.add.reduceat((emb @ dirn).astype(np.float32)[d.ids], d.starts)
    mean = np.add.reduceat(per_word[d.tokens], d.begin) / d.grams + bias[1] - bias[0]
    top = np.maximum.reduceat(mean, d.first)
    chosen = np.flatnonzero(mean >= top[d.owner]) if worst else np.arange(len(mean))
    of = d.owner[chosen]
    share = d.weight[of] / np.bincount(of, minlength=len(d.ys))[of]
    logit = np.clip(mean[chosen], -40, 40)
    loss = float((np.logaddexp(0, np.where(d.ys[of] == 1, -logit, logit)) * share).sum())
    err = (1 / (1 + np.exp(-logit)) - d.ys[of]) * share
    pull = np.zeros(len(mean))
    pull[chosen] = err / d.grams[chosen]
    on_word = _summed(d.tokens, pull, d.spans, len(d.counts))
    on_gram = _summed(d.ids, on_word, d.counts, BUCKETS)
    toward = on_gram @ emb  # of the loss by the direction: errors times passages' averages
    return [on_gram[:, None] * dirn, np.stack([-toward, toward]), np.array([-err.sum(), err.sum()])], loss


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text; other columns are ignored). A text that is null, empty or without words has the score
    of the softmax's bias alone. Texts of any length are read whole. Repeated rows are rows of their own; an empty table gives an empty
    result."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                p = scorer.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(rows, SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Scorer:
    """Trained on a bounded sample of the labelled rows that aren't held out, whole texts. Null labels, ids and texts teach nothing; of
    rows that repeat an id, the one whose text has the least hash does. Without rows of both labels: train()."""
    usable = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    picks = [bounded_sample(usable.filter(F.col("toxic") == y), F.col("doc_id"), n, "toxic") for y, n in (sample or SAMPLE).items()]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # 2 x 5000 rows of two numbers at most
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return train(sorted((r["text"], r["toxic"]) for r in rows.collect()))


def keep_clean(docs: DataFrame, scorer: Scorer, most: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that score under `most`. Null and empty texts score as the softmax's
    bias alone, which training leaves under 0.5 where clean rows are the rule. An empty table gives an empty one."""

    plain = [f"c{i}" for i in range(len(docs.columns))]  # names that need no quotes
    text = plain[[c.lower() for c in docs.columns].index("text")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array(scorer.scores([t or "" for t in part.column(text).to_pylist()]) < most))

    named = docs.toDF(*plain)
    return named.mapInArrow(rows, named.schema).toDF(*docs.columns)
