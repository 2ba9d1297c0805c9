"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read in windows of WINDOW bytes. In each, one gated recurrent unit runs forwards and one backwards; a softmax over both states
labels every byte, and a document's probabilities are the mean over all its bytes. Training is plain numpy: backpropagation through time
with Adam on a bounded sample of rows. Gates are piecewise linear (clip(x/4 + 1/2, 0, 1), and clip(x, -1, 1) for the candidate state), so
every byte of a large corpus can be read at memory speed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import bounded_sample, held_out

WINDOW = 64
STATES = 8
#: Training rows: about so many, by hash of doc_id, whole texts; windows of a step, and steps.
SAMPLE, BATCH, STEPS = 3000, 256, 240
LANES = 4096
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Net:
    """Weights by direction (0: forwards, 1: backwards): x (3H x 256) of the byte, u (3H x H) of the state; rows: update, reset, candidate."""

    def __init__(self, labels: list[str], hidden: int = STATES, seed: int = 1):
        r = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        g = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {f"x{d}": g(3 * hidden, 256, k=0.3) for d in (0, 1)} | {f"u{d}": g(3 * hidden, hidden, k=0.3) for d in (0, 1)} | {"v": g(len(labels), 2 * hidden, k=0.3), "b": np.zeros((len(labels), 1), np.float32)}

    def _run(self, xs: np.ndarray, d: int, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, H, B) for bytes xs (T, B), and what training needs."""
        H, x, u = self.h, self.p[f"x{d}"], self.p[f"u{d}"]
        T, B = xs.shape
        out, h, tape = np.empty((T, H, B), np.float32), np.zeros((H, B), np.float32), []
        u_gates, u_new = np.ascontiguousarray(u[: 2 * H]), np.ascontiguousarray(u[2 * H :])
        for t in range(T) if d == 0 else range(T - 1, -1, -1):
            a = np.take(x, xs[t], axis=1)
            gates = u_gates @ h
            gates += a[: 2 * H]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates[:H], gates[H:]
            rh = r * h
            c = u_new @ rh
            c += a[2 * H :]
            np.clip(c, -1, 1, out=c)
            if keep:
                tape.append((t, h, gates, c, rh))
            new = c - h
            new *= z
            new += h
            out[t] = h = new
        return out, tape

    def label(self, xs: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, B) of every byte."""
        both = np.concatenate([self._run(xs, 0, False)[0], self._run(xs, 1, False)[0]], 1)
        o = np.matmul(self.p["v"], both)
        o += self.p["b"]
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o

    def gradients(self, xs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross entropy of every byte (weights T x B) against the windows' labels y."""
        H, (T, B) = self.h, xs.shape
        runs = [self._run(xs, d, True) for d in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], 1)
        o = np.matmul(self.p["v"], both) + self.p["b"]
        o -= o.max(1, keepdims=True)
        p = np.exp(o)
        p /= p.sum(1, keepdims=True)
        w = weight / weight.sum()
        loss = -float((np.log(np.maximum(p[:, y, np.arange(B)], 1e-9)) * w).sum())
        p[:, y, np.arange(B)] -= 1
        p *= w[:, None, :]
        g = {"v": np.einsum("tcb,thb->ch", p, both, optimize=True), "b": p.sum((0, 2))[:, None]}
        into = np.matmul(self.p["v"].T, p)
        for d in (0, 1):
            u = self.p[f"u{d}"]
            gu, carry = np.zeros_like(u), np.zeros((H, B), np.float32)
            at = np.zeros((3 * H, T, B), np.float32)
            for t, h, gates, c, rh in reversed(runs[d][1]):
                dh = into[t, d * H : d * H + H] + carry
                z, r = gates[:H], gates[H:]
                dc = dh * z * (np.abs(c) < 1)
                drh = u[2 * H :].T @ dc
                dg = np.concatenate([dh * (c - h), drh * h]) * (0.25 * ((gates > 0) & (gates < 1)))
                gu[: 2 * H] += dg @ h.T
                gu[2 * H :] += dc @ rh.T
                carry = dh * (1 - z) + drh * r + u[: 2 * H].T @ dg
                at[: 2 * H, t], at[2 * H :, t] = dg, dc
            flat = xs.ravel()
            g[f"u{d}"] = gu
            g[f"x{d}"] = np.stack([np.bincount(flat, at[k].ravel(), 256) for k in range(3 * H)]).astype(np.float32)
        return g, loss


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes; the last window is filled up with zeros, which get no weight."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 1) -> Net:
    """A Net from (text, lang) rows; no rows: one that knows no language."""
    rows = [(t, y) for t, y in rows if t and LETTER.search(t)]
    net, r = Net(sorted({y for _, y in rows}), seed=seed), np.random.default_rng(seed)
    if len(net.labels) < 2:
        return net
    xs, ys = [], []
    for t, y in rows:
        xs.append(windows(t.encode("utf-8", "surrogatepass")))
        ys.append(np.full(len(xs[-1]), net.labels.index(y)))
    x, y = np.concatenate(xs), np.concatenate(ys)
    share = np.bincount(y, minlength=len(net.labels))
    odds = np.minimum(1 / share[y], 20 / len(y))  # rare languages are drawn more often
    odds /= odds.sum()
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = r.choice(len(y), BATCH, p=odds)
        xb = np.ascontiguousarray(x[at].T).astype(np.intp)
        g, _ = net.gradients(xb, y[at], (xb > 0).astype(np.float32))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.02 * min(1, step / 10) * (1 - 0.9 * step / steps)
        for k, a in g.items():
            a = a * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Net, texts: list[str]) -> np.ndarray:
    """(texts, labels): each text's mean over all its bytes of the labels' probabilities; zeros for empty texts."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(d) // WINDOW) for d in data])
    sums = np.zeros((int(counts.sum()), len(net.labels)))
    x = np.frombuffer(b"".join(d.ljust(n * WINDOW, b"\0") for d, n in zip(data, counts.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
    real = np.full(len(x), WINDOW)
    ends = np.cumsum(counts)
    for d, n, e in zip(data, counts.tolist(), ends.tolist(), strict=True):
        if n:
            real[e - 1] = len(d) - (n - 1) * WINDOW
    for lo in range(0, len(x), LANES):
        xb = np.ascontiguousarray(x[lo : lo + LANES].T).astype(np.intp)
        p = net.label(xb)
        short = np.flatnonzero(real[lo : lo + LANES] < WINDOW)
        p[:, :, short] *= (np.arange(WINDOW)[:, None] < real[lo : lo + LANES][short])[:, None, :]
        sums[lo : lo + LANES] = p.sum(0).T
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])
    out = total[ends] - total[ends - counts]
    return out / np.maximum([[len(d)] for d in data], 1)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, net: Net) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text; other columns are ignored).

    Texts that are null or have no letter are `und` with score 0, as are all texts if the net knows no language; with one language known,
    its score is 1. Texts of any length are read whole. Repeated rows are rows of their own; an empty table gives an empty result.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [t if t and LETTER.search(t) else "" for t in part.column("text").to_pylist()]
                if len(net.labels) > 1:
                    p = pooled(net, texts)
                    best = p.argmax(1)
                    langs, scores = [net.labels[i] for i in best], p[np.arange(len(best)), best]
                else:
                    langs, scores = (net.labels or [UNKNOWN]) * len(texts), np.full(len(texts), float(len(net.labels)))
                known = [bool(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array([y if k else UNKNOWN for y, k in zip(langs, known, strict=True)], pa.string()), pa.array([min(1.0, float(s)) if k else 0.0 for s, k in zip(scores, known, strict=True)], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(rows, SCHEMA)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Net:
    """Trained on about `sample` rows with a lang that aren't held out, whole texts. Rows with a null lang or text, or without a letter,
    teach nothing; rows that repeat an id count each. Where all labelled rows are held out, or there are none, the net knows no language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = bounded_sample(labelled.select("doc_id", "text", "lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sample, "lang").collect()
    return train(sorted((r["text"], r["lang"]) for r in rows))
