"""
Document quality by a byte-level convolutional network in numpy.

Learned filters of eight bytes slide over the whole document by two (so the same words give other maxima at odd places than at even ones); each filter's maximum is pooled in chunks that
overlap by half and cover every byte. A hidden layer reads a chunk's maxima and how full it is, so it sees what a chunk holds and what it
lacks (repetition leaves most filters silent); hidden units are combined over all chunks by maximum and mean, and a
logistic unit makes one probability of good quality.

Defined cases: null text counts as empty; an empty text is one chunk of padding; repeated rows and null ids are scored like
others; without labelled rows every score is that of a high bias; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxscribe.llm.common import fold
from voxscribe.llm.fitting import Adam, fitted, labelled_sample, scored, sigmoid

WIDTH = 8
STRIDE = 2
HALF = 128  # bytes; a chunk is two halves


def _bytes(text: str | None) -> np.ndarray:
    """The text's bytes, padded by zeros to whole halves, two at least."""
    b = (text or "").encode()
    size = max(2 * HALF, -(-len(b) // HALF) * HALF)
    return np.frombuffer(b + bytes(size - len(b)), dtype=np.uint8)


def _filled(data: np.ndarray) -> np.ndarray:
    """The share of each chunk that isn't padding."""
    halves = (data.reshape(-1, HALF) != 0).mean(1, dtype=np.float32)
    return (halves[:-1] + halves[1:]) / 2


class ByteCnn:
    def __init__(self, filters: int = 16, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = (0.3 * rng.standard_normal((WIDTH, 256, filters))).astype(np.float32)
        self.table[:, 0] = 0
        self.shift = np.zeros(filters, dtype=np.float32)
        self.dense = (rng.standard_normal((filters + 1, hidden)) / np.sqrt(filters)).astype(np.float32)
        self.dense_shift = np.zeros(hidden, dtype=np.float32)
        self.out = (0.3 * rng.standard_normal(2 * hidden)).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)

    NAMES = ("table", "shift", "dense", "dense_shift", "out", "bias")

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in self.NAMES}

    @classmethod
    def of(cls, a: dict[str, np.ndarray] | None) -> ByteCnn:
        m = cls()
        if a is None:
            m.out[:], m.bias[:] = 0, 4
        else:
            for n in cls.NAMES:
                setattr(m, n, a[n])
        return m

    def prepare(self) -> None:
        """Filters as tables over pairs of bytes: half as many look-ups."""
        self.pairs = [(self.table[o + 1][:, None, :] + self.table[o][None, :, :]).reshape(65536, -1) for o in range(0, WIDTH, 2)]

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Each filter's maximum over the positions that start in each half; data ends with WIDTH spare bytes."""
        pair = data.view("<u2")  # low byte first
        n = (len(data) - WIDTH) // STRIDE
        a = self.pairs[0][pair[:n]]
        for o in range(1, WIDTH // 2):
            a += self.pairs[o][pair[o : o + n]]
        return a.reshape(-1, HALF // STRIDE, a.shape[1]).max(1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 64):
            parts = [_bytes(t) for t in texts[at : at + 64]]
            gap = np.zeros(HALF, dtype=np.uint8)  # so that no window reads two texts
            whole = np.concatenate([*(x for p in parts for x in (p, gap)), np.zeros(WIDTH, dtype=np.uint8)])
            step = 1 << 18
            high = np.concatenate([self.halves(whole[i : min(i + step, len(whole) - WIDTH) + WIDTH]) for i in range(0, len(whole) - WIDTH, step)])
            begin = 0
            for k, p in enumerate(parts):
                h = high[begin : begin + len(p) // HALF]
                begin += len(p) // HALF + 1
                pooled = np.maximum(np.maximum(h[:-1], h[1:]) + self.shift, 0)
                z = pooled @ self.dense[:-1] + _filled(p)[:, None] * self.dense[-1] + self.dense_shift
                z = np.maximum(z, 0)
                out[at + k] = float(np.concatenate([z.max(0), z.mean(0)]) @ self.out + self.bias[0])
        return sigmoid(out)


def train(labels: np.ndarray, texts: list[str], langs: list[str | None], epochs: int = 14, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 5, low_weight: float = 1.0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = ByteCnn(seed=seed)
    data = [np.concatenate([_bytes(t), np.zeros(WIDTH, dtype=np.uint8)]) for t in texts]
    good = max(labels.mean(), 1e-3)
    weight = np.where(labels == 1, 0.5 / good, low_weight * 0.5 / max(1 - good, 1e-3))
    steps = {n: Adam(getattr(model, n), rate) for n in ByteCnn.NAMES}
    per = HALF // STRIDE
    f = model.table.shape[2]
    for epoch in range(epochs):
        for s in steps.values():
            s.rate = rate * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            model.prepare()
            grads = {n: np.zeros_like(getattr(model, n)) for n in ByteCnn.NAMES}
            places, pushes = [], []
            for i in order[at : at + batch]:
                d = data[i]
                pair = d.view("<u2")
                n = (len(d) - WIDTH) // STRIDE
                a = model.pairs[0][pair[:n]]
                for o in range(1, WIDTH // 2):
                    a += model.pairs[o][pair[o : o + n]]
                a = a.reshape(-1, per, f)
                best = a.argmax(1)
                h = np.take_along_axis(a, best[:, None], 1)[:, 0]
                best = best + np.arange(len(h))[:, None] * per
                second = h[1:] > h[:-1]
                top = np.where(second, h[1:], h[:-1]) + model.shift
                where = np.where(second, best[1:], best[:-1])
                pooled = np.column_stack([np.maximum(top, 0), _filled(d[:-WIDTH])])
                z = pooled @ model.dense + model.dense_shift
                r = np.maximum(z, 0)
                k = r.shape[1]
                peak = r.argmax(0)
                feats = np.concatenate([r[peak, np.arange(k)], r.mean(0)])
                delta = float(weight[i] * (sigmoid(feats @ model.out + model.bias[0]) - labels[i])) / batch
                grads["out"] += delta * feats
                grads["bias"] += delta
                back = np.repeat(delta * model.out[None, k:] / len(r), len(r), axis=0)
                back[peak, np.arange(k)] += delta * model.out[:k]
                back *= z > 0
                grads["dense"] += pooled.T @ back
                grads["dense_shift"] += back.sum(0)
                push = (back @ model.dense[:-1].T) * (top > 0)
                grads["shift"] += push.sum(0)
                for o in range(WIDTH):
                    byte = d[where * STRIDE + o].astype(np.int64)
                    places.append(((o * 256 + byte) * f + np.arange(f)).ravel())
                    pushes.append(push.ravel())
            grads["table"] += np.bincount(np.concatenate(places), np.concatenate(pushes), WIDTH * 256 * f).reshape(WIDTH, 256, f).astype(np.float32)
            for n, s in steps.items():
                s.step(grads[n] + decay * s.array)
            model.table[:, 0] = 0  # padding stays silent
    return model.arrays()


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.5, max_rows: int = 4000, max_chars: int = 20_000, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score (1: good) and predicted of every row of docs; carry: the whole row as well, as `row`. Learns from at most max_rows labelled rows outside fold `held`."""
    spark = docs.sparkSession
    model = ByteCnn.of(fitted(labelled_sample(docs, labels, "quality", folds, held, max_rows, max_chars), train))
    sent = spark.sparkContext.broadcast(model.arrays())  # some ten thousand numbers

    def scorer():
        model = ByteCnn.of(sent.value)
        model.prepare()
        return model.scores

    return scored(docs, scorer, carry).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["row"] * carry)
