"""
A log-linear scorer over hashed features of a candidate and the words around it, fitted on (text, target) pairs by the
path-marginal loss: log of all paths' weight minus log of the weight of the paths that write the target.

An epoch is one pass of the cluster: partitions return the sum of their gradients (as many numbers as weights), the driver steps.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxscribe.functions import decode
from voxscribe.functions.decode import Candidate
from voxscribe.functions.realize import KINDS, kinds_of
from voxscribe.shipping import ship

SIZE = 1 << 13


def features(text: str, c: Candidate) -> list[int]:
    before = [w.lower() for w in re.findall(r"\w+", text[: c.char_start])[-3:]]
    after = [w.lower() for w in re.findall(r"\w+", text[c.char_end :])[:2]]
    words = min(len(c.text.split()), 12)
    shape = re.sub("[0-9]+", "0", re.sub("[A-Za-z]+", "a", c.replacement))[:12]
    kinds = kinds_of(c.kind_mask)
    names = [f"shape {shape}", f"words {words}"]
    for k in kinds:
        names += [k, f"{k} {words}", *(f"{k} < {w}" for w in before), *(f"{k} << {w}" for w in before[-1:]), *(f"{k} > {w}" for w in after)]
    return [zlib.crc32(x.encode()) % SIZE for x in names]


class LogLinear:
    """A scorer: (text, candidates) → scores."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __call__(self, text: str, cands: list[Candidate]) -> list[float]:
        return [float(self.weights[features(text, c)].sum()) for c in cands]

    def save(self, path: str) -> str:
        """Weights with the kinds they were fitted for and a digest, which load() checks. Returns the digest."""
        body = {"kinds": KINDS, "weights": [round(float(w), 9) for w in self.weights]}
        digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        new, at = f"{path}.new", Path(path)
        with open(new, "w") as f:
            json.dump({**body, "sha256": digest}, f)
            f.flush()
            os.fsync(f.fileno())
        if at.exists():  # the weights before stay beside, and a reader finds one whole file or the other
            before = Path(f"{path}.before")
            before.unlink(missing_ok=True)
            os.link(at, before)
        os.replace(new, at)
        return digest

    @classmethod
    def load(cls, path: str, digest: str | None = None) -> LogLinear:
        saved = json.loads(Path(path).read_text())
        found = hashlib.sha256(json.dumps({k: saved[k] for k in ("kinds", "weights")}, sort_keys=True).encode()).hexdigest()
        if found != saved["sha256"] or digest not in (None, found):
            raise ValueError("the weights don't have their digest")
        if saved["kinds"] != KINDS:
            raise ValueError("the weights are for other kinds")
        return cls(np.array(saved["weights"]))


def _edge_marginals(n_states: int, edges: list[tuple[int, int, int, float]]) -> dict[int, float]:
    """Expected use of each candidate over paths from state 0 to the last; edges (from, to, candidate or -1, score) go forward."""
    out_of: list[list[tuple[int, int, float]]] = [[] for _ in range(n_states)]
    for a, b, k, s in edges:
        out_of[a].append((b, k, s))
    forward, back = [-math.inf] * n_states, [-math.inf] * n_states
    forward[0], back[-1] = 0.0, 0.0
    for a in range(n_states):
        for b, _, s in out_of[a]:
            forward[b] = decode._add_logs(forward[b], forward[a] + s)
    for a in range(n_states - 1, -1, -1):
        for b, _, s in out_of[a]:
            back[a] = decode._add_logs(back[a], back[b] + s)
    use: dict[int, float] = {}
    for a in range(n_states):
        for b, k, s in out_of[a]:
            if k >= 0 and forward[a] > -math.inf and back[b] > -math.inf:
                use[k] = use.get(k, 0.0) + math.exp(forward[a] + s + back[b] - forward[-1])
    return use


def gradient(text: str, target: str, weights: np.ndarray, out: np.ndarray) -> float | None:
    """Adds the loss's gradient of one pair to out; the loss, or null where the target can't be reached."""
    cands = decode.build_candidates(text)
    gold = decode.gold_graph(text, target, cands)
    if gold is None:
        return None
    feats = [features(text, c) for c in cands]
    scores = [float(weights[f].sum()) for f in feats]
    spans = [(c.char_start, c.char_end) for c in cands]
    every = _edge_marginals(len(text) + 1, [(i, i + 1, -1, 0.0) for i in range(len(text))] + [(a, b, k, scores[k]) for k, (a, b) in enumerate(spans)])
    place = {s: i for i, s in enumerate(gold.states)}
    right = _edge_marginals(len(place), [(place[a], place[b], -1, 0.0) for a, b in gold.keep_edges] + [(place[a], place[b], k, scores[k]) for k, a, b in gold.candidate_edges])
    for k, f in enumerate(feats):
        use = every.get(k, 0.0) - right.get(k, 0.0)
        if use:
            np.add.at(out, f, use)
    return decode.log_partition(len(text), spans, scores) - decode.gold_log_partition(gold, scores)


def fit(pairs: DataFrame, epochs: int = 12, rate: float = 0.5, l2: float = 1e-3) -> tuple[LogLinear, list[float]]:
    """pairs: text and expected_text; unreachable targets are left out. Returns the scorer and the mean loss of each epoch."""
    spark = pairs.sparkSession
    ship(spark)
    weights, squares, losses = np.zeros(SIZE), np.full(SIZE, 1e-6), []
    pairs = pairs.select("text", "expected_text").where("text IS NOT NULL AND expected_text IS NOT NULL")
    for _ in range(epochs):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, loss, n = np.zeros(SIZE), 0.0, 0
            for b in batches:
                for text, target in zip(*(c.to_pylist() for c in b.columns)):
                    one = gradient(text, target, sent.value, total)
                    if one is not None:
                        loss, n = loss + one, n + 1
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([loss]), pa.array([n])], ["g", "loss", "n"])

        parts = pairs.mapInArrow(run, "g binary, loss double, n long").collect()  # a row a partition
        n = sum(p["n"] for p in parts)
        if not n:
            break
        g = sum(np.frombuffer(p["g"]) for p in parts) / n + l2 * weights
        squares += g * g
        weights = weights - rate * g / np.sqrt(squares)
        losses.append(sum(p["loss"] for p in parts) / n)
        sent.unpersist()
    return LogLinear(weights), losses
