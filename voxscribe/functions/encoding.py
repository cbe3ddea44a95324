"""
Candidates as the input of a learned scorer: encoder tokens under each span, padded batches, pooled features and the scoring head, in numpy.

An encoder is any function from a text to token ids and their character offsets; vectors of tokens come from the caller. No weights come with the engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np

from voxscribe.functions.decode import Candidate
from voxscribe.functions.realize import KINDS

LONGEST = 512  # tokens of a sentence that an encoder takes

Tokenizer = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


class Encoded(NamedTuple):
    """A sentence's token ids, and for each candidate its tokens (first, end) and the ids of its replacement."""

    ids: list[int]
    spans: list[tuple[int, int]]
    replacements: list[list[int]]


class Batch(NamedTuple):
    """Sentences padded to one length, candidates of all sentences one after another; those of sentence i are offsets[i] to offsets[i + 1]."""

    ids: np.ndarray
    mask: np.ndarray
    sentence: np.ndarray
    spans: np.ndarray
    kinds: np.ndarray
    replacement_ids: np.ndarray
    replacement_mask: np.ndarray
    offsets: list[int]


def aligned(start: int, end: int, offsets: Sequence[tuple[int, int]]) -> tuple[int, int]:
    """The tokens (first, end) that overlap characters start to end; they must cover them all."""
    hit = [i for i, (a, b) in enumerate(offsets) if a < end and b > start]
    if not hit or offsets[hit[0]][0] > start or offsets[hit[-1]][1] < end:
        raise ValueError(f"no tokens cover characters {start} to {end}")
    return hit[0], hit[-1] + 1


def encode(text: str, cands: Sequence[Candidate], sentence: Tokenizer, replacement: Tokenizer) -> Encoded:
    """sentence: the encoder's tokens with its special ones (of no characters); replacement: without them."""
    ids, offsets = sentence(text)
    if len(ids) > LONGEST:
        raise ValueError(f"{len(ids)} tokens, over the limit of {LONGEST}")
    return Encoded(ids, [aligned(c.char_start, c.char_end, offsets) for c in cands], [replacement(c.replacement)[0] for c in cands])


def kind_flags(cands: Sequence[Candidate]) -> np.ndarray:
    """A row a candidate, a column a kind: 1 where the candidate has it."""
    masks = np.array([c.kind_mask for c in cands], dtype=np.int64).reshape(-1, 1)
    return (masks >> np.arange(len(KINDS)) & 1).astype(np.float32)


def _padded(rows: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, rows), default=0)
    out, mask = np.full((len(rows), width), pad, dtype=np.int64), np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)], mask[i, : len(r)] = r, 1
    return out, mask


def collate(examples: Sequence[tuple[Encoded, Sequence[Candidate]]], pad: int) -> Batch:
    """One batch of sentences with their candidates. An empty batch, counts that don't match, empty spans or replacements, and candidates that no feature tells apart raise."""
    if not examples:
        raise ValueError("a batch needs a sentence")
    for encoded, cands in examples:
        if not len(encoded.spans) == len(encoded.replacements) == len(cands):
            raise ValueError("spans, replacements and candidates differ in number")
        seen: dict[tuple, str] = {}
        for (a, b), ids, c in zip(encoded.spans, encoded.replacements, cands):
            if not 0 <= a < b <= len(encoded.ids):
                raise ValueError("a candidate's tokens are empty or outside the sentence")
            if not ids:
                raise ValueError("a replacement has no token")
            if seen.setdefault((a, b, c.kind_mask, tuple(ids)), c.replacement) != c.replacement:
                raise ValueError(f"nothing tells {c.replacement!r} from another candidate")
    counts = [len(c) for _, c in examples]
    spans = [s for e, _ in examples for s in e.spans]
    ids, mask = _padded([e.ids for e, _ in examples], pad)
    replaced, replaced_mask = _padded([r for e, _ in examples for r in e.replacements], pad)
    every = [c for _, cands in examples for c in cands]
    return Batch(ids, mask, np.repeat(np.arange(len(examples)), counts), np.array(spans, dtype=np.int64).reshape(-1, 2), kind_flags(every), replaced, replaced_mask, [0, *np.cumsum(counts).tolist()])


def pooled_spans(vectors: np.ndarray, sentence: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """First, last and mean vector of each span's tokens; means by sums over prefixes. vectors: sentence, token, dimension."""
    if not len(spans):
        return np.empty((0, 3 * vectors.shape[2]), dtype=vectors.dtype)
    first, end = spans[:, 0], spans[:, 1]
    sums = np.concatenate([np.zeros_like(vectors[:, :1]), vectors.cumsum(1)], axis=1)
    mean = (sums[sentence, end] - sums[sentence, first]) / (end - first)[:, None]
    return np.concatenate([vectors[sentence, first], vectors[sentence, end - 1], mean], axis=1)


def pooled_replacements(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """First, last and mean vector of each replacement's tokens; padding doesn't count."""
    if not len(vectors):
        return np.empty((0, 3 * vectors.shape[2]), dtype=vectors.dtype)
    sizes = mask.sum(1)
    mean = (vectors * mask[:, :, None]).sum(1) / sizes[:, None]
    return np.concatenate([vectors[:, 0], vectors[np.arange(len(vectors)), sizes - 1], mean], axis=1)


class Head:
    """Kinds projected, joined with pooled spans and replacements, one hidden layer with the Gaussian error unit, one score a candidate."""

    def __init__(self, dims: int, kind_dims: int = 32, hidden: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        wide = 6 * dims + kind_dims
        self.kinds = rng.standard_normal((len(KINDS), kind_dims)) / math.sqrt(len(KINDS))
        self.inner, self.inner_shift = rng.standard_normal((wide, hidden)) / math.sqrt(wide), np.zeros(hidden)
        self.outer, self.outer_shift = rng.standard_normal(hidden) / math.sqrt(hidden), 0.0

    def __call__(self, batch: Batch, tokens: np.ndarray, replacements: np.ndarray) -> np.ndarray:
        """tokens: vectors of the padded sentences; replacements: of the padded replacements."""
        x = np.concatenate([pooled_spans(tokens, batch.sentence, batch.spans), batch.kinds @ self.kinds, pooled_replacements(replacements, batch.replacement_mask)], axis=1)
        z = x @ self.inner + self.inner_shift
        erf = np.vectorize(math.erf, otypes=[float])
        gelu = z * (1 + erf(z / math.sqrt(2))) / 2 if len(z) else z
        return gelu @ self.outer + self.outer_shift
