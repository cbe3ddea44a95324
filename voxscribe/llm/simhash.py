"""
SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within `radius` differing bits are linked; documents reachable by links form a group. Upper levels of the
index are (mask, pattern) nodes: the free bits of a node are cut into radius + 1 runs, and two linked fingerprints agree
on one run at least, so each fingerprint goes below radius + 1 nodes and no link is lost. A node that holds more than
`leaf_rows` fingerprints is cut again, and so on, so no task meets an unbounded group. Inside a node the fingerprints
are sorted by Gray rank, runs of them share masked bit patterns in upper nodes, and whole runs are pruned once the
differences summed on the way down pass the radius.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; equal
fingerprints are one node of the graph, with any number of documents; null ids are grouped like others, and a group whose
ids are all null has a null component_id; repeated rows come out as often as they came in; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxscribe.llm.common import frugal, lasting, ship, written
from voxscribe.llm.components import components

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number: a bit is 1 if set in over half the shingles' hashes, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits as two's complement) of every row."""
    ship(docs.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    rank = fp.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


class GrayIndex:
    """Fingerprints in Gray order below nodes that hold the bits all their members share; `fanout` children a node."""

    def __init__(self, fps: np.ndarray, fanout: int = 8):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.fanout = fanout
        ones, zeros = self.fps, ~self.fps
        self.levels = []
        while len(ones) > 1:
            starts = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones))
        self.levels.reverse()

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in Gray order) of every pair of members within radius, each pair once, the lower place second."""
        n = len(self.fps)
        query = np.arange(n)
        node = np.zeros(n, dtype=np.int64)
        known = np.zeros(n, dtype=np.uint64)
        spent = np.zeros(n, dtype=np.int64)
        for depth, (mask, ones) in enumerate(self.levels):
            if depth:
                query, node, known, spent = self._children(query, node, known, spent, len(mask))
            spent = spent + np.bitwise_count((self.fps[query] ^ ones[node]) & mask[node] & ~known)
            query, node, spent = (x[keep] for keep in [spent <= radius] for x in (query, node, spent))
            known = mask[node]
        if self.levels:
            query, node, known, spent = self._children(query, node, known, spent, n)
        spent = spent + np.bitwise_count((self.fps[query] ^ self.fps[node]) & ~known)
        keep = (spent <= radius) & (node < query)
        return query[keep], node[keep]

    def _children(self, query, node, known, spent, count):
        child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
        query, known, spent = (np.repeat(x, self.fanout) for x in (query, known, spent))
        keep = child < count
        return query[keep], child[keep], known[keep], spent[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that pairs (a, b) reach from it."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    return root


def _runs(free: int, parts: int) -> list[int]:
    """The free bits, from the highest down, cut into runs of near-equal length; each as a mask."""
    bits = [i for i in reversed(range(BITS)) if free >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _below(masks: list[int], radius: int) -> Column:
    """From a node's mask to the masks of its children; the masks of a level are fixed by the radius alone."""
    table = F.create_map(*[F.lit(x) for m in masks for x in (signed(m), [signed(m | r) for r in _runs(~m & (1 << 64) - 1, radius + 1)])])
    return F.explode(F.element_at(table, F.col("mask")))


def below(level: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """level: a long column fp, a column mask (one of `masks`) and columns to carry. The same rows under each child of their node, as mask and pattern, and the children's masks."""
    rows = level.withColumn("mask", _below(masks, radius)).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    children = [m | r for m in masks for r in _runs(~m & (1 << 64) - 1, radius + 1)]
    masks = list(dict.fromkeys(children))
    return rows if len(masks) == len(children) else rows.distinct(), masks  # one child of two nodes


def gathered(rows: DataFrame, sizes: DataFrame, leaf_rows: int) -> DataFrame:
    """The members of each node of `sizes` (mask, pattern, n) as a column `group` of arrays of structs; more than leaf_rows members are dealt out into several."""
    members = [c for c in rows.columns if c not in ("mask", "pattern")]
    block = F.pmod(F.xxhash64(*members), F.ceil(F.col("n") / leaf_rows))
    return rows.join(sizes.hint("merge"), ["mask", "pattern"]).groupBy("mask", "pattern", block.alias("block")).agg(F.collect_list(F.struct(*members)).alias("group")).select("group")


def leaves(level: DataFrame, masks: list[int], radius: int, leaf_rows: int) -> DataFrame:
    """
    The lowest nodes below those of `level` (see below(); no row twice) as a column `group` of arrays of structs: any two words within radius that share the bits of their
    node's mask lie in one group at least, unless more than leaf_rows rows have words too near to be told apart by any cut.
    """
    found = None
    while True:
        rows, masks = below(level, masks, radius)
        free = min(BITS - m.bit_count() for m in masks)
        sizes = written(rows.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        last = free <= leaf_rows.bit_length() - 1  # no node of distinct words can then hold more
        groups = gathered(rows, sizes if last else sizes.where(F.col("n") <= leaf_rows), leaf_rows)
        found = groups if found is None else found.union(groups)
        if last or sizes.where(F.col("n") > leaf_rows).isEmpty():
            return found
        level = written(rows.join(sizes.where(F.col("n") > leaf_rows).hint("merge"), ["mask", "pattern"]).drop("pattern", "n"), "level")


def links(fps: DataFrame, radius: int = 2, leaf_rows: int = 1024) -> DataFrame:
    """fps: distinct values in a long column fp. Returns edges u, v that join the same fingerprints as all links do: in each node of the index a forest of its links, so as many edges as fingerprints at most."""
    ship(fps.sparkSession)

    @frugal
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for group in b.column(0):
                index = GrayIndex(group.values.field("fp").to_numpy().view(np.uint64))
                own = index.fps.view(np.int64)
                root = forest(len(own), *index.links(radius))
                off = root != np.arange(len(own))
                us.append(own[off])
                vs.append(own[root[off]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    whole = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    return leaves(whole, [0], radius, leaf_rows).mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (the least doc_id reachable over links) for every row of docs (doc_id, text)."""
    marks = written(fingerprints(docs, width, seed), "fingerprints")

    def joined() -> DataFrame:
        own = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        found = components(written(links(own, radius), "links"))
        return own.join(found, own.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))

    nodes = lasting("nodes", joined)
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "component").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
