"""
Embedding near-duplicates by a subspace pigeonhole join.

Vectors of one label whose cosine is at least `cosine` are linked. Scaled to length one and rotated, such a pair has a
squared distance of at most 2 - 2 * cosine. The rotated coordinates are split into low-dimensional blocks, each with a
share of that budget in proportion to its dimensions, so a linked pair keeps within the budget of one block at least.
In each block the vectors are range-joined over a grid (cells four budgets' roots wide, so a ball meets few cells), and
the candidates are verified by the exact cosine of the given vectors in double precision. A pair found by several blocks
counts in the first of them alone, which both vectors tell without any exchange.

Equal vectors of a label are one class with a size, so copies aren't expanded. A grid cell with more rows than
`task_rows` is dealt out as pairs of chunks, so no task meets an unbounded group; a task returns sums of links and a
forest of them, never the pairs.

Defined cases: a vector that is null, zero, empty or holds null or non-finite components, or has a null label, links with
nothing: n_links 0, its own component. Vectors of different length never link. Repeated rows are vectors of their own
and link with each other. A null id is a vector like others; it is kept only if its whole component has null ids.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxscribe.llm.common import ship, written
from voxscribe.llm.components import components
from voxscribe.llm.simhash import forest

SLACK = 1e-9


@functools.cache
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, block_dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + block_dims, dim)) for a in range(0, dim, block_dims)]


def block_budgets(dim: int, block_dims: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance that a linked pair may have."""
    return np.array([(b - a) / dim for a, b in block_edges(dim, block_dims)]) * (2 - 2 * cosine) + SLACK


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)) @ rotation(vectors.shape[1], seed)


def _classes(df: DataFrame) -> DataFrame:
    """vec_id, label, and for vectors that take part: class (a digest of label and components) and the components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, packed = [], []
            for label, vector in zip(b.column(1).to_pylist(), b.column(2)):
                x = None if label is None or not vector.is_valid else np.array(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                good = x is not None and len(x) > 0 and vector.values.null_count == 0 and np.isfinite(x).all() and x.any()
                x = (x + 0.0).tobytes() if good else None  # -0.0 becomes 0.0
                packed.append(x)
                names.append(hashlib.md5(f"{label}:".encode() + x).hexdigest() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(packed, pa.binary()), b.column(1)], ["vec_id", "class", "vector", "label"])

    return df.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, class string, vector binary, label string")


def _placed(classes: DataFrame, grid: int, block_dims: int, cosine: float, seed: int) -> DataFrame:
    """A row for each vector, block and cell its ball meets, own cell first (`home`); of two cells the pair is looked for in the greater one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["vector"].str.len()
            for n, part in f.groupby(size):
                dim = int(n) // 8
                x = rotated(np.frombuffer(b"".join(part["vector"]), dtype=np.float64).reshape(-1, dim), seed)
                for k, ((a, b), budget) in enumerate(zip(block_edges(dim, block_dims), block_budgets(dim, block_dims, cosine))):
                    reach = float(np.sqrt(budget))
                    y = x[:, a : min(b, a + grid)] / (4 * reach)
                    home = np.floor(y).astype(np.int64)
                    low, high = np.floor(y - 0.25 - SLACK).astype(np.int64), np.floor(y + 0.25 + SLACK).astype(np.int64)
                    rows, cells = np.arange(len(part)), np.empty((len(part), 0), dtype=np.int64)
                    for j in range(y.shape[1]):  # a ball of a quarter cell meets two cells of an axis at most
                        twice = low[rows, j] < high[rows, j]
                        cells = np.concatenate([np.column_stack([cells, low[rows, j]]), np.column_stack([cells[twice], high[rows[twice], j]])])
                        rows = np.concatenate([rows, rows[twice]])
                    own = home[rows]
                    differs = own != cells
                    first = np.argmax(differs, axis=1)
                    here = ~differs.any(axis=1)
                    up = here | (np.take_along_axis(cells, first[:, None], 1) > np.take_along_axis(own, first[:, None], 1))[:, 0]
                    rows, cells, here = rows[up], cells[up], here[up]
                    out = part.iloc[rows][["class", "label", "vector", "size"]].reset_index(drop=True)
                    out["block"], out["home"], out["dim"] = np.int32(k), here, np.int32(dim)
                    out["cell"] = [",".join(map(str, c)) for c in cells.tolist()]
                    yield out

    return classes.mapInPandas(run, "class string, label string, vector binary, size long, block int, home boolean, dim int, cell string")


def _search(group: pd.DataFrame, block_dims: int, cosine: float, seed: int, tile: int = 1024) -> pd.DataFrame:
    """Links of one cell and block (or of a pair of its chunks): rows (u, v, links), where v is null for a sum of links and else an edge."""
    k, dim = int(group["block"].iloc[0]), int(group["dim"].iloc[0])
    x = np.frombuffer(b"".join(group["vector"]), dtype=np.float64).reshape(-1, dim)
    y = rotated(x, seed)
    edges, budgets = block_edges(dim, block_dims), block_budgets(dim, block_dims, cosine)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    norm = np.sqrt((x * x).sum(axis=1))
    names, sizes = group["class"].to_numpy(), group["size"].to_numpy()
    rank = pd.factorize(names, sort=True)[0]
    index = np.flatnonzero((group["home"] & group["as_index"]).to_numpy())
    probe = np.flatnonzero(group["as_probe"].to_numpy())
    home = group["home"].to_numpy()
    a, b = edges[k]
    index = index[np.argsort(y[index, a], kind="stable")]  # the tiles below then cover short ranges of the first coordinate
    reach = np.sqrt(budgets[k]) + SLACK

    def within(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        d = y[left, edges[n][0] : edges[n][1]] - y[right, edges[n][0] : edges[n][1]]
        return (d * d).sum(1) <= budgets[n]

    counts, us, vs = np.zeros(len(group), dtype=np.int64), [], []
    for i in range(0, len(index), tile):
        left = index[i : i + tile]
        near = probe[(y[probe, a] >= y[left[0], a] - reach) & (y[probe, a] <= y[left[-1], a] + reach)]
        for j in range(0, len(near), tile):
            right = near[j : j + tile]

            def apart(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
                p, q = y[left, edges[n][0] : edges[n][1]], y[right, edges[n][0] : edges[n][1]]
                return (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T

            close = apart(k, left, right) <= budgets[k] + SLACK / 10  # by a sum that rounds; within() decides
            close &= ~home[right][None] | (rank[left][:, None] < rank[right][None])  # within the cell each pair once
            p, q = np.nonzero(close)
            p, q = left[p], right[q]
            for at in range(0, len(p), 1 << 15):
                l, r = p[at : at + (1 << 15)], q[at : at + (1 << 15)]
                keep = (x[l] * x[r]).sum(1) >= cosine * norm[l] * norm[r]
                l, r = l[keep], r[keep]
                for n in range(k + 1):  # the first block within its budget counts the pair
                    keep = within(n, l, r) == (n == k)
                    l, r = l[keep], r[keep]
                np.add.at(counts, l, sizes[r])
                np.add.at(counts, r, sizes[l])
                us.append(l)
                vs.append(r)
    found = np.flatnonzero(counts)
    root = forest(len(group), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(group))
    off = np.flatnonzero(root != np.arange(len(group)))
    return pd.DataFrame({"u": np.concatenate([names[found], names[off]]), "v": np.concatenate([np.full(len(found), None, dtype=object), names[root[off]]]), "links": np.concatenate([counts[found], np.zeros(len(off), dtype=np.int64)])})


def class_links(classes: DataFrame, cosine: float = 0.98, block_dims: int = 8, task_rows: int = 2048, seed: int = 7) -> DataFrame:
    """classes: distinct vectors as class, label, vector (bytes of doubles), size. Returns u, links (a sum of sizes) where v is null, and edges u, v."""
    ship(classes.sparkSession)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    # Axes of the grid: enough that a cell of evenly spread vectors holds some hundred; each cuts a label's vectors about in three.
    grid = max(1, min(block_dims, round(np.log(max(most, 1) / 200) / np.log(3))))
    key = ["label", "dim", "block", "cell"]
    rows = written(_placed(classes, grid, block_dims, cosine, seed), "cells")
    full = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 and homes > 0")
    full = full.select(*key, F.ceil(F.col("n") / task_rows).cast("int").alias("chunks"))
    rows = rows.join(full, key)
    own = F.pmod(F.xxhash64("class"), F.col("chunks"))
    lanes = F.sequence(F.lit(0).cast("long"), F.col("chunks") - F.lit(1).cast("long"))
    # A row is in line `own` of the index and in column `own` of the probes; in the task where both meet it has both parts.
    as_index = rows.where("home").withColumn("i", own).withColumn("j", F.explode(lanes)).withColumn("role", F.lit(1))
    as_probe = rows.withColumn("j", own).withColumn("i", F.explode(lanes)).withColumn("role", F.lit(2))
    dealt = as_index.unionByName(as_probe)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(as_index=group["role"] == 1, as_probe=group["role"] == 2)
        return _search(group, block_dims, cosine, seed)

    return dealt.groupBy(*key, "i", "j").applyInPandas(run, "u string, v string, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, block_dims: int = 8, task_rows: int = 2048, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows = written(_classes(vectors), "vectors")
    sized = rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
    sized = written(sized, "classes")
    found = written(class_links(sized.drop("least"), cosine, block_dims, task_rows, seed), "links")
    sums = found.where("v is null").groupBy("u").agg(F.sum("links").alias("others"))
    joined = components(found.where("v is not null").select("u", "v"))
    nodes = sized.select("class", "size", "least").join(sums, F.col("class") == F.col("u"), "left").drop("u").join(joined, F.col("class") == F.col("node"), "left")
    nodes = written(nodes.select("class", "least", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")), "nodes")
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "component").select("class", "n_links", "component_id")
    linked = rows.where("class is not null").select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
