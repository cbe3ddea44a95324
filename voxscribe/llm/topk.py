"""
Exact top-k search by inner product with a dual-tree search over cover trees.

Every component x becomes floor(scale * x). Vectors go to blocks around their nearest pivot, each once; large blocks are dealt out further. A
bounded sample gives the pivots and, for each query, a first lower bound of its kth score; a query is sent to the blocks whose
covering radius leaves room for its bound. A block is indexed by a cover tree once, and the queries that reach it, some
thousand at a time, by another: both are searched together, and a pair of nodes is pruned if no vectors within its covering radii can
reach the worst kth score of the query node. The best k of each block are merged at the end. Nothing approximates: the
sample moves rows and bounds only, never the result.

Where vectors spread evenly over many dimensions, no ball but the smallest is far enough from a query to be pruned, so nearly
all pairs are looked at, as one matrix product a group of queries; see the README for figures.

Defined cases: a vector that is null or empty or holds null or non-finite components takes no part, nor does a row without id; scores are
taken between vectors of one length only; rows that share the query's id are its own and no candidates; other repeated
rows are candidates of their own; repeats of a query (id and vector) give one result, different vectors under one id a
result each; scores beyond the range of a long saturate; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from voxscribe.llm.common import frugal, ship, written

EXACT = 2.0**53


class CoverTree:
    """
    A cover tree with its empty levels left out: a node's children are centres more than half its radius apart, which cover its points by balls of half its radius, and every
    point goes to its nearest centre. Members of a node are contiguous in `order`, children of a node contiguous among the nodes.
    """

    def __init__(self, points: np.ndarray, leaf: int = 4):
        n = len(points)
        self.points, self.order = points, np.arange(n)
        self.square = (points * points).sum(1)
        norm = np.sqrt(self.square)
        away = points - points[0]
        start, end, centre = [0], [n], [0]
        radius, longest = [float(np.sqrt((away * away).sum(1).max()))], [float(norm.max())]
        child, children = [0], [0]
        at = 0
        while at < len(start):
            first, last = start[at], end[at]
            if last - first > leaf and radius[at] > 0:
                own = self.order[first:last]
                centres, owner = self._net(own, centre[at], radius[at] / 2)
                if len(centres) > 1:
                    by = np.argsort(owner, kind="stable")
                    own, owner = own[by], owner[by]
                    self.order[first:last] = own
                    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                    away = points[own] - points[centres[owner]]
                    child[at], children[at] = len(start), len(cuts)
                    start += (first + cuts).tolist()
                    end += [*(first + cuts[1:]).tolist(), last]
                    centre += centres[owner[cuts]].tolist()
                    radius += np.sqrt(np.maximum.reduceat((away * away).sum(1), cuts)).tolist()
                    longest += np.maximum.reduceat(norm[own], cuts).tolist()
                    child += [0] * len(cuts)
                    children += [0] * len(cuts)
            at += 1
        self.start, self.end, self.centre, self.child, self.children = (np.array(x) for x in (start, end, centre, child, children))
        self.radius, self.longest = np.array(radius), np.array(longest)

    def _net(self, own: np.ndarray, first: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres among the points `own`, `first` before the others, more than `scale` apart where the distances are exact enough; and for each point its nearest centre's place."""
        x, square = self.points[own], self.square[own]
        squares = lambda rows, at: np.maximum(0, square[rows, None] + self.square[at][None] - 2 * x[rows] @ self.points[at].T)
        centres = [first]
        for low in range(0, len(own), 512):
            rows = np.arange(low, min(low + 512, len(own)))
            nearest = np.full(len(rows), np.inf)
            for k in range(0, len(centres), 4096):
                nearest = np.minimum(nearest, squares(rows, np.array(centres[k : k + 4096])).min(1))
            rows = rows[nearest > scale * scale]
            between = squares(rows, own[rows]) if len(rows) else None
            open_ = np.ones(len(rows), dtype=bool)
            while open_.any():
                new = int(open_.argmax())
                centres.append(int(own[rows[new]]))
                open_ &= between[:, new] > scale * scale
                open_[new] = False
        at = np.array(centres)
        owner = np.empty(len(own), dtype=np.int64)
        for low in range(0, len(own), 512):
            rows = np.arange(low, min(low + 512, len(own)))
            best = np.full(len(rows), np.inf)
            for k in range(0, len(at), 4096):
                d = squares(rows, at[k : k + 4096])
                place = d.argmin(1)
                closer = d[np.arange(len(rows)), place] < best
                best[closer], owner[rows[closer]] = d[np.arange(len(rows)), place][closer], place[closer] + k
        return at, owner

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes, and those of the nodes that have none."""
        inner = self.children[nodes] > 0
        kids = [np.arange(self.child[b], self.child[b] + self.children[b]) for b in nodes[inner].tolist()]
        return np.concatenate([*kids, nodes[~inner]])

    def members(self, nodes: np.ndarray) -> np.ndarray:
        """The places in `order` of all members of nodes."""
        return np.concatenate([np.arange(a, b) for a, b in zip(self.start[nodes].tolist(), self.end[nodes].tolist())])


class DualSearch:
    """The k best of a block's points for groups of queries. looked: bounds and scores taken so far; all: pairs of a query and a point so far."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int, together: int = 64):
        self.x, self.k, self.together = CoverTree(points), k, together
        self.points, self.ids = points[self.x.order], ids[self.x.order]
        self.largest = np.abs(points).max()
        self.looked = self.all = 0

    def __call__(self, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place of the query, scores, ids; floor: a lower bound of each query's kth score."""
        q = self.q = CoverTree(queries)
        self.query_ids, self.queries, self.floor = query_ids[q.order], queries[q.order], floor[q.order].astype(np.float64)
        self.exact = np.abs(queries).max() * self.largest * queries.shape[1] < EXACT
        self.best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in queries]
        self.all += len(queries) * len(self.points)
        some = np.arange(0, len(self.points), max(1, min(16, len(self.points) // 256)))
        self._meet(np.arange(len(queries)), some)  # for first kth scores
        self.best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in queries]
        todo = [(np.array([0]), np.array([0]))]
        while todo:
            a, b = todo.pop()
            most = self._bounds(a, b)
            alive = most >= np.array([self.floor[i:j].min() for i, j in zip(q.start[a].tolist(), q.end[a].tolist())])[:, None]
            self.looked += alive.size
            rows, columns = alive.any(1), alive.any(0)
            if not rows.any():
                continue
            a, b, alive, most = a[rows], b[columns], alive[np.ix_(rows, columns)], most[np.ix_(rows, columns)]
            if len(a) > 1 and alive.mean() < 0.25:  # these query nodes have little in common
                todo += [(a[i : i + 1], b[alive[i]]) for i in range(len(a))]
                continue
            inner_a, inner_b = q.children[a] > 0, self.x.children[b] > 0
            if not inner_a.any() and not inner_b.any():
                self._score(a, b[np.argsort(-most.max(0), kind="stable")])
            elif inner_b.any() and (not inner_a.any() or self.x.radius[b].max() >= q.radius[a].max()):
                if len(b) > 16:  # first those of the highest bounds, which raise the kth scores for the others
                    b = b[np.argsort(-most.max(0), kind="stable")]
                    todo.append((a, b[len(b) // 4 :]))
                    b = b[: len(b) // 4]
                todo.append((a, self.x.below(b)))
            else:
                if (~inner_a).any():
                    todo.append((a[~inner_a], b[alive[~inner_a].any(0)]))
                for i in np.flatnonzero(inner_a).tolist():
                    kids = q.below(a[i : i + 1])
                    inner = q.children[kids] > 0
                    single = kids[~inner]
                    todo += [(single[k : k + self.together], b[alive[i]]) for k in range(0, len(single), self.together)]
                    todo += [(kids[j : j + 1], b[alive[i]]) for j in np.flatnonzero(inner).tolist()]
        return ((int(q.order[i]), scores, ids) for i, (scores, ids) in enumerate(self.best) if len(ids))

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that a member of each query node and one of each point node can score: by centres and radii, by the distance that the balls leave between them, and by lengths."""
        q, x = self.q, self.x
        ca, cb = q.centre[a], x.centre[b]
        dot = q.points[ca] @ x.points[cb].T
        na, nb, ra, rb = np.sqrt(q.square[ca])[:, None], np.sqrt(x.square[cb])[None], q.radius[a][:, None], x.radius[b][None]
        la, lb = q.longest[a][:, None], x.longest[b][None]
        apart = np.sqrt(np.maximum(0, q.square[ca][:, None] + x.square[cb][None] - 2 * dot))
        gap = np.maximum(0, apart * (1 - 1e-6) - 1e-3 * (1 + la + lb) * 1e-3 - ra - rb)
        most = np.minimum(dot + na * rb + ra * nb + ra * rb, np.minimum((la * la + lb * lb - gap * gap) / 2, la * lb))
        return most + 1e-9 * (la * lb + na * nb) + 1e-6

    def _score(self, a: np.ndarray, b: np.ndarray, block: int = 4096) -> None:
        """Scores of all members of query nodes against those of point nodes; the nodes of the highest bounds come first and raise the kth scores."""
        rows = self.q.members(a)
        while len(b):
            sizes = np.cumsum(self.x.end[b] - self.x.start[b])
            some = max(1, int(np.searchsorted(sizes, block)))
            self._meet(rows, self.x.members(b[:some]))
            b = b[some:]
            if len(b):
                worst = np.array([self.floor[i:j].min() for i, j in zip(self.q.start[a].tolist(), self.q.end[a].tolist())])
                b = b[(self._bounds(a, b) >= worst[:, None]).any(0)]

    def _meet(self, rows: np.ndarray, columns: np.ndarray) -> None:
        q, x = self.queries[rows], self.points[columns]
        self.looked += len(q) * len(x)
        if self.exact:
            s = q @ x.T
        else:
            whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object)
            s = np.clip(whole(q).dot(whole(x).T), -(2**63), 2**63 - 1)
        own = self.query_ids[rows, None] == self.ids[None, columns]
        near = (s >= self.floor[rows, None]) & ~own
        for i in np.flatnonzero(near.any(1)).tolist():
            at = np.flatnonzero(near[i])
            scores, ids = self.best[rows[i]]
            scores, ids = np.concatenate([scores, s[i, at]]), np.concatenate([ids, self.ids[columns[at]]])
            keep = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[: self.k]) if not self.exact else np.lexsort((ids, -scores))[: self.k]
            self.best[rows[i]] = scores[keep], ids[keep]
            if len(keep) == self.k:
                self.floor[rows[i]] = max(self.floor[rows[i]], float(scores[keep[-1]]))


def _vectors(df: DataFrame, scale: int, every: int) -> DataFrame:
    """vec_id, vector (bytes of whole doubles), dim and is_query of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = np.floor(scale * np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    packed.append((x + 0.0).tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "vector", "dim"])

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, vector binary, dim int").withColumn("is_query", F.col("vec_id") % every == 0)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice: each pivot is the sample's point farthest from those before; equal points aren't chosen twice."""
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        away = sample - sample[chosen[-1]]
        nearest = np.minimum(nearest, np.sqrt((away * away).sum(1)))
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        chosen.append(far)
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 16, sample_rows: int = 2048, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """
    query_id, rank (int from 1), vec_id and score (long): the k highest scores of every row whose id is divisible by `every`,
    against all other rows, ties to the smaller vec_id. The sample holds at most sample_rows rows of each vector length; a task holds
    about block_rows points and query_rows queries at a time.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(_vectors(vectors, scale, every), "vectors")
    totals = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).collect()}
    found = [_of_one_length(rows.where(F.col("dim") == d), d, n, k, pivots, sample_rows, block_rows, query_rows) for d, (n, q) in sorted(totals.items()) if q]
    best = found[0] if found else spark.createDataFrame([], "query_id long, digest string, vec_id long, score long")
    for more in found[1:]:
        best = best.union(more)
    rank = F.row_number().over(Window.partitionBy("query_id", "digest").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_one_length(rows: DataFrame, dim: int, n: int, k: int, pivots: int, sample_rows: int, block_rows: int, query_rows: int) -> DataFrame:
    spark = rows.sparkSession
    matrix = lambda packed: np.frombuffer(b"".join(packed), dtype=np.float64).reshape(-1, dim)
    # Digests deal the rows evenly, so this limit of the range of digests keeps close to sample_rows; the limit proper makes the bound certain.
    share = min(1.0, 2.0 * sample_rows / n)
    digest = F.xxhash64("vec_id", "vector")
    drawn = rows.where(F.pmod(digest, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows).select("vec_id", "vector").collect()
    sample, sample_ids = matrix([r["vector"] for r in drawn]), np.array([r["vec_id"] for r in drawn], dtype=np.int64)
    around = _pivots(sample, pivots) if len(sample) else np.zeros((1, dim))
    fixed = spark.sparkContext.broadcast((around, sample, sample_ids))  # at most pivots + sample_rows vectors

    @frugal
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around = fixed.value[0]
        for f in frames:
            away = _distances(matrix(f["vector"]), around)
            f["pivot"] = away.argmin(1).astype(np.int32)
            f["away"] = away.min(1)
            yield f

    placed = written(rows.select("vec_id", "vector", "is_query").mapInPandas(place, "vec_id long, vector binary, is_query boolean, pivot int, away double"), "placed")
    block_rows = max(512, min(block_rows, n // 16))
    blocks = {r["pivot"]: (-(-r["n"] // block_rows), r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # a row a pivot
    lanes = F.element_at(F.create_map(*[F.lit(x) for p, (c, _) in blocks.items() for x in (p, c)]), F.col("pivot"))
    none = F.lit(None).cast("double")
    points = placed.select("pivot", F.pmod(F.xxhash64("vec_id", "vector"), lanes).cast("int").alias("lane"), F.lit(False).alias("asks"), "vec_id", "vector", none.alias("floor"))

    @frugal
    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with its bound from the sample, once for every block that may hold something better."""
        around, sample, sample_ids = fixed.value
        for f in frames:
            x = matrix(f["vector"])
            floor = np.full(len(f), -np.inf)
            if len(sample) > k:
                s = x @ sample.T
                s[f["vec_id"].to_numpy()[:, None] == sample_ids[None]] = -np.inf
                floor = np.partition(s, -k, axis=1)[:, -k]
                floor = floor - 1e-9 * np.abs(floor)  # beyond 2 ** 53 scores of the sample are rounded
            norm = np.sqrt((x * x).sum(1))
            for pivot, (count, radius) in blocks.items():
                size = np.sqrt(around[pivot] @ around[pivot]) + radius
                met = x @ around[pivot] + norm * radius + 1e-6 * (1 + norm * size) >= floor
                part = f[met]
                for lane in range(count):
                    yield pd.DataFrame({"pivot": np.int32(pivot), "lane": np.int32(lane), "asks": True, "vec_id": part["vec_id"], "vector": part["vector"], "floor": floor[met]})

    schema = "pivot int, lane int, asks boolean, vec_id long, vector binary, floor double"
    queries = placed.where("is_query").select("vec_id", "vector").distinct().mapInPandas(route, schema)

    @frugal
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's points come before its queries."""
        block, have, ask, index = None, [], [], None

        def answers() -> pd.DataFrame:
            nonlocal index, have
            f = pd.concat(ask)
            if index is None:
                index = DualSearch(matrix(x for g in have for x in g["vector"]), np.concatenate([g["vec_id"].to_numpy() for g in have]), k)
                have = []
            ids, packed = f["vec_id"].to_numpy(), f["vector"].to_numpy()
            out = {"query_id": [], "digest": [], "vec_id": [], "score": []}
            for at, scores, best in index(matrix(packed), ids, f["floor"].to_numpy()):
                out["query_id"] += [ids[at]] * len(best)
                out["digest"] += [hashlib.md5(packed[at]).hexdigest()] * len(best)
                out["vec_id"] += best.tolist()
                out["score"] += [int(s) for s in scores]
            return pd.DataFrame({c: pd.Series(v, dtype="object" if c == "digest" else "int64") for c, v in out.items()})

        for f in frames:
            for key, g in f.groupby(["pivot", "lane", "asks"], sort=False):
                if key[:2] != block:
                    if ask and (have or index):
                        yield answers()
                    block, have, ask, index = key[:2], [], [], None
                if not key[2]:
                    have.append(g)
                    continue
                ask.append(g)
                if sum(map(len, ask)) >= query_rows and (have or index):
                    yield answers()
                    ask = []
        if ask and (have or index):
            yield answers()

    dealt = points.union(queries).repartition("pivot", "lane").sortWithinPartitions("pivot", "lane", "asks")
    return dealt.mapInPandas(search, "query_id long, digest string, vec_id long, score long")
