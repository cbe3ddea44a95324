"""
Packing documents into sequences by cutting-stock column generation.

A document's token ids and one end id are cut into pieces of the full sequence length and a rest. Pieces are counted in a
histogram of lengths in units of `unit` tokens (a bounded table, whatever the corpus). A linear program over patterns
(which lengths share a sequence) is solved by column generation: a revised simplex holds the basis, a knapsack dynamic
program prices new patterns with the duals. Counts of patterns are rounded down and what is left, a few pieces a pattern
at most, is packed by best fit decreasing. Each pattern then owns a range of ranks in every length it uses, pieces are
ranked within their length (in cells, so that a length that a third of all pieces share is no one task), and rank gives sequence and slot.

Defined cases: null text counts as empty; an empty text is one piece of the end id; repeated rows and null ids are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxscribe.llm.common import id_text, ship, written

#: Letters of these ranges, ASCII and nothing else: here both libraries split and merge alike, and the ranks file is the faster one.
PLAIN = re.compile(r"[\x00-\x7eÀ-ÖØ-öø-ÿ]*")
MARK = "<|endoftext|>"


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _ranks(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> list[int]:
    """Ids by the vocabulary file `tokenizer`. `ranks` with `pattern`, the same vocabulary as ranks, gives the same ids sooner for plain texts."""
    text = text or ""
    if ranks and MARK not in text and PLAIN.fullmatch(text):
        return _ranks(ranks, pattern).encode_ordinary(text)
    return _tokenizer(tokenizer).encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; with_ids: its ids as well (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_ids(text.as_py(), tokenizer, ranks, pattern)
                ids.append(end_id)
                packed = np.array(ids, dtype="<u4").tobytes()
                for start in range(0, len(ids), size):
                    part = packed[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), len(ids), part if with_ids else None)):
                        column.append(value)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)][: 5 + with_ids], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within capacity, by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            worth = values[:fits] + best[c - sizes[:fits]]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], last[c] = worth[i], i
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), counts


def cut_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 8000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """
    sizes ascending and distinct, demand positive. Solves the linear program over patterns (each size covered at least as
    often as demanded) until the duals' bound proves it within `gap` of the best, or for `rounds` pivots; any stop leaves a
    feasible basis. A size with a negative dual gets its surplus column; new patterns are priced at a mean of the basis's
    duals and the best duals so far, which start at each size's share of the capacity (Wentges smoothing).
    Returns patterns (a row each, counts by size) and how often each is used, fractional; a surplus is a pattern of zeros.
    """
    basis = np.diag(capacity // sizes).astype(np.float64)  # a column a pattern
    cost = np.ones(len(sizes))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    centre = sizes / capacity
    bound = float(centre @ demand)
    for _ in range(rounds):
        if cost @ x <= bound * (1 + gap):
            break
        duals = cost @ inverse
        least = int(duals.argmin())
        if duals[least] < -1e-9:
            column, price = np.zeros(len(sizes)), 0.0
            column[least] = -1
        else:
            price = 1.0
            for keep in (0.8, 0.4, 0.0):
                at = np.maximum(keep * centre + (1 - keep) * duals, 0)
                value, column = best_pattern(at, sizes, capacity)
                proven = float(at @ demand) / max(value, 1.0)
                if proven > bound:
                    bound, centre = proven, at / max(value, 1.0)
                if duals @ column > 1 + 1e-7:
                    break
            else:
                break
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, x / move, np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        basis[:, out], cost[out] = column, price
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
    return np.maximum(basis.T, 0).astype(np.int64), x


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size → how many in a sequence) with how many sequences use them; together they hold exactly the counted pieces."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = []
    if len(sizes):
        patterns, used = cut_stock(sizes, left.astype(np.float64), capacity)
        for p, n in zip(patterns, np.floor(used + 1e-6).astype(np.int64)):
            n = min([int(n), *(left[p > 0] // p[p > 0]).tolist()])
            if n > 0 and p.any():
                out.append(({int(s): int(k) for s, k in zip(sizes, p) if k}, n))
                left -= n * p
    rest: Counter = Counter()
    left_of = dict(zip(sizes.tolist(), left.tolist()))
    while any(left_of.values()):  # best fit decreasing: a sequence at a time takes the largest that fits
        room, taken = capacity, Counter()
        for s in sorted(left_of, reverse=True):
            k = min(left_of[s], room // s)
            if k:
                taken[s], left_of[s], room = k, left_of[s] - k, room - k * s
        rest[tuple(sorted(taken.items()))] += 1
    return out + [(dict(p), n) for p, n in rest.items()]


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, size: int = 2048, end_id: int = 1, unit: int = 8, cell_pieces: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (tokens before the piece in its sequence) of every piece; with_ids: its ids as well."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, ranks, pattern, size, end_id, with_ids), "pieces").withColumn("bin", F.ceil(F.col("length") / unit).cast("int"))
    counts = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # size / unit rows at most
    patterns = plan(counts, -(-size // unit))
    ranges, base, begun = [], 0, Counter()
    for p, times in patterns:
        slot = 0
        for b, k in sorted(p.items(), reverse=True):
            ranges.append((b, begun[b], begun[b] + times * k, k, base, slot))
            begun[b] += times * k
            slot += k
        base += times
    ranges = spark.createDataFrame(ranges or [(0, 0, 0, 1, 0, 0)], "bin int, low long, high long, each long, base long, slot long")
    # Cells of a length: shards by the square root, so that no prefix sum is long.
    shards = {b: max(1, round((n / cell_pieces) ** 0.5)) for b, n in counts.items()} or {0: 1}
    parts = F.element_at(F.create_map(*[F.lit(x) for item in shards.items() for x in item]), F.col("bin"))
    digest = F.xxhash64(id_text(), "start", "ids_crc32")
    cut = cut.withColumn("shard", F.pmod(digest, parts)).withColumn("cell", F.pmod(F.shiftright(digest, 32), parts))
    cells = cut.groupBy("bin", "shard", "cell").agg(F.count("*").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    above = cells.groupBy("bin", "shard").agg(F.sum("n").alias("m")).withColumn("first", F.coalesce(F.sum("m").over(before("bin", "shard")), F.lit(0)))
    cells = cells.withColumn("within", F.coalesce(F.sum("n").over(before("bin", "shard", "cell")), F.lit(0)))
    cells = written(cells.join(above, ["bin", "shard"]).select("bin", "shard", "cell", (F.col("first") + F.col("within")).alias("first")), "ranks")
    own = Window.partitionBy("bin", "shard", "cell").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    ranked = cut.join(cells, ["bin", "shard", "cell"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    ranges = F.broadcast(ranges)  # patterns times the lengths in one: thousands of rows at most
    placed = ranked.join(ranges, "bin").where("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - low) div each")).withColumn("slot", F.col("slot") + (F.col("rank") - F.col("low")) % F.col("each"))
    sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("length").over(sequence) - F.col("length"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
