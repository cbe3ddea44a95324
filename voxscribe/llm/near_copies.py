"""
Near copies by the similarity of word shingles: candidates from SimHash words in the Gray-order index, each link verified on the texts.

Two documents are linked if their sets of shingles (`width` words, A-Z in lower case) have a Jaccard similarity of `similar` at least. One SimHash of 64 bits
differs in about ten bits at 0.8, too many for an index to search; so a document's shingles are dealt by their hash into
SLICES slices, each with a SimHash word of WORD bits, and documents are candidates if one of these words is within two bits and
their whole fingerprints are within NEAR bits. A slice of a near copy is often untouched by its edits, else it is as near as the
documents are. Documents of one shingle set are found by a digest and searched as one.

Every candidate is verified by its exact similarity. The first few slices go first, and documents that their links join are no candidates
of each other in the others; in a node of the index only a spanning forest of the nearest candidates and each document's nearest one
are taken. So a large group of copies costs a few comparisons a document, not all its pairs.

Pairs that are among the candidates of no slice are met by an exact pass over prefixes (`bridges`): in one order of all shingles, two similar sets share one among the first fifth of each. Only
shingles that documents of different components have there make candidates, so large groups that the index joined cost nothing more; how many shingles two sizes must share bounds how late a shared one
may come, and parity bits bound from below how many they don't share. So no link between components
is lost (shingles are told apart by 64 bits of hash). Fewer than `width` words are one shingle, no words none; documents without words form one group.

Defined cases: null text counts as empty; rows are told apart by the number that one_of_each gives them, so null and repeated ids lose nothing;
repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxscribe.llm.common import frugal, lasting, ship, written
from voxscribe.llm.components import components
from voxscribe.llm.lm import mixed
from voxscribe.llm.simhash import GrayIndex, below, gathered, leaves, signed

SLICES = 16
STEPS = (0, 3, SLICES)  # slices that are searched together; what the first ones link needs no candidates in the others
WORD = 28
NEAR = 16  # of 64 bits; at a similarity of 0.8 a pair differs in ten on average, rarely in more than sixteen
PARITY = ("p0", "p1", "p2", "p3")  # 64 parity bits each
UPPER = (1 << 64) - (1 << WORD)  # the bits of a slice's word that name the slice


def shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _majority(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind: str) -> np.ndarray:
    """For each run of rows the word whose bits are set in over half of them."""
    ones = np.add.reduceat(np.unpackbits(bits.astype(kind)[:, None].view(np.uint8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(kind).ravel().astype(np.uint64)


def parities(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Words of 64 bits for each set of hashes (bounds: where each begins): a bit tells whether the number of the set's hashes that fall on it is odd."""
    bit = mixed(h + np.uint64(3)) % np.uint64(64 * len(PARITY))
    some, mask = np.flatnonzero(np.diff(bounds)), np.uint64(1) << bit % np.uint64(64)
    out = [np.zeros(len(bounds) - 1, dtype=np.uint64) for _ in PARITY]
    for k, words in enumerate(out):
        if len(h):
            words[some] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, mask, np.uint64(0)), bounds[some])
    return [words.view(np.int64) for words in out]


class Sketcher:
    """Digests, fingerprints and slices' words of texts; keeps hashes of words for the next texts."""

    def __init__(self, width: int):
        self.width, self.hash = width, {}

    def hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of each text's distinct shingles, text by text in rising order; the text of each; where each text's begin."""
        docs = [(t or "").encode().lower().split() for t in texts]
        if len(self.hash) > 300_000:
            self.hash.clear()
        for w in {w for d in docs for w in d} - self.hash.keys():
            self.hash[w] = xxhash.xxh64_intdigest(w)
        lengths = np.array([len(d) for d in docs])
        counts = np.where(lengths > 0, np.maximum(lengths - self.width + 1, 1), 0)
        pad = [0] * (self.width - 1)
        flat = np.array([x for d in docs for x in (*map(self.hash.__getitem__, d), *pad)], dtype=np.uint64)
        firsts = np.cumsum(lengths + self.width - 1) - (lengths + self.width - 1)
        owner = np.repeat(np.arange(len(docs)), counts)
        at = firsts[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(self.width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[at + j]
        h = mixed(h)
        by = np.lexsort((h, owner))
        h, owner = h[by], owner[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
        h, owner = h[new], owner[new]
        return h, owner, np.searchsorted(owner, np.arange(len(docs) + 1))

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
        h, owner, bounds = self.hashes(texts)
        digests = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        marks, words = np.zeros(len(texts), dtype=np.uint64), [np.empty(0, dtype=np.int64)] * len(texts)
        if len(h):
            some = np.flatnonzero(np.diff(bounds))
            marks[some] = _majority(mixed(h + np.uint64(1)), bounds[some], np.diff(bounds)[some], "<u8")
            scrambled = mixed(h + np.uint64(2))
            part = owner * SLICES + ((scrambled >> np.uint64(32)) * np.uint64(SLICES) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.diff(part[by], prepend=-1))
            sizes = np.diff(np.append(starts, len(part)))
            parts = part[by][starts]
            word = _majority(scrambled[by] & np.uint64(2**WORD - 1), starts, sizes, "<u4") | (parts % SLICES).astype(np.uint64) << np.uint64(WORD)
            cuts = np.searchsorted(parts, np.arange(len(texts) + 1) * SLICES)
            words = [word[a:b].view(np.int64) for a, b in zip(cuts, cuts[1:])]
        return digests, marks, words


def sketches(rows: DataFrame, width: int, chars: int = 2_000_000) -> DataFrame:
    """id, digest (of the set of shingles), mark (the whole fingerprint) and words (a slice's word each) for every row of rows (id, text)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width)
        ids, texts, size = [], [], 0

        def out():
            digests, marks, words = sketcher(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks.view(np.int64)), pa.array(words, pa.list_(pa.int64()))], ["id", "digest", "mark", "words"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > chars:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    return rows.select("id", "text").mapInArrow(run, "id long, digest binary, mark long, words array<long>")


def nearest_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (a, b) make a spanning forest of the least distances."""
    root, kept, left = list(range(n)), [], n - 1
    for k in np.argsort(d, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y] = x
            kept.append(k)
            left -= 1
            if not left:
                break
    return np.array(kept, dtype=np.int64)


def nearest_few(a: np.ndarray, b: np.ndarray, d: np.ndarray, few: int = 1) -> np.ndarray:
    """Which of the pairs (a, b) are among the `few` nearest of one of their ends."""
    end, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    by = np.lexsort((pair, d[pair], end))
    first = np.concatenate([[True], np.diff(end[by]) != 0])[: len(by)]
    place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0)) if len(by) else by
    return np.unique(pair[by][place < few])


MEMBER = ("fp", "id", "mark", "own")


def _pairs(fp: np.ndarray, ids: np.ndarray, marks: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """u, v and d of a group's spanning forest of nearest candidates and of each document's nearest few; documents of one component (own) are no candidates any more."""
    index = GrayIndex(fp.view(np.uint64))
    x, y = (index.order[k] for k in index.links(radius))
    d = np.bitwise_count((marks[x] ^ marks[y]).view(np.uint64))
    near = (d <= NEAR) & (own[x] != own[y])
    x, y, d = x[near], y[near], d[near]
    kept = np.union1d(nearest_forest(x, y, d, len(fp)), nearest_few(x, y, d))
    x, y = ids[x[kept]], ids[y[kept]]
    return np.minimum(x, y), np.maximum(x, y), d[kept].astype(np.int32)


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["u", "v", "d"])


def candidates(marked: DataFrame, radius: int = 2, leaf_rows: int = 512) -> DataFrame:
    """
    marked: id, mark, own (its component so far) and words, no id twice. u, v and d (bits in which their fingerprints differ) of pairs: in each node of the index a spanning forest of its nearest
    candidates, and the few nearest of each document besides, since a forest's pair may fail the exact test that another passes. A node of more than leaf_rows members is
    cut again, except for the members of crowded words, which no cut parts; and all its members meet along the Gray order of their whole fingerprints, turned by another number of bits in each slice.
    """
    words = written(marked.select("id", "mark", "own", F.explode("words").alias("fp")), "words")
    rows, masks = below(words.withColumn("mask", F.lit(signed(UPPER))), [UPPER], radius)
    sizes = written(rows.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    crowded = F.col("n") > leaf_rows

    @frugal
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_pairs(*(group.values.field(name).to_numpy() for name in MEMBER), radius) for group in b.column(0)]
            if found:
                yield _batch(found)

    @frugal
    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of leaf_rows members of a node, each half over the one before."""
        key, held = None, [np.empty(0, dtype=np.int64)] * len(MEMBER)
        for b in batches:
            node = np.stack([b.column(k).to_numpy() for k in (0, 1)])
            cuts = [0, *(np.flatnonzero((node[:, 1:] != node[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                part = [b.column(k).to_numpy()[first:last] for k in range(2, 2 + len(MEMBER))]
                now = tuple(node[:, first].tolist())
                if now != key:
                    if len(held[0]) > 1:
                        yield _batch([_pairs(*held, radius)])
                    key, held = now, part
                else:
                    held = [np.concatenate(x) for x in zip(held, part)]
                while len(held[0]) > leaf_rows:
                    yield _batch([_pairs(*(x[:leaf_rows] for x in held), radius)])
                    held = [x[leaf_rows // 2 :] for x in held]
        if len(held[0]) > 1:
            yield _batch([_pairs(*held, radius)])

    schema = "u long, v long, d int"
    small = gathered(rows, sizes.where(~crowded), leaf_rows).mapInArrow(search, schema)
    found = small
    if not sizes.where(crowded).isEmpty():
        members = rows.join(sizes.where(crowded).hint("merge"), ["mask", "pattern"]).drop("n")
        turn = F.pmod(F.shiftrightunsigned("fp", WORD) * 23, F.lit(64)).cast("int").alias("turn")
        rank = F.expr("shiftleft(mark, turn) | shiftrightunsigned(mark, 64 - turn)")
        members = written(members.select("mask", "pattern", *MEMBER, turn).withColumn("rank", rank).drop("turn"), "members")
        for by in (1, 2, 4, 8, 16, 32):
            members = members.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", by)))
        order = ("mask", "pattern", "rank", "id")
        found = found.union(members.repartitionByRange(*order).sortWithinPartitions(*order).select("mask", "pattern", *MEMBER).mapInArrow(along, schema))
        heavy = words.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows // 2).select("fp")
        light = written(members.join(heavy.hint("merge"), "fp", "left_anti").select(*MEMBER, "mask"), "light")
        found = found.union(leaves(light, masks, radius, leaf_rows).mapInArrow(search, schema))
    return found.groupBy("u", "v").agg(F.min("d").alias("d"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """The pairs (u, v) whose texts (id, text) have shingle sets of that similarity."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, before, own = [], None, None
            for u, x, y in zip(b.column(0), b.column(2), b.column(3)):
                if u != before:
                    before, own = u, shingles(x.as_py(), width)
                keep.append(jaccard(own, shingles(y.as_py(), width)) >= similar)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda end, name: texts.select(F.col("id").alias(end), F.col("text").alias(name))
    both = pairs.select("u", "v").join(of("v", "y"), "v").join(of("u", "x"), "u")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def common(rows: DataFrame, width: int, one_in: int = 8, least: int = 3, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (rising) of shingles that many rows have, and how many in a sample of the rows have them, at most `most` of the commonest. They only order the shingles of bridges(): any other list gives the same links, at another cost."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width)
        for b in batches:
            h, _, _ = sketcher.hashes(b.column(0).to_pylist())
            own, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["h", "n"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "h long, n long")
    counts = written(some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "common")
    room = 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("of")).collect(), key=lambda r: -r["n"]):  # a row a count
        room += r["of"]
        if room > most:
            least = r["n"] + 1
            break
    got = counts.where(F.col("n") >= least).toArrow()
    h = got.column("h").to_numpy().view(np.uint64)
    by = np.argsort(h)
    return h[by], got.column("n").to_numpy()[by]


def bridges(rows: DataFrame, width: int, similar: float, chars: int = 2_000_000, crowd: int = 64) -> DataFrame:
    """
    rows: id, text and own (its component so far). u and v of all pairs of different components that can have that similarity. Sets of n and m shingles are so similar if and only if they share
    `both` = ceil(similar / (1 + similar) * (n + m)) at least; then one of the first n - both + 1 of the one, in any order common to all (rare ones first), is among the first m - both + 1 of the other,
    and at most n + m - 2 * both are in one alone. Each set has 256 parity bits, and every bit in which two sets differ takes a shingle that one has alone.

    A shingle that over `crowd` documents have there is dealt by classes of sizes: a document goes to a class of its partners only if the shingle comes early enough for it, so members of a large group of
    near copies that are too far apart seldom meet at all; and those of the component that has most of its rows are met by others only.
    """
    sent = rows.sparkSession.sparkContext.broadcast(common(rows, width))
    held = lambda n: np.ceil(similar * n - 1e-9).astype(np.int64)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width)
        many, counts = sent.value

        def out(ids, owns, texts):
            h, owner, bounds = sketcher.hashes(texts)
            sizes = np.diff(bounds)
            at = np.minimum(np.searchsorted(many, h), max(len(many) - 1, 0))
            rank = np.where(many[at] == h, counts[at], 0) if len(many) else np.zeros(len(h), dtype=np.int64)
            by = np.lexsort((h, rank, owner))
            first = by[np.arange(len(h)) - bounds[owner] < (sizes - held(sizes) + 1)[owner]]
            ends = np.searchsorted(owner[first], np.arange(len(texts) + 1))
            firsts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[first].view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owns, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, parities(h, bounds)), firsts], ["id", "own", "n", *PARITY, "first"])

        ids, owns, texts, size = [], [], [], 0
        for b in batches:
            for i, o, t in zip(*b.columns):
                ids.append(i.as_py())
                owns.append(o.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > chars:
                    yield out(ids, owns, texts)
                    ids, owns, texts, size = [], [], [], 0
        if ids:
            yield out(ids, owns, texts)

    schema = f"id long, own long, n long, {', '.join(f'{c} long' for c in PARITY)}, first array<long>"
    sets = written(rows.select("id", "own", "text").mapInArrow(run, schema), "prefixes")
    first = sets.select("id", "own", F.posexplode("first").alias("pos", "h"))
    lists = first.groupBy("h").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("of")).where("low < high").select("h", (F.col("of") > crowd).alias("crowded"))
    members = first.select("h", "id", "pos").join(lists.hint("merge"), "h").join(sets.drop("first").hint("merge"), "id")
    step = 1.1
    both = lambda total: F.ceil(F.lit(similar / (1 + similar)) * total - F.lit(1e-6))
    size_class = lambda n: F.floor(F.log(n) / F.lit(float(np.log(step))) + F.lit(1e-9))
    least = F.greatest(F.pow(F.lit(step), F.col("other")) * F.lit(1 - 1e-6), F.col("n") * F.lit(similar))  # a partner's size in that class
    classes = F.when(F.col("crowded"), F.sequence(size_class(F.col("n") * F.lit(similar * (1 - 1e-6))), size_class(F.col("n") / F.lit(similar * (1 - 1e-6))))).otherwise(F.array(F.lit(0).cast("long")))
    members = members.withColumn("class", F.when(F.col("crowded"), size_class(F.col("n"))).otherwise(F.lit(0))).withColumn("other", F.explode(classes))
    members = members.where(~F.col("crowded") | (F.col("pos") <= F.col("n") - both(F.col("n") + least)))
    members = written(members.select("h", "class", "other", "crowded", "id", "own", "n", "pos", *PARITY), "bridges")
    largest = members.where("crowded").groupBy("h", "own").agg(F.count("*").alias("of")).groupBy("h").agg(F.max_by("own", F.struct("of", "own")).alias("main"))
    fields = lambda end: [F.col(c).alias(f"{c}_{end}") for c in ("id", "own", "n", "pos", *PARITY)]
    x = members.join(largest.hint("merge"), "h", "left").where("main is null or own <> main").select("h", "class", "other", "main", *fields("x"))
    y = members.select("h", F.col("class").alias("other"), F.col("other").alias("class"), *fields("y"))
    need = both(F.col("n_x") + F.col("n_y"))
    apart = functools.reduce(Column.__add__, [F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in PARITY])
    near = (F.col("pos_x") <= F.col("n_x") - need) & (F.col("pos_y") <= F.col("n_y") - need) & (apart <= F.col("n_x") + F.col("n_y") - 2 * need)
    other = F.expr("own_x < own_y or own_x > own_y and own_y <=> main")
    return x.join(y.hint("merge"), ["h", "class", "other"]).where(other & near).select(F.least("id_x", "id_y").alias("u"), F.greatest("id_x", "id_y").alias("v")).distinct()


def groups(rows: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """id and component (the least id reachable over links) for every row of rows (id, text), no id twice."""
    ship(rows.sparkSession)
    marked = written(sketches(rows, width), "sketches")
    copies = marked.groupBy("digest").agg(F.min("id").alias("rep"))
    named = written(marked.join(copies.hint("merge"), "digest").select("id", "rep", "mark", "words"), "named")
    reps = named.where("id = rep").drop("rep")
    links, found = None, None
    slice_of = lambda w: F.shiftrightunsigned(w, WORD)
    for first, last in [*zip(STEPS, STEPS[1:]), (None, None)]:
        some = reps if first is None else reps.withColumn("words", F.filter("words", lambda w: (slice_of(w) >= first) & (slice_of(w) < last)))  # noqa: B023
        if found is None:
            some = some.withColumn("own", F.col("id"))
        else:
            so_far = found.select(F.col("node").alias("id"), F.col("component").alias("own"))
            some = some.join(so_far.hint("merge"), "id", "left").withColumn("own", F.coalesce("own", "id"))
        if first is None:  # what no slice finds
            some = some.select("id", "own").join(rows.select("id", "text"), "id")
            pairs = lasting("bridged", lambda: bridges(some, width, similar))  # noqa: B023
        else:
            pairs = lasting("candidates", lambda: candidates(some))  # noqa: B023
        ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        texts = written(rows.select("id", "text").join(ends.hint("merge"), "id", "left_semi"), "texts")
        good = written(verified(pairs, texts, width, similar), "links")
        links = good if links is None else links.union(good)
        found = lasting("components", lambda: components(links))  # noqa: B023
    return named.select("id", "rep").join(found, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("component"))


def one_of_each(docs: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies: the one of the least id; any of those where ids repeat or are all null."""
    row = "voxscribe_row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # fixes the numbers
    found = lasting("groups", lambda: groups(rows.select(F.col(row).alias("id"), "text"), width, similar))
    ids = rows.select(F.col(row).alias("id"), F.col("doc_id").cast("long").alias("doc"))
    first: Column = F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("id")))
    kept = written(found.join(ids.hint("merge"), "id").groupBy("component").agg(first.alias("first")).select(F.col("first.id").alias(row)), "kept")
    return rows.join(kept.hint("merge"), row, "left_semi").drop(row)
