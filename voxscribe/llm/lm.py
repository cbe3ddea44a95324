"""
Language-model scores from a log-frequency Bloom filter of n-gram counts (Talbot and Osborne 2007), and exact unigram base scores.

Tokens are words with A-Z in lower case, then one end of text. A count becomes a level 1 + floor(steps * log2(count)); an
n-gram is put into the filter once for each level up to its own, so its count is read back by probing level after level until
one is missing. Every unigram and bigram of the training part enters the filter, however rare. The filter grows with the
corpus, so it is no broadcast: it is cut into slabs by the highest bits of the n-grams' hashes, and n-grams travel to their slab.

A task reads its texts a piece at a time and sends the piece's distinct n-grams, with their training counts, once: they are the
piece's share of the counts and its questions as well. Where the n-grams of a slab meet, they are summed, the slab is filled and
every piece gets back the levels that the probes find, a byte each, and the exact counts of its words. Then the pieces are
read again beside their answers and scored. P(word | previous) mixes the bigram's relative frequency with the smoothed unigram; the
weight depends on how many of the previous tokens continued a known bigram, so it is a probability given the past.

Base scores come from exact counts of words, known by 128 bits of digest.

Defined cases: null text is empty, so its one token is the end; a null id counts as the empty text in the fold, hence as held out;
repeated rows are documents of their own, in training and in the result; without training rows every probability is one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxscribe.llm.common import fold, frugal, ship, written

STEPS = 2.0
BITS_EACH = 12  # bits of a slab for each level put into it
END = b"\xff"  # no UTF-8 text holds this byte, so it is the end of text
#: Weight of the bigram by the number of known bigrams just before (0 to 3 or more).
TRUST = np.array([0.03, 0.1, 0.3, 0.6])
BELOW = 40  # bits of a bigram's hash below those that name its slab, so slabs as full as they may be mistake one bigram for another less often than probes do
KNOWN_WORDS = 300_000  # digests that a worker keeps from piece to piece


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(before: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The bigram's hash: its highest `bits` bits, the others zero."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word) & np.uint64(2**64 - 2 ** (64 - bits))


def level_of(count: np.ndarray) -> np.ndarray:
    """The level of each count from 1 up; 0 for none."""
    return np.where(count > 0, 1 + np.floor(STEPS * np.log2(np.maximum(count, 1)) + 1e-9), 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(level > 0, 2.0 ** ((level - 1) / STEPS), 0.0)


class Filter:
    """One slab: a bit array in which an n-gram of level n has four bits for each level from 1 to n."""

    def __init__(self, h: np.ndarray, level: np.ndarray):
        self.bits = max(64, BITS_EACH * int(level.sum()) + 7 & ~7)
        slab = np.zeros(self.bits, dtype=bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            h = h[level >= j]
            level = level[level >= j]
            for half in range(2):
                for p in self._places(h, j, half):
                    slab[p] = True
        self.slab = np.packbits(slab, bitorder="little")

    def _places(self, h: np.ndarray, level: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits that two of the four probes for an n-gram's level look at."""
        word = mixed(h + np.uint64((2 * level + half) * 0xD1342543DE82EF95 % 2**64))
        place = lambda x: (x * np.uint64(self.bits) >> np.uint64(32)).astype(np.int64)
        return place(word >> np.uint64(32)), place(word & np.uint64(0xFFFFFFFF))

    def _hits(self, h: np.ndarray, level: int, half: int) -> np.ndarray:
        a, b = self._places(h, level, half)
        return ((self.slab[a >> 3] >> (a & 7).astype(np.uint8)) & (self.slab[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the highest level up to which every probe hits; 0 if it isn't there."""
        found = np.zeros(len(h), dtype=np.uint8)
        alive, level = np.arange(len(h)), 0
        while len(alive) and level < 255:
            level += 1
            for half in range(2):  # most n-grams that aren't there miss in the first
                hit = self._hits(h, level, half)
                alive, h = alive[hit], h[hit]
            found[alive] = level
        return found


class Reader:
    """Pieces as arrays of tokens; keeps digests of words for the next pieces."""

    def __init__(self, ranges: int):
        self.bits = ranges.bit_length() - 1 + BELOW
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.digest = np.empty((0, 2), dtype=np.uint64)

    def read(self, texts: list[str | None]) -> None:
        """
        Sets lengths (tokens a text), ids (the place of each token's word), words (the places that occur, by their hash),
        h (the hash of each place) and pair (each token's bigram; a text's first token follows an end).
        """
        if len(self.place) > KNOWN_WORDS:
            self._clear()
        flat = b"".join(x for t in texts for x in ((t or "").encode(), b" \xff ")).lower().split()
        ids = np.fromiter(map(self.place.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(ids < 0).tolist()
        if missing:
            new = list({flat[i] for i in missing})
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), dtype="<u8").reshape(-1, 2)
            self.digest = np.concatenate([self.digest, digest])
            ids[missing] = [self.place[flat[i]] for i in missing]
        end = self.place[END] if texts else -1
        ends = np.flatnonzero(ids == end)
        self.lengths = np.diff(ends, prepend=-1)
        self.ids, self.h = ids, self.digest[:, 0]
        there = np.zeros(len(self.place), dtype=bool)
        there[ids] = True
        words = np.flatnonzero(there)
        self.words = words[np.lexsort((self.digest[words, 1], self.h[words]))]
        before = np.concatenate([[end], ids[:-1]])
        self.pair = pair_hash(self.h[before], self.h[ids], self.bits) if len(ids) else np.empty(0, dtype=np.uint64)


def _runs(h: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)


def _cut(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The parts of an array between cuts as binary values, without a copy of each."""
    data = np.ascontiguousarray(data)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def asked(rows: DataFrame, ranges: int, chars: int) -> DataFrame:
    """
    The distinct n-grams of each piece of rows (chunk, uid, held_out, text), a row for each range of hashes that they fall into: words (two hashes each) and
    bigrams with their training counts. A piece is a run of neighbouring rows of a chunk, of about `chars` characters; `at` is its first uid.
    """
    low = np.uint64(65 - ranges.bit_length())  # bits below those that name the range
    edges = np.arange(ranges, dtype=np.uint64) << low

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, texts, held, chunk, at, last, size = Reader(ranges), [], [], None, None, None, 0

        def out():
            reader.read(texts)
            train = np.repeat(~np.array(held), reader.lengths)
            n = np.bincount(reader.ids[train], minlength=len(reader.place))[reader.words]
            w = reader.digest[reader.words]
            p = np.sort(reader.pair | (~train).astype(np.uint64))  # the lowest bit marks tokens that aren't learned from
            learned = 1 - (p & np.uint64(1)).astype(np.uint32)
            starts = _runs(p >> np.uint64(1))
            p = p[starts] & ~np.uint64(1)
            cuts = lambda h: np.append(np.searchsorted(h, edges), len(h))
            of_words, of_pairs = cuts(w[:, 0]), cuts(p)
            columns = [np.arange(ranges, dtype=np.int32), np.full(ranges, chunk), np.full(ranges, at)]
            p = (p << (np.uint64(64) - low)) >> np.uint64(64 - BELOW)
            parts = [_cut(w[:, 0], of_words), _cut(w[:, 1], of_words), _cut(n.astype("<u4"), of_words), _cut((p >> np.uint64(8)).astype("<u4"), of_pairs), _cut(p.astype(np.uint8), of_pairs), _cut(np.add.reduceat(learned, starts).astype("<u4"), of_pairs)]
            some = (np.diff(of_words) > 0) | (np.diff(of_pairs) > 0)
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), *parts], ["range", "chunk", "at", "w", "w2", "wn", "p", "p2", "pn"]).filter(pa.array(some))

        for b in batches:
            for c, uid, is_held, text in zip(*(b.column(k) for k in range(4))):
                c, uid, text = c.as_py(), uid.as_py(), text.as_py()
                if texts and (c != chunk or uid != last + 1 or size + len(text or "") > chars):
                    yield out()
                    texts, held, size = [], [], 0
                if not texts:
                    chunk, at = c, uid
                texts.append(text)
                held.append(is_held.as_py())
                last, size = uid, size + len(text or "")
        if texts:
            yield out()

    return rows.select("chunk", "uid", "held_out", "text").mapInArrow(run, "range int, chunk long, at long, w binary, w2 binary, wn binary, p binary, p2 binary, pn binary")


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (by their first hash), the sums of n, and for each entry the place of its key. keys: one or two hashes of each entry; the first is of sorted runs."""
    by = np.argsort(keys[0], kind="stable")
    new = np.concatenate([[True], np.diff(keys[0][by]) != 0])[: len(by)]
    if len(keys) > 1 and (np.diff(keys[1][by]) != 0)[~new[1:]].any():  # two words of one hash
        by = np.lexsort(keys[::-1])
        new = np.concatenate([[True], (np.diff(keys[0][by]) != 0) | (np.diff(keys[1][by]) != 0)])
    starts = np.flatnonzero(new)
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.cumsum(new) - 1
    return keys[0][by][starts], np.add.reduceat(n[by].astype(np.int64), starts) if len(starts) else np.empty(0, dtype=np.int64), place


def answered(questions: DataFrame, ranges: int) -> DataFrame:
    """
    For each row of asked(): chunk, at, range, the levels of its words and bigrams as the filter's probes find them, a byte each, and the words' exact counts. For each range besides,
    with a null chunk: how many training tokens (n) and distinct words (v) it holds, and the sum of their counts as read from the filter (mass).
    """

    low = np.uint64(65 - ranges.bit_length())

    def of_range(r: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        array = lambda k, kind="<u8": np.frombuffer(b"".join(x[k] for x in rows), dtype=kind)
        w, c, w_place = _summed([array(2), array(3)], array(4, "<u4"))
        p = (array(5, "<u4").astype(np.uint64) << np.uint64(8) | array(6, np.uint8)) << (low - np.uint64(BELOW)) | np.uint64(r) << low
        p, d, p_place = _summed([p], array(7, "<u4"))
        h, level = np.concatenate([mixed(w), p]), np.concatenate([level_of(c), level_of(d)])
        slab = Filter(h[level > 0], level[level > 0])
        found = slab.levels(h)
        sizes, pair_sizes = np.array([len(x[2]) // 8 for x in rows]), np.array([len(x[6]) for x in rows])
        ends = lambda n: np.concatenate([[0], np.cumsum(n)])
        columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([r] * len(rows), pa.int32())]
        columns += [_cut(found[w_place], ends(sizes)), _cut(found[len(w) :][p_place], ends(pair_sizes)), _cut(c[w_place], ends(sizes))]
        none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.float64())]
        names = ["chunk", "at", "range", "words", "pairs", "counts", "n", "v", "mass"]
        yield pa.RecordBatch.from_arrays([*columns, *none], names)
        sums = [pa.array([int(c.sum())], pa.int64()), pa.array([int((c > 0).sum())], pa.int64()), pa.array([float(count_of(found[: len(w)][c > 0].astype(np.int64)).sum())])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x.type) for x in columns[:2]), pa.array([r], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), *sums], names)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r, *row in zip(*(c.to_pylist() for c in b.columns)):
                if r != now and rows:
                    yield from of_range(now, rows)
                    rows = []
                now = r
                rows.append(row)
        if rows:
            yield from of_range(now, rows)

    schema = "chunk long, at long, range int, words binary, pairs binary, counts binary, n long, v long, mass double"
    return questions.repartition("range").sortWithinPartitions("range").mapInArrow(run, schema)


class Scorer(Reader):
    """Scores pieces with the answers to their questions; n, v and mass are the sums over all ranges."""

    def __init__(self, ranges: int, n: int, v: int, mass: float, add: float = 0.1):
        super().__init__(ranges)
        self.bottom, self.add, self.total = n + add * (v + 1), add, mass + add * (v + 1)

    def __call__(self, texts: list[str | None], words: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """For each text: tokens, tokens known from training, the base score, the model's log10 probability. words and counts go with the piece's distinct words by hash, pairs with its distinct bigrams."""
        self.read(texts)
        if len(words) != len(self.words):
            raise ValueError(f"{len(words)} answers for {len(self.words)} words")
        exact, prior, uni = np.zeros(len(self.place), dtype=np.int64), np.zeros(len(self.place)), np.zeros(len(self.place))
        exact[self.words], prior[self.words] = counts, count_of(words.astype(np.int64))
        uni[self.words] = (prior[self.words] + self.add) / self.total
        base = np.log10((exact + self.add) / self.bottom)
        by = np.argsort(self.pair)
        new = np.diff(self.pair[by], prepend=0) != 0
        new[:1] = True
        seen = np.empty(len(by))
        seen[by] = count_of(pairs.astype(np.int64))[np.cumsum(new) - 1]
        ids = self.ids
        context = prior[np.concatenate([[self.place[END]], ids[:-1]])]
        known = seen > 0
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        run, so_far = np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
        for back in (1, 2, 3):
            shifted = np.zeros(len(ids), dtype=bool)
            shifted[back:] = known[:-back]
            for b in range(back):  # not across the start of a text
                at = starts + b
                shifted[at[at < len(ids)]] = False
            so_far &= shifted
            run += so_far
        trust = TRUST[run] * (context > 0)
        top = 2.0 ** (1 / STEPS)  # a context's count is below the next level's
        bigram = np.where(known & (context > 0), np.minimum(1.0, seen / np.maximum(np.maximum(context * top, seen), 1e-9)), 0.0)
        logs = np.log10(trust * bigram + (1 - trust) * uni[ids])
        sums = lambda x: np.add.reduceat(x, starts)
        return {"n_tokens": self.lengths, "n_known": sums((exact > 0)[ids].astype(np.int64)), "base_score": sums(base[ids]), "score": sums(logs)}


def score(docs: DataFrame, folds: int = 10, held: int = 0, chunk_rows: int = 1024, piece_chars: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text); learns from the rows whose fold isn't `held`."""
    spark = docs.sparkSession
    ship(spark)
    uid = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), "text", (fold("doc_id", folds) == held).alias("held_out"), uid.alias("uid"))
    rows = written(rows, "texts").withColumn("chunk", F.floor(F.col("uid") / chunk_rows))  # fixes the numbers
    ranges = 1 << min(20, max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    answers = written(answered(asked(rows, ranges, piece_chars), ranges), "answers")
    zero = lambda c, z: F.coalesce(F.sum(c), F.lit(z)).alias(c)
    n, v, mass = answers.where("chunk IS NULL").agg(zero("n", 0), zero("v", 0), zero("mass", 0.0)).first()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ranges, n, v, mass)
        answer, kept = ([], [], []), ([], [], [])

        def out():
            of = lambda k, kind: np.frombuffer(b"".join(answer[k]), dtype=kind)
            ids, held_out, texts = kept
            got = scorer(texts, of(0, np.uint8), of(1, np.uint8), of(2, "<i8"))
            train = pa.array(np.full(len(texts), n))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), *(pa.array(got[c]) for c in ("n_tokens", "n_known")), train, *(pa.array(got[c]) for c in ("base_score", "score"))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for words, pairs, counts, *row in zip(*(b.column(k).to_pylist() for k in ("words", "pairs", "counts", "doc_id", "held_out", "text"))):
                if words is None:
                    for column, x in zip(kept, row):
                        column.append(x)
                    continue
                if kept[0]:
                    yield out()
                    answer, kept = ([], [], []), ([], [], [])
                for column, x in zip(answer, (words, pairs, counts)):
                    column.append(x)
        if kept[0]:
            yield out()

    null = lambda kind: F.lit(None).cast(kind)
    last = F.lit(2**31 - 1)  # a piece's texts come after its answers
    pieces = answers.where("chunk IS NOT NULL").select("chunk", "at", "range", "words", "pairs", "counts", null("long").alias("doc_id"), null("boolean").alias("held_out"), null("string").alias("text"))
    pieces = pieces.union(rows.select("chunk", F.col("uid").alias("at"), last.alias("range"), null("binary"), null("binary"), null("binary"), "doc_id", "held_out", "text"))
    pieces = pieces.repartition("chunk").sortWithinPartitions("chunk", "at", "range")
    return pieces.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
