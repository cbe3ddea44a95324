"""
Toxicity by a convolutional text classifier in numpy.

Words (lower case, outer punctuation off) are hashed to 2 ** 20 buckets; buckets that training saw in enough documents have an
embedding, all others share the zero vector. So a model has the same bounds whatever the corpus; the rare words that share a bucket with a frequent one
are the same share of its occurrences at any size. Filters of several widths slide over the whole text, each filter's maximum
over it is pooled, and a logistic unit makes the probability. Thresholds are calibrated by language on a fifth of the
labelled rows, which no step of the fit sees: they decide `rejected`; a score never sees language, source, id or label.

Defined cases: null text counts as empty; a text without words has only the bias to go by, a low score; a language without
enough toxic examples, or null, has the common threshold; repeated rows and null ids are scored like others; without labelled rows
every score is that of a low bias; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxscribe.llm.common import dropped, fold, frugal, ship, written
from voxscribe.llm.fitting import Adam, scored, sigmoid

BUCKETS = 1 << 20
WIDTHS = (1, 2, 3)
OUTER = ".,;:!?\"'()[]{}<>*#$%&|…«»“”‘’-–—_/\\"


def bucket(word: str) -> int:
    return zlib.crc32((word.strip(OUTER) or word).encode()) % BUCKETS


def _places(buckets: np.ndarray) -> np.ndarray:
    """Of each bucket the row of the embedding, 0 if it has none."""
    at = np.zeros(BUCKETS, dtype=np.int32)
    at[buckets] = np.arange(1, len(buckets) + 1)
    return at


class TextCnn:
    """Pooled convolutions over embedded words. Row 0 of the embedding is the zero vector; texts are padded by it."""

    def __init__(self, known: np.ndarray, dims: int = 8, filters: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.buckets = known
        self.embedding = (0.1 * rng.standard_normal((len(known) + 1, dims))).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [(rng.standard_normal((w, dims, filters)) / np.sqrt(w * dims)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(filters, dtype=np.float32) for _ in WIDTHS]
        self.out = (0.3 * np.abs(rng.standard_normal(len(WIDTHS) * filters))).astype(np.float32)
        self.bias = np.array([-2.0], dtype=np.float32)
        self.thresholds: dict[str, float] = {}
        self.common = 0.3

    def arrays(self) -> dict[str, np.ndarray]:
        named = {f"f{i}": f for i, f in enumerate(self.filters)} | {f"s{i}": s for i, s in enumerate(self.shift)}
        return named | {"buckets": self.buckets, "embedding": self.embedding, "out": self.out, "bias": self.bias, "langs": np.array(list(self.thresholds), dtype=str), "cuts": np.array(list(self.thresholds.values()), dtype=float), "common": np.array(self.common)}

    @classmethod
    def of(cls, a: dict[str, np.ndarray] | None) -> TextCnn:
        if a is None:
            none = cls(np.empty(0, dtype=np.int64))
            none.bias[:] = -4
            return none
        m = cls(a["buckets"], a["embedding"].shape[1], a["f0"].shape[2])
        m.embedding, m.out, m.bias, m.common = a["embedding"], a["out"], a["bias"], float(a["common"])
        m.filters, m.shift = [a[f"f{i}"] for i in range(len(WIDTHS))], [a[f"s{i}"] for i in range(len(WIDTHS))]
        m.thresholds = dict(zip(a["langs"].tolist(), a["cuts"].tolist()))
        return m

    def prepare(self) -> None:
        """The row of the embedding of each bucket, and the words met so far."""
        self.place = _places(self.buckets)
        self.met: dict[str, int] = {}

    def rows_of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        got = list(map(self.met.get, words))
        if None in got:
            if len(self.met) > 500_000:
                self.met.clear()
            for i, w in enumerate(words):
                if got[i] is None:
                    got[i] = self.met[w] = int(self.place[bucket(w)])
        return np.array(got, dtype=np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of texts."""
        return sigmoid(self.logits([self.rows_of(t) for t in texts]))

    def logits(self, words: list[np.ndarray]) -> np.ndarray:
        """Log odds of texts given as rows of the embedding: they are joined with pads between and pooled by segment, from windows that start at a word (of an empty text, at a pad)."""
        gap = np.zeros(max(WIDTHS) - 1, dtype=np.int64)
        parts = [np.concatenate([w if len(w) else [0], gap]) for w in words]
        ids = np.concatenate([*parts, gap]).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        pads = (ends[:, None] - 1 - np.arange(len(gap))).ravel()
        n = len(ids) - len(gap)
        pooled = []
        x = self.embedding[ids]
        for f, shift in zip(self.filters, self.shift):
            a = x[:n] @ f[0]
            for o in range(1, len(f)):
                a += x[o : o + n] @ f[o]
            a[pads] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(a, starts, axis=0) + shift, 0))
        return (np.concatenate(pooled, axis=1) @ self.out + self.bias[0]).astype(np.float64)


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(p, 1e-12, 1 - 1e-12))


def best_cut(logits: np.ndarray, labels: np.ndarray, missed: float = 1.0, wrong: float = 4.0) -> float:
    """The cut with the least cost of missed and wrong rejections (the sample holds about a quarter of the clean texts per toxic one that a corpus does); at three quarters of the widest gap among the best, since clean texts are the more."""
    at = np.argsort(logits, kind="stable")
    x, y = logits[at], labels[at]
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    below = np.concatenate([[0], np.cumsum(y)])  # toxic below the cut after k texts
    cost = missed * below + wrong * ((1 - y).sum() - (np.arange(len(y) + 1) - below))
    best = np.flatnonzero(cost == cost.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float(0.25 * edges[widest] + 0.75 * edges[widest + 1])


def started(buckets: np.ndarray, seen: np.ndarray, toxic: np.ndarray, labels: tuple[int, int], seed: int = 3) -> TextCnn:
    """A model before its first step: of each bucket the documents that have it and the toxic ones among them; labels: how many documents aren't toxic and how many are."""
    model = TextCnn(buckets, seed=seed)
    # The first coordinate starts at a word's log odds, less where few documents have it, and every filter starts by looking there: a maximum passes no gradient to words that never reach it.
    odds = np.log((toxic + 0.5) / (labels[1] + 1)) - np.log((seen - toxic + 0.5) / (labels[0] + 1))
    model.embedding[1:, 0] = 0.3 * odds * np.minimum(1, seen / 10)
    for f in model.filters:
        f[:, 0] = np.abs(f[:, 0])
    return model


class Steps:
    """Adam over the arrays of a model, epoch by epoch."""

    def __init__(self, model: TextCnn, rate: float = 0.02):
        self.model = model
        self.plain = [Adam(a, rate) for a in (*model.filters, *model.shift, model.out, model.bias)]
        self.embedded = Adam(model.embedding, rate)

    def peaks(self, doc: np.ndarray, filters: np.ndarray, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over a document (rows of the embedding, pads at the end) and the window where it first is; filters: all rows of all filters."""
        n, k = len(doc) - max(WIDTHS) + 1, len(self.model.out) // len(WIDTHS)
        most, where = np.full(len(WIDTHS) * k, -np.inf, dtype=np.float32), np.zeros(len(WIDTHS) * k, dtype=np.int64)
        for at in range(0, n, chunk):
            m = min(chunk, n - at)
            each = filters @ self.model.embedding[doc[at : at + m + max(WIDTHS) - 1]].T
            a, row = np.empty((len(most), m), dtype=np.float32), 0
            for w, width in enumerate(WIDTHS):
                own = a[w * k : (w + 1) * k]
                own[:] = each[row : row + k, :m]
                for o in range(1, width):
                    own += each[row + o * k : row + (o + 1) * k, o : o + m]
                row += width * k
            p = a.argmax(1)
            value = a[np.arange(len(p)), p]
            more = value > most
            most[more], where[more] = value[more], at + p[more]
        return most, where

    def epoch(self, ids: list[np.ndarray], labels: np.ndarray, order: np.ndarray, batch: int = 32, decay: float = 1e-4) -> None:
        """One pass over documents (rows of the embedding, pads at the end) in that order."""
        model, steps, k, pad = self.model, self.plain, len(WIDTHS), max(WIDTHS) - 1
        size = len(model.out) // k
        row_filter = np.concatenate([np.tile(np.arange(w * size, (w + 1) * size), width) for w, width in enumerate(WIDTHS)])  # of each row of each filter: its filter, its offset
        row_offset = np.concatenate([np.repeat(np.arange(width), size) for width in WIDTHS])
        none = np.zeros(1 + pad, dtype=np.int64)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            filters = np.concatenate([f[o].T for f in model.filters for o in range(len(f))])
            pooled, words = np.empty((len(chosen), k * size), dtype=np.float32), np.empty((len(chosen), len(row_filter)), dtype=np.int64)
            for i, doc in enumerate(ids[j] if len(ids[j]) > pad else none for j in chosen):
                pooled[i], where = self.peaks(doc, filters)
                words[i] = doc[where[row_filter] + row_offset]
            z = pooled + np.concatenate(model.shift)
            h = np.maximum(z, 0)
            delta = ((sigmoid(h @ model.out + model.bias[0]) - labels[chosen]) / batch).astype(np.float32)
            back = delta[:, None] * model.out * (z > 0)
            rowwise = back[:, row_filter]
            by_row = np.einsum("br,brd->rd", rowwise, model.embedding[words])
            grads, row = [], 0
            for width in WIDTHS:
                grads.append(by_row[row : row + width * size].reshape(width, size, -1).transpose(0, 2, 1))
                row += width * size
            grads += [*back.sum(0).reshape(k, size), delta @ h, delta.sum(keepdims=True)]
            for s, g in zip(steps, grads):
                s.step(g + decay * s.array)
            # The gradients of the embedding, by the filters that made this batch's maxima.
            rows, inverse = np.unique(words, return_inverse=True)
            g = np.zeros((len(rows), model.embedding.shape[1]), dtype=np.float32)
            np.add.at(g, inverse.ravel(), (rowwise[:, :, None] * filters).reshape(-1, g.shape[1]))
            self.embedded.step(g + decay * model.embedding[rows], rows)
            model.embedding[0] = 0


def labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """id, label, lang and buckets (of the words) of every labelled document outside fold `held`; of a repeated id the row of the least buckets."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("label")).distinct()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # A Bloom filter of the labelled ids: what it lets pass is joined exactly, so it only spares the words of most other rows a shuffle.
    bits = 1 << min(27, max(16, (8 * known.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marked = known.select(place(F.col("id")).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).toArrow()
    bloom = np.zeros(bits >> 6, dtype=np.int64)
    bloom[marked.column("w").to_numpy()] = marked.column("b").to_numpy()
    sent = spark.sparkContext.broadcast(bloom)  # 16 MB at most
    ids = F.col("doc_id").cast("long")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held)).select(ids.alias("id"), lang.alias("lang"), place(ids).alias("p"), "text")

    @frugal
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, int] = {}
        bloom = sent.value
        for b in batches:
            p = b.column(2).to_numpy()
            maybe = np.flatnonzero(bloom[p >> 6] >> (p & 63) & 1)
            if not len(maybe):
                continue
            out, ends = [], [0]
            for i in maybe.tolist():
                words = b.column(3)[i].as_py().lower().split()
                got = list(map(met.get, words))
                if None in got:
                    if len(met) > 500_000:
                        met.clear()
                    for j, w in enumerate(words):
                        if got[j] is None:
                            got[j] = met[w] = bucket(w)
                out.append(np.array(got, dtype=np.int32))
                ends.append(ends[-1] + len(got))
            few = [c.take(pa.array(maybe)) for c in b.columns[:2]]
            yield pa.RecordBatch.from_arrays([*few, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))], ["id", "lang", "buckets"])

    # Grouped as the join deals them out, so the words travel once.
    words = rows.mapInArrow(hashed, "id long, lang string, buckets array<int>")
    return words.join(known, "id").groupBy("id", "label").agg(F.min(F.struct("buckets", "lang")).alias("row")).select("id", "label", "row.lang", "row.buckets")


SMALL = ("out", "bias", *(f"{kind}{i}" for kind in "fs" for i in range(len(WIDTHS))))
SCALE = float(1 << 20)  # changes are summed as whole numbers, so that their order makes no difference


def _small(arrays: dict[str, np.ndarray], dims: int) -> np.ndarray:
    """All arrays but the embedding as rows of its width."""
    flat = np.concatenate([arrays[n].ravel() for n in SMALL])
    return np.pad(flat, (0, -len(flat) % dims)).reshape(-1, dims)


def _changed(before: dict[str, np.ndarray], made: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what a shard of n rows changed: the row of the embedding (of the other arrays: a negative number), its weight in the average, and the change times that weight."""
    rows = np.flatnonzero((made["embedding"] != before["embedding"]).any(axis=1))
    dims = before["embedding"].shape[1]
    others = _small(made, dims).astype(np.float64) - _small(before, dims)
    change = np.concatenate([made["embedding"][rows].astype(np.float64) - before["embedding"][rows], n * others])
    weight = np.concatenate([np.ones(len(rows), dtype=np.int64), np.full(len(others), n)])
    return np.concatenate([rows, -1 - np.arange(len(others))]), weight, np.rint(SCALE * change).astype(np.int64)


def _moved(before: dict[str, np.ndarray], rows: np.ndarray, weight: np.ndarray, change: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays after the average of all changes, as _changed() gives them, summed by row; change: column by column."""
    after = before | {"embedding": before["embedding"].copy()}
    own = rows >= 0
    others = _small(before, before["embedding"].shape[1]).astype(np.float64)
    for d, column in enumerate(change):
        mean = column / (SCALE * weight)
        after["embedding"][rows[own], d] += mean[own].astype(np.float32)
        others[-1 - rows[~own], d] += mean[~own]
    flat, at = others.ravel(), 0
    for n in SMALL:
        after[n] = flat[at : at + before[n].size].reshape(before[n].shape).astype(before[n].dtype)
        at += before[n].size
    return after


def train(rows: DataFrame, min_docs: int = 3, epochs: int = 12, shard_rows: int = 6000, seed: int = 3) -> dict[str, np.ndarray] | None:
    """
    The model of all rows (id, label, lang, buckets); None without rows. Words are counted over all of them. Each epoch every shard of about shard_rows rows makes a pass from
    the common model, and their changes are averaged, those of a word's embedding over the shards that moved it; the cluster sums them, so the driver gets one
    change a bucket however many shards there are. A fifth of the rows, all of them again, sets the thresholds.
    """
    spark = rows.sparkSession
    sized = written(rows, "labelled")
    sizes = {r["label"]: r["n"] for r in sized.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(sizes.values())
    if not total:
        return None
    shards = -(-total // shard_rows)
    mark = F.xxhash64(F.col("id"), F.col("label"), F.lit(seed))
    dealt = sized.select(F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), (F.pmod(F.shiftrightunsigned(mark, 20), F.lit(5)) > 0).alias("kept"), "id", "label", "lang", "buckets")
    # A shard lies in one file, so that the passes need no shuffle, and there in one run, so that a task holds one shard at a time.
    shard_table = written(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "id", "label"), "shards")
    dropped(sized)

    @frugal
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for y, words in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.unique(words.values.to_numpy(zero_copy_only=False))
                seen[own] += 1
                if y:
                    toxic[own] += 1
        some = np.flatnonzero(seen)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some]), pa.array(toxic[some])], ["bucket", "seen", "toxic"])

    least = min(min_docs, max(1, total // 20))
    words = shard_table.select("label", "buckets").mapInArrow(counted, "bucket int, seen long, toxic long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).where(F.col("seen") >= least).toArrow()
    by = np.argsort(words.column("bucket").to_numpy())
    buckets, seen, toxic = (words.column(c).to_numpy()[by] for c in ("bucket", "seen", "toxic"))
    model = started(buckets.astype(np.int64), seen.astype(np.float64), toxic.astype(np.float64), (sizes.get(0, 0), sizes.get(1, 0)), seed)
    pad = np.zeros(max(WIDTHS) - 1, dtype=np.int32)
    parts = [f"d{i}" for i in range(model.embedding.shape[1])]

    for epoch in range(epochs):
        before = model.arrays()
        sent = spark.sparkContext.broadcast(before)

        @frugal
        def passed(batches: Iterator[pa.RecordBatch], sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
            place = _places(sent.value["buckets"])

            def made(shard: int, own: list) -> pa.RecordBatch:
                own.sort(key=lambda r: r[:2])
                local = TextCnn.of({k: v.copy() for k, v in sent.value.items()})
                order = np.random.default_rng((seed, epoch, shard)).permutation(len(own))
                Steps(local).epoch([r[2] for r in own], np.array([r[1] for r in own]), order)
                rows, weight, change = _changed(sent.value, local.arrays(), len(own))
                return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(weight), *map(pa.array, np.ascontiguousarray(change.T))], ["row", "weight", *parts])

            now, own = None, []
            for b in batches:
                for shard, i, y, w in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3)):
                    if shard != now:
                        if own:
                            yield made(now, own)
                        now, own = shard, []
                    own.append((i, y, np.concatenate([place[w.values.to_numpy(zero_copy_only=False)], pad])))
            if own:
                yield made(now, own)

        changes = shard_table.where("kept").select("shard", "id", "label", "buckets").mapInArrow(passed, "row int, weight long, " + ", ".join(f"{d} long" for d in parts))
        got = changes.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("weight", *parts)]).toArrow()  # a row a bucket at most
        model = TextCnn.of(_moved(before, got.column("row").to_numpy(), got.column("weight").to_numpy(), [got.column(d).to_numpy() for d in parts]))
        sent.destroy()
    sent = spark.sparkContext.broadcast(model.arrays())

    @frugal
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TextCnn.of(sent.value)
        model.prepare()
        place = _places(model.buckets)
        for b in batches:
            words = [place[w.values.to_numpy(zero_copy_only=False)] for w in b.column(2)]
            logits = [model.logits(words[i : i + 64]) for i in range(0, len(words), 64)]
            if logits:
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.concatenate(logits))], ["label", "lang", "logit"])

    own = shard_table.where("not kept").select("label", "lang", "buckets").mapInArrow(judged, "label int, lang string, logit double").toArrow()
    sent.destroy()
    dropped(shard_table)
    if own.num_rows:
        logits, marks = own.column("logit").to_numpy(), own.column("label").to_numpy()
        langs = own.column("lang").combine_chunks().dictionary_encode()
        codes = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        move = best_cut(logits, marks) - logit(np.array(model.common))
        model.bias -= np.float32(move)
        logits = logits - move
        for code, lang in sorted(enumerate(langs.dictionary.to_pylist()), key=lambda x: x[1]):
            mine = codes == code
            if lang and marks[mine].sum() >= 10:
                model.thresholds[lang] = float(np.clip(sigmoid(np.array(best_cut(logits[mine], marks[mine]))), 0.2, 0.4))
    return model.arrays()


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (by `threshold`) and rejected (by the language's threshold) of every row of docs; carry: the whole row as well, as `row`. Learns from every labelled row outside fold `held`."""
    spark = docs.sparkSession
    ship(spark)
    model = TextCnn.of(train(labelled(docs, labels, folds, held)))
    sent = spark.sparkContext.broadcast(model.arrays())  # embeddings of the words that enough documents have, BUCKETS at most

    def scorer():
        model = TextCnn.of(sent.value)
        model.prepare()
        return model.scores

    cuts = F.create_map(F.lit(""), F.lit(threshold), *[F.lit(x) for item in model.thresholds.items() for x in item])
    return scored(docs, scorer, carry).select(
        "doc_id",
        (fold("doc_id", folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce(F.element_at(cuts, F.coalesce("lang", F.lit(""))), F.lit(threshold))).alias("rejected"),
        *["row"] * carry,
    )
