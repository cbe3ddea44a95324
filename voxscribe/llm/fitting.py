"""Fitting a classifier on a bounded sample of labelled documents, in one task of the cluster."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from voxscribe.llm.common import columns, fold, frugal, ship


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int, max_chars: int) -> DataFrame:
    """
    label (0 or 1), text, lang and a seeded order of labelled documents outside fold `held`: of the rarer class up to 30 % of
    max_rows, of the other up to 60 %, and max_rows in all at most, of texts up to max_chars. Only the fit is bounded so; scoring reads every text whole.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).select(F.col("doc_id").alias("_id"), (F.col(label) > 0).cast("int").alias("_label")).distinct()
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30))
    rarer = min(sizes, key=lambda k: (sizes[k], k), default=0)
    part = lambda k: min(1.0, (0.3 if k == rarer else 0.6) * max_rows / sizes[k])
    share = F.create_map(F.lit(-1), F.lit(0), *[F.lit(x) for k in sizes for x in (k, int(part(k) * (1 << 30)))])
    drawn = known.withColumn("_order", order).where(F.col("_order") <= share[F.col("_label")]).limit(max_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").alias("_doc"), "text", lang.alias("lang")).where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    one = found.groupBy("_id", "_label", "_order").agg(F.min(F.struct("text", "lang")).alias("_row"))  # of a repeated id the least text
    return one.select(F.col("_label").alias("label"), F.col("_row.text").alias("text"), F.col("_row.lang").alias("lang"), "_order")


def fitted(sample: DataFrame, train: Callable[[np.ndarray, list[str], list[str | None]], dict[str, np.ndarray]]) -> dict[str, np.ndarray] | None:
    """The arrays that `train` makes of the sample's labels, texts and languages, in one task; None if the sample is empty."""
    ship(sample.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((o, t, y, g) for b in batches for y, t, g, o in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:3])
        if rows:
            out = io.BytesIO()
            np.savez(out, **train(np.array([r[2] for r in rows]), [r[1] for r in rows], [r[3] for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return dict(np.load(io.BytesIO(rows[0]["model"]))) if rows else None


class Adam:
    """Adam with bias correction over one array; rows: the rows of it that a step touches, if not all."""

    def __init__(self, array: np.ndarray, rate: float):
        self.array, self.rate, self.t = array, rate, 0
        self.m, self.v = np.zeros_like(array), np.zeros_like(array)

    def step(self, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.t += 1
        m = self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        v = self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        self.array[rows] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(docs: DataFrame, scorer: Callable[[], Callable[[list[str | None]], np.ndarray]], carry: bool, chars: int = 2_000_000) -> DataFrame:
    """score, doc_id and lang of every row of docs, whole texts in groups of about `chars`; carry: the whole row as well, as `row`. scorer makes a worker's scoring function."""
    ship(docs.sparkSession)
    text = F.struct(*columns(docs)).alias("row") if carry else F.col("text")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(text, F.col("doc_id").cast("long"), lang.alias("lang"))
    kept = rows if carry else rows.drop("text")
    names = ["score", *kept.columns]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in batches:
            texts, at = (b.column(0).field("text") if carry else b.column(0)).to_pylist(), 0
            out = np.empty(len(texts))
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") < chars):
                    size += len(texts[end] or "")
                    end += 1
                out[at:end] = score(texts[at:end])
                at = end
            columns = b.columns if carry else b.columns[1:]
            yield pa.RecordBatch.from_arrays([pa.array(out), *columns], names)

    return rows.mapInArrow(run, StructType([StructField("score", DoubleType()), *kept.schema.fields]))
