"""Operators on graphs of spans inside DataFrames: native best path, interval overlap, length buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_score(length: Column | int, edges: Column) -> Column:
    """
    The total of the best path over characters 0 to `length` as a native fold. edges: array<struct<start, end, score>> with
    long scores. Keeping a character scores zero. For rows of few edges; the fold copies its state at every place.
    """
    size = F.lit(length) if isinstance(length, int) else length

    def step(best: Column, at: Column) -> Column:
        here = F.filter(edges, lambda e: e["end"] == at)
        ways = F.transform(here, lambda e: F.element_at(best, (e["start"] + 1).cast("int")) + e["score"])
        return F.concat(best, F.array(F.array_max(F.concat(F.array(F.element_at(best, -1)), ways))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), size), F.array(F.lit(0).cast("long")), step), -1)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Pairs of half-open intervals of one key that share a place; the right side's columns get the suffix _r."""
    renamed = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}_r") for c in right.columns])
    return left.join(renamed, keys).where((F.col(start) < F.col(f"{end}_r")) & (F.col(f"{start}_r") < F.col(end)))


def length_buckets(df: DataFrame, length: str, tie: str, per: str, size: int = 8) -> DataFrame:
    """Adds `bucket`: rows of like length together, `size` a bucket, within each value of `per`."""
    row = F.row_number().over(Window.partitionBy(per).orderBy(length, tie))
    return df.withColumn("bucket", F.floor((row - 1) / size))
