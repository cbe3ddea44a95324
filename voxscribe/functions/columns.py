"""Column functions: realizers and comparators over Arrow batches, each distinct text of a batch read once."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from voxscribe.functions import compare, gate, temporal
from voxscribe.functions import realize as kinds
from voxscribe.functions.decode import TOKEN
from voxscribe.shipping import ship

CANDIDATE = StructType([StructField("replacement", StringType(), False), StructField("kind_mask", IntegerType(), False)])


def _once_each(function: Callable[[str], object], kind: DataType, arrow: pa.DataType):
    """An Arrow function of one text column that calls `function` on each distinct text of a batch."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(texts)
        out = pa.array([function(t) for t in coded.dictionary.to_pylist()], arrow)
        return out.take(coded.indices)

    return run


@functools.cache
def _realizer(kind: str):
    kinds._known(kind)
    return _once_each(lambda t: kinds.realize(kind, t), StringType(), pa.string())


@functools.cache
def _options(kind: str):
    kinds._known(kind)
    return _once_each(lambda t: kinds.realize_options(kind, t), ArrayType(StringType()), pa.list_(pa.string()))


@functools.cache
def _candidates():
    arrow = pa.list_(pa.struct([pa.field("replacement", pa.string(), False), pa.field("kind_mask", pa.int32(), False)]))
    return _once_each(lambda t: [{"replacement": r, "kind_mask": m} for r, m in (kinds.candidates(t, gate.kinds_of_span(TOKEN.findall(t), t)) if t else [])], ArrayType(CANDIDATE), arrow)


@functools.cache
def _comparator(kind: str):
    if kind not in compare.KINDS:
        raise ValueError(f"no comparator for kind {kind!r}")

    @F.arrow_udf(BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else compare.equivalent(kind, x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return run


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def realize(kind: str, text: Column | str) -> Column:
    """The written form of a whole text as one kind, or null."""
    ship(SparkSession.active())
    return _realizer(kind)(_col(text))


def realize_options(kind: str, text: Column | str) -> Column:
    ship(SparkSession.active())
    return _options(kind)(_col(text))


def realize_candidates(text: Column | str) -> Column:
    """array<struct<replacement, kind_mask>> of all kinds."""
    ship(SparkSession.active())
    return _candidates()(_col(text))


def representations_equivalent(kind: str, canonical: Column | str, observed: Column | str) -> Column:
    """Whether two written forms mean the same; null if either is null."""
    ship(SparkSession.active())
    return _comparator(kind)(_col(canonical), _col(observed))


def kind_names(mask: Column | str) -> Column:
    """A mask's kinds, native."""
    return F.filter(F.array(*map(F.lit, kinds.KINDS)), lambda k, i: F.getbit(_col(mask).cast("int"), i) == 1)


def kind_flags(mask: Column | str) -> Column:
    """A mask as an array of 13 numbers, 1 where the kind is set, native."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(kinds.KINDS) - 1)), lambda i: F.getbit(_col(mask).cast("int"), i).cast("float"))


def aligned_tokens(offsets: Column | str, start: Column | str, end: Column | str) -> Column:
    """struct<first, end>: the encoder tokens (array of structs start, end in order) that overlap characters start to end, or null unless they cover them all. Native."""
    o, a, b = _col(offsets), _col(start), _col(end)
    hit = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (F.element_at(o, i + 1)["start"] < b) & (F.element_at(o, i + 1)["end"] > a))
    first, last = F.element_at(hit, 1), F.element_at(hit, -1)
    covered = (F.element_at(o, first + 1)["start"] <= a) & (F.element_at(o, last + 1)["end"] >= b)
    return F.when((F.size(o) > 0) & (F.size(hit) > 0) & covered, F.struct(first.alias("first"), (last + 1).alias("end")))


def register(spark: SparkSession) -> None:
    """SQL functions realize_<kind>(text), realize_candidates(text), equivalent_<kind>(a, b), named_date(text, year) and numeric_date(text, order, year)."""
    ship(spark)
    for kind in kinds.KINDS:
        spark.udf.register(f"realize_{kind.lower()}", _realizer(kind))
    for kind in compare.KINDS:
        spark.udf.register(f"equivalent_{kind.lower()}", _comparator(kind))
    spark.udf.register("realize_candidates", _candidates())
    spark.udf.register("named_date", _named_date())
    spark.udf.register("numeric_date", _numeric_date())


@functools.cache
def _named_date():
    @F.arrow_udf(StringType())
    def run(texts: pa.Array, years: pa.Array) -> pa.Array:
        return pa.array([None if t is None else temporal.named_date(t, y) for t, y in zip(texts.to_pylist(), years.to_pylist())], pa.string())

    return run


@functools.cache
def _numeric_date():
    @F.arrow_udf(StringType())
    def run(texts: pa.Array, orders: pa.Array, years: pa.Array) -> pa.Array:
        return pa.array([None if t is None else temporal.numeric_date(t, o, y) for t, o, y in zip(texts.to_pylist(), orders.to_pylist(), years.to_pylist())], pa.string())

    return run


def named_date(text: Column | str, year: Column) -> Column:
    ship(SparkSession.active())
    return _named_date()(_col(text), year)


def numeric_date(text: Column | str, order: Column, year: Column) -> Column:
    ship(SparkSession.active())
    return _numeric_date()(_col(text), order, year)


def relative_day(phrase: Column | str, reference: Column) -> Column:
    """The date of a relative phrase that is the whole text, native: near days, bounded offsets, weekdays of this, the next or the last week."""
    p = F.lower(_col(phrase))
    table = lambda d: F.create_map(*[F.lit(x) for item in d.items() for x in item])
    counts, days = table(temporal.COUNTS), table({d: i for i, d in enumerate(temporal.WEEKDAYS)})
    near = F.element_at(table(temporal.RELATIVE), p)
    part = lambda pattern, i: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
    ahead, other, which = r"^in (\w+) (day|week)s?$", r"^(\w+) (day|week)s? (from now|from today|ago)$", r"^(this|next|last) (\w+)$"
    number = F.element_at(counts, F.coalesce(part(ahead, 1), part(other, 1)))
    offset = number * F.when(F.coalesce(part(ahead, 2), part(other, 2)) == "week", 7).otherwise(1) * F.when(part(other, 3) == "ago", -1).otherwise(1)
    weekday = F.element_at(days, part(which, 2)) - F.weekday(reference) + F.element_at(table(temporal.WHICH), part(which, 1))
    return F.date_add(reference.cast("date"), F.coalesce(near, offset, weekday))
