"""Numbers, dates and times spelled out by native expressions: the spoken inputs of round trips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxscribe.functions.dates import MONTHS
from voxscribe.functions.numbers import DIGITS, ORDINALS, POWERS, TEENS, TENS

UNITS = [*DIGITS, *TEENS]
ROUND = list(TENS)
ORDINAL_OF = {v: k for k, v in ORDINALS.items()}


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))


def digits(text: Column) -> Column:
    """Digit by digit: "105" is "one zero five"."""
    return F.array_join(F.transform(F.split(text, ""), lambda d: _pick(list(DIGITS), d.cast("int"))), " ")


def below_hundred(n: Column) -> Column:
    n = n.cast("int")
    tens = _pick(ROUND, F.greatest(F.expr("0"), F.floor(n / 10).cast("int") - 2))
    return F.when(n < 20, _pick(UNITS, F.least(n, F.lit(19)))).otherwise(F.concat(tens, F.when(n % 10 > 0, F.concat(F.lit(" "), _pick(UNITS, n % 10))).otherwise("")))


def below_thousand(n: Column) -> Column:
    hundreds, rest = F.floor(n / 100).cast("int"), (n % 100).cast("int")
    head = F.when(hundreds > 0, F.concat(_pick(UNITS, hundreds), F.lit(" hundred")))
    tail = F.when((rest > 0) | (hundreds == 0), below_hundred(rest))
    return F.concat_ws(" ", head, tail)


def cardinal(n: Column) -> Column:
    """Any whole number that a long holds; whole division throughout, since a double would round those from 2 ** 53."""
    n = n.cast("long")
    group = lambda power: F.abs(F.call_function("div", n, F.lit(10**power).cast("long")) % 1000)
    parts = [F.when(group(power) > 0, F.concat(below_thousand(group(power)), F.lit(f" {name}"))) for name, power in reversed(POWERS.items()) if power <= 18]
    low = F.when((group(0) > 0) | (n == 0), below_thousand(group(0)))
    return F.when(n.isNotNull(), F.concat_ws(" ", F.when(n < 0, F.lit("minus")), *parts, low))


def ordinal(n: Column) -> Column:
    """A whole number from 1 to 99 as an ordinal."""
    n = n.cast("int")
    words = [ORDINAL_OF.get(i, "") for i in range(20)]
    tens, tenths = _pick(ROUND, F.greatest(F.lit(0), F.floor(n / 10).cast("int") - 2)), _pick([ORDINAL_OF[v] for v in TENS.values()], F.greatest(F.lit(0), F.floor(n / 10).cast("int") - 2))
    return F.when(n < 20, _pick(words, F.least(n, F.lit(19)))).when(n % 10 == 0, tenths).otherwise(F.concat(tens, F.lit(" "), _pick(words, n % 10)))


def clock(at: Column) -> Column:
    """Hour and minute: 13:05 is "thirteen oh five"."""
    h, m = F.hour(at), F.minute(at)
    tail = F.when(m == 0, F.lit("hundred")).when(m < 10, F.concat(F.lit("oh "), below_hundred(m))).otherwise(below_hundred(m))
    return F.concat_ws(" ", below_hundred(h), tail)


def year(n: Column) -> Column:
    """A year from 1000 to 2999 in two halves ("nineteen ninety five", "nineteen oh five", "nineteen hundred"), or as a number below 2010 from 2000."""
    head, tail = F.floor(n / 100).cast("int"), (n % 100).cast("int")
    halves = F.concat_ws(" ", below_hundred(head), F.when(tail == 0, F.lit("hundred")).when(tail < 10, F.concat(F.lit("oh "), below_hundred(tail))).otherwise(below_hundred(tail)))
    return F.when((n >= 2000) & (n < 2010), cardinal(n)).otherwise(halves)


def date(at: Column) -> Column:
    """Month, day, year: "march fourth nineteen ninety six"."""
    return F.concat_ws(" ", _pick(MONTHS, F.month(at) - 1), ordinal(F.dayofmonth(at)), year(F.year(at)))
