"""Dispatch of the thirteen kinds over whole span texts."""

from __future__ import annotations

import functools

from voxscribe.functions import clock, dates, measure, money, words
from voxscribe.functions import numbers as n

#: Kinds in the order of their bits in a mask.
KINDS = ["DIGIT_SEQUENCE", "CARDINAL", "TIME", "DATE", "MONEY", "DECIMAL", "PHONE", "ELECTRONIC", "MEASUREMENT", "ORDINAL", "PUNCTUATION", "WHITELIST", "WORD"]

PLACE = {k: 1 << i for i, k in enumerate(KINDS)}

REALIZERS = {
    "DIGIT_SEQUENCE": lambda t: n.digit_sequence(t) or n.grouped_digits(t),
    "CARDINAL": n.cardinal,
    "TIME": clock.time,
    "DATE": dates.date,
    "MONEY": money.money,
    "DECIMAL": n.decimal,
    "PHONE": words.phone,
    "ELECTRONIC": words.electronic,
    "MEASUREMENT": measure.measurement,
    "ORDINAL": n.ordinal,
    "PUNCTUATION": words.punctuation,
    "WHITELIST": words.abbreviation,
    "WORD": words.word,
}


def _known(kind: str) -> None:
    if kind not in REALIZERS:
        raise ValueError(f"unknown kind {kind!r}; kinds: {', '.join(KINDS)}")


def realize(kind: str, text: str | None) -> str | None:
    """The written form of a whole span as one kind; null for null or blank text and wherever a word is left over."""
    _known(kind)
    return REALIZERS[kind](text) if text and not text.isspace() else None


def realize_options(kind: str, text: str | None) -> list[str]:
    """All readings: CARDINAL may have two, other kinds have one at most."""
    _known(kind)
    if not text or text.isspace():
        return []
    if kind == "CARDINAL":
        return n.cardinal_options(text)
    out = REALIZERS[kind](text)
    return [] if out is None else [out]


def candidates(text: str | None, kinds: list[str] = KINDS) -> list[tuple[str, int]]:
    """(replacement, mask of kinds) of every reading that changes the text, equal replacements merged, sorted."""
    if not text or text.isspace():
        return []
    merged: dict[str, int] = {}
    for kind in kinds:
        for out in n.cardinal_options(text) if kind == "CARDINAL" else (REALIZERS[kind](text),):
            if out is not None and out != text:
                merged[out] = merged.get(out, 0) | PLACE[kind]
    return sorted(merged.items())


@functools.cache
def kinds_of(mask: int) -> list[str]:
    return [k for i, k in enumerate(KINDS) if mask >> i & 1]
