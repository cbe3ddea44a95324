"""Spoken dates, years, decades and eras, and what the calendar allows."""

from __future__ import annotations

import re

from voxscribe.functions.numbers import DIGITS, OH, ORDINALS, SMALL, TEENS, TENS, groups_read_off, lower, ordinal_value, spoken_integer

# Names of the calendar.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
LONGEST = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
ERAS = {"b c e": "BCE", "b c": "BC", "c e": "CE", "a d": "AD"}


def leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def valid(month: int, day: int, year: int | None = None) -> bool:
    return 1 <= month <= 12 and 1 <= day <= LONGEST[month - 1] and not (month == 2 and day == 29 and year is not None and not leap(year))


def _pair(words: list[str]) -> str | None:
    """Two digits: teens, tens with or without unit, or oh and a digit."""
    if len(words) == 1 and words[0] in TEENS | TENS:
        return str((TEENS | TENS)[words[0]])
    if len(words) == 2:
        if words[0] in TENS and DIGITS.get(words[1], 0):
            return str(TENS[words[0]] + DIGITS[words[1]])
        if words[0] in OH | {"zero"} and (words[1] in DIGITS or words[1] in OH):
            return f"0{DIGITS.get(words[1], 0)}"
    return None


def year(words: list[str]) -> str | None:
    """Three or four digits (or two after an oh) as years are said."""
    if not words:
        return None
    if len(words) == 1 and re.fullmatch("[0-9]{4}", words[0]):
        return words[0]
    short = _pair(words)
    if short is not None and words[0] in OH:
        return short
    for cut in range(1, len(words)):
        head, tail = _pair(words[:cut]), _pair(words[cut:])
        if head and tail and head[0] != "0":
            return head + tail
        if cut == 1 and DIGITS.get(words[0], 0) and tail:
            return f"{DIGITS[words[0]]}{tail}"
    if words[-1] == "hundred" and (head := _pair(words[:-1]) or (str(DIGITS[words[0]]) if len(words) == 2 and DIGITS.get(words[0], 0) else None)):
        return head + "00"
    n = spoken_integer(words) if "thousand" in words or "hundred" in words else None
    return str(n) if n is not None and 100 <= n < 10000 else None


def _two_digits(words: list[str]) -> str | None:
    """A year of two digits after a full day and month."""
    short = _pair(words)
    if short is None and len(words) == 1 and DIGITS.get(words[0], 0):
        return None
    return short


DECADES = {"twenties": 20, "thirties": 30, "forties": 40, "fifties": 50, "sixties": 60, "seventies": 70, "eighties": 80, "nineties": 90}


def _plural(words: list[str]) -> str | None:
    """Decades and centuries: "nineteen hundreds" 1900s, "seven forties" 740s."""
    last = words[-1]
    if last in ("hundreds", "thousands"):
        n = spoken_integer([*words[:-1], last[:-1]]) if len(words) > 1 else None
        return f"{n}s" if n else None
    if last in DECADES:
        if len(words) == 1:
            return f"{DECADES[last]}s"
        head = _pair(words[:-1]) or (str(DIGITS[words[0]]) if len(words) == 2 and DIGITS.get(words[0], 0) else None)
        return f"{head}{DECADES[last]}s" if head else None
    return None


def _day(words: list[str]) -> int | None:
    """A day of the month, ordinal or cardinal."""
    n = ordinal_value(words) if words[-1] in ORDINALS else None
    if n is None and len(words) <= 2 and not (len(words) == 2 and words[0] in DIGITS):
        n = spoken_integer(words)
    if n is None and len(words) == 1 and (m := re.fullmatch("([0-9]{1,2})(?:st|nd|rd|th)?", words[0])):
        n = int(m[1])
    return n if n and 1 <= n <= 31 else None


def _numeric(words: list[str]) -> str | None:
    """Fields with slash, dash or dot between, one kind of mark; two fields, or three with one year of four digits."""
    marks = {"slash": "/", "dash": "-", "dot": "."}
    used = {w for w in words if w in marks}
    if len(used) != 1:
        return None
    mark = used.pop()
    fields = [f.split() for f in " ".join(words).split(mark)]
    if len(fields) not in (2, 3) or not all(fields):
        return None
    out = []
    for f in fields:
        n = spoken_integer(f) if len(f) <= 2 and not (len(f) == 2 and f[0] in DIGITS) else None
        if n is None and len(f) == 1 and f[0].isdigit():
            n = int(f[0])
        y = year(f)
        out.append(str(n) if n is not None and 1 <= n <= 31 else y if y and len(y) == 4 else None)
    if None in out or sum(len(x) == 4 for x in out) != len(fields) - 2:
        return None
    if len(fields) == 2 and not any(valid(int(a), int(b)) for a, b in (out, out[::-1])):
        return None
    return marks[mark].join(out)


def _month_first(words: list[str]) -> str | None:
    if words[0] not in MONTHS:
        return None
    month, rest = MONTHS.index(words[0]) + 1, words[1:]
    if not rest:
        return None
    named = []
    for cut in range(1, min(3, len(rest)) + 1):
        day = _day(rest[1:cut] if rest[0] == "the" and cut > 1 else rest[:cut]) if rest[:cut] != ["the"] else None
        if day is None:
            continue
        tail = rest[cut:]
        if not tail:
            named.append((rest[cut - 1] in ORDINALS, cut, f"{words[0]} {day}", valid(month, day)))
        else:
            y = year(tail) or (_two_digits(tail) if rest[cut - 1] in ORDINALS else None)
            if y:
                full = int(y) if len(y) > 2 else None
                named.append((rest[cut - 1] in ORDINALS, cut, f"{words[0]} {day} {y}", valid(month, day, full)))
    sure = [n for n in named if n[0]]
    alone = year(rest)
    if alone and not sure:
        return f"{words[0]} {alone}"
    best = sure or named
    return (best[-1][2] if best[-1][3] else None) if best else None


def _day_first(words: list[str]) -> str | None:
    if words[0] == "the":
        words = words[1:]
    at = next((i for i, w in enumerate(words) if w in MONTHS), None)
    if not at:
        return None
    head = words[: at - 1] if words[at - 1] == "of" else words[:at]
    day = _day(head) if head else None
    if day is None or head[-1] not in ORDINALS and words[at - 1] == "of":
        return None
    month, tail = MONTHS.index(words[at]) + 1, words[at + 1 :]
    if not tail:
        return f"{day} {words[at]}" if valid(month, day) else None
    y = year(tail) or _two_digits(tail)
    return f"{day} {words[at]} {y}" if y and valid(month, day, int(y) if len(y) > 2 else None) else None


def _plain(words: list[str]) -> str | None:
    return _plural(words) or _day_first(words) or _month_first(words) or year(words)


def _bare_year(words: list[str]) -> str | None:
    y = year(words) or groups_read_off(words)
    if y is None:
        n = spoken_integer(words)
        y = str(n) if n and n < 100_000 else None
    return y


def date(text: str) -> str | None:
    words = re.sub("[-‐‑]", " ", lower(text)).split()
    if not words or len(words) > 4 and all(w in SMALL for w in words):  # a year without scales takes four words at most
        return None
    if any(w in ("slash", "dash", "dot") for w in words):
        return _numeric(words)
    if words[0] in WEEKDAYS and len(words) > 1:
        rest = words[1:]
        out = _day_first(rest) or _month_first(rest)
        return f"{words[0]} {out}" if out and re.search("[a-z]", out) else None
    out = _plain(words)
    if out:
        return out
    for n in (3, 2, 1):  # an era is said letter by letter
        tail, head = words[-n:], words[:-n]
        if head and len(tail) == n and all(len(w) == 1 and w.isalpha() and w not in OH for w in tail) and n > 1:
            era = "".join(tail).upper()
            if (full := _day_first(head) or _month_first(head)) and " ".join(tail) in ERAS:
                return f"{full} {era}"
            y = _bare_year(head)
            return f"{y}{era}" if y else None
    return None
