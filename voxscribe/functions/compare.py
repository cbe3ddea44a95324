"""
Whether two written forms mean the same, by kind.

Two texts that can't be read compare equal for the six kinds whose reading is compared as it is, and unequal for MONEY,
DATE and TIME, where a reading must exist on both sides.
"""

from __future__ import annotations

import functools
import re

from voxscribe.functions import clock, dates, measure, money
from voxscribe.functions.numbers import decimal_surface, decimal_value, lower, ordinal_number, roman_value

SPACES = r"[\s  ]"


def cardinal_key(text: str) -> tuple[bool, str] | None:
    body = re.sub(r"(?:['’]s|s)$", "", text.strip().rstrip(":-").strip())
    value = roman_value(body, strict=False)
    if value is not None:
        return False, str(value)
    m = re.fullmatch(rf"([+-]?)([0-9]+(?:(?:,{SPACES}?|{SPACES}|[.'’])?[0-9]+)*)", body)
    if not m:
        return None
    return m[1] == "-", re.sub("[^0-9]", "", m[2]).lstrip("0") or "0"


def decimal_key(text: str):
    return decimal_surface(text) or decimal_value(text)


def digits_key(text: str) -> str | None:
    if not re.fullmatch(rf"[0-9()\-‐‑‒–—./{SPACES[1:-1]}]*", text) or not re.search("[0-9]", text):
        return None
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return None
    return re.sub("[^0-9]", "", text) if depth == 0 else None


def measurement_key(text: str):
    return measure.surface(text) or measure.surface(re.sub(r"\s[A-Za-z]$", "", text.strip()))


def ordinal_key(text: str) -> int | None:
    return ordinal_number(text)


def phone_key(text: str) -> str | None:
    text = lower(text.strip())
    if m := re.fullmatch(r"(?:extension|ext\.?|x)\s*([0-9]+)", text):
        return f"extension:{m[1]}"
    if m := re.fullmatch(r"ssn(?:\s+is)?\s*([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})", text):
        return "ssn:" + re.sub("[^0-9]", "", m[1])
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text):
        return f"ip:{text}"
    if not re.fullmatch(rf"[+0-9a-z()\-–.{SPACES[1:-1]}]+", text) or not re.search("[0-9]", text):
        return None
    return "phone:" + re.sub("[^+0-9a-z]", "", text)


# Currency marks as written, besides codes and the displays of realized amounts.
MARKS = {"US$": "USD", "$US": "USD", "A$": "AUD", "AU$": "AUD", "C$": "CAD", "CA$": "CAD", "HK$": "HKD", "NZ$": "NZD", "S$": "SGD", "NT$": "TWD", "T$": "TWD", "MOP$": "MOP", "RD$": "DOP", "EC$": "XCD", "FJ$": "FJD", "J$": "JMD", "BZ$": "BZD", "BDS$": "BBD", "G$": "GYD", "ℳ": "DEM", "Tk": "BDT", "₹": "INR", "₩": "KRW", "₽": "RUB", "₫": "VND", "₱": "PHP", "₴": "UAH", "₺": "TRY", "₦": "NGN", "₲": "PYG", "฿": "THB", "₡": "CRC", "₸": "KZT", "₵": "GHS", "₭": "LAK", "₮": "MNT", "₾": "GEL", "₼": "AZN"}


@functools.cache
def _marks() -> tuple[dict[str, str], list[int]]:
    """Mark → code, and the marks' lengths from the longest down."""
    codes = {c: c for c, _ in money.names().values()}
    shown = {d: c for c, d in money.DISPLAYS.items()}
    marks = codes | shown | MARKS
    return marks, sorted({len(m) for m in marks}, reverse=True)


def money_key(text: str) -> tuple[str, str] | None:
    text = text.strip()
    sign = ""
    if text.startswith(("-", "−")):
        sign, text = "-", text[1:].strip()
    marks, lengths = _marks()
    for n in lengths:
        if text[:n] in marks and len(text) >= n:
            code, rest = marks[text[:n]], text[n:].strip()
        elif text[-n:] in marks and len(text) >= n:
            code, rest = marks[text[-n:]], text[:-n].strip()
        else:
            continue
        rest = re.sub(r"(?<=[0-9])\s+[A-Z]$", lambda m: m[0] if m[0].strip() in "MBKT" and "," not in rest else "", rest)
        m = re.fullmatch(r"([0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)\s*([A-Za-z]*)", rest)
        if not m:
            return None
        scale = lower(m[2])
        if scale and scale not in money.SCALES and scale not in ("k", "m", "mn", "b", "bn", "t"):
            return None
        power = money.SCALES.get(scale) or {"k": 3, "m": 6, "mn": 6, "b": 9, "bn": 9, "t": 12}.get(scale, 0)
        value = decimal_surface(m[1].replace(",", ""))
        if value is None:
            return None
        whole, _, part = (value.shifted(power).text() or "").partition(".")
        return code, f"{sign}{whole}.{part.lstrip('0')}"  # zeros that lead a fraction don't count
    return None


ERA = re.compile(r"\s*(B\.?\s?C\.?\s?E\.?|B\.?\s?C\.?|C\.?\s?E\.?|A\.?\s?D\.?|A\.?\s?F\.?)$")
NAMES = {m[:3]: i + 1 for i, m in enumerate(dates.MONTHS)} | {m: i + 1 for i, m in enumerate(dates.MONTHS)} | {"sept": 9}
DAYS = sorted([*dates.WEEKDAYS, *(d[:3] for d in dates.WEEKDAYS)], key=len, reverse=True)


def date_keys(text: str) -> set[tuple]:
    """Every reading of a written date: (kind, year, month, day, era)."""
    text, era = text.strip(), ""
    if m := ERA.search(text):
        if m.start() and text[m.start() - 1].isdigit() or m[0][0].isspace():
            era, text = re.sub(r"[.\s]", "", m[1]).upper(), text[: m.start()].strip()
    low = lower(text)
    if m := re.fullmatch(r"([0-9]{1,4})['’]?s", low):
        return {("period", int(m[1]), 0, 0, era)}
    if m := re.fullmatch(r"q([1-4])\s+([0-9]{4})", low):
        return {("quarter", int(m[2]), int(m[1]), 0, era)}
    if re.fullmatch("[0-9]{1,4}", low):
        return {("year", low, 0, 0, era)}
    if m := re.fullmatch(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})", low):
        return {("date", m[1], int(m[3]), int(m[4]), era)} if dates.valid(int(m[3]), int(m[4]), int(m[1])) else set()
    if m := re.fullmatch(r"([0-9]{1,2})([-/.])([0-9]{1,2})(?:\2([0-9]{4}|[0-9]{2}))?", low):
        a, b = int(m[1]), int(m[3])
        return {("date", m[4] or "", x, y, era) for x, y in ((a, b), (b, a)) if dates.valid(x, y)}
    for d in DAYS:
        if low.startswith(d) and (rest := low[len(d) :].lstrip(" ,.")) and any(rest.startswith(n) or rest[0].isdigit() for n in NAMES):
            low = rest
            break
    words = [w for w in re.split(r"[\s,.\-]+", low) if w and w not in ("the", "of")]
    month = [i for i, w in enumerate(words) if w in NAMES]
    if len(month) != 1 or len(words) > 3:
        return set()
    number, rest = NAMES[words[month[0]]], [w for i, w in enumerate(words) if i != month[0]]
    day, year = None, ""
    for w in rest:
        if m := re.fullmatch("([0-9]{1,2})(?:st|nd|rd|th)?", w):
            if day is None and not (year == "" and len(rest) == 1 and len(w) == 4):
                day = int(m[1])
            elif year == "":
                year = m[1]
            else:
                return set()
        elif re.fullmatch("[0-9]{3,4}", w) and not year:
            year = w
        else:
            return set()
    if day is None:
        return {("month", year, number, 0, era)} if year else set()
    return {("date", year, number, day, era)} if dates.valid(number, day) else set()


def _same_date(a: tuple, b: tuple) -> bool:
    if (a[0], *a[2:]) != (b[0], *b[2:]):
        return False
    x, y = sorted((str(a[1]), str(b[1])), key=len)
    return x == y or (len(x) == 2 and len(y) == 4 and y.endswith(x))


def time_key(text: str) -> tuple | None:
    low = lower(text.strip())
    m = re.fullmatch(r"(?:(am|pm)\s?)?([0-9]{1,2})(?:[:.]?([0-9]{2}))?(?::([0-9]{2}))?(?:\.([0-9]+))?\s*(a\.?\s?m\.?|p\.?\s?m\.?)?\s*(?:([a-z]+)(?:\s?([+-])\s?([0-9]{1,2})(?::([0-9]{2}))?)?)?", low)
    if not m or (m[1] and m[6]):
        return None
    period = (m[1] or re.sub(r"[.\s]", "", m[6] or ""))[:1]
    if m[3] is None and not period:
        return None
    hour, minute = int(m[2]), int(m[3] or 0)
    if m[7] and m[7] not in clock.ZONES or minute > 59 or hour > 24 or (m[4] and int(m[4]) > 59):
        return None
    if m[9] and (int(m[9]) > 23 or int(m[10] or 0) > 59):
        return None
    if period:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if period == "p" else 0)
    offset = (m[8], int(m[9]), int(m[10] or 0)) if m[9] else None
    return hour, minute, int(m[4] or 0) if m[4] else None, (m[5] or "").rstrip("0"), m[7] or "", offset


KEYS = {"CARDINAL": cardinal_key, "DECIMAL": decimal_key, "DIGIT_SEQUENCE": digits_key, "MEASUREMENT": measurement_key, "ORDINAL": ordinal_key, "PHONE": phone_key}
KINDS = [*KEYS, "MONEY", "DATE", "TIME"]


def equivalent(kind: str, canonical: str, observed: str) -> bool:
    if kind in KEYS:
        return KEYS[kind](canonical) == KEYS[kind](observed)
    if kind == "DATE":
        return any(_same_date(a, b) for a in date_keys(canonical) for b in date_keys(observed))
    if kind in ("MONEY", "TIME"):
        a, b = ((money_key if kind == "MONEY" else time_key)(t) for t in (canonical, observed))
        return a is not None and a == b
    raise ValueError(f"no comparator for kind {kind!r}; kinds with one: {', '.join(KINDS)}")
