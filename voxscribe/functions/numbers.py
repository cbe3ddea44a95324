"""Spoken English numbers: word lists to integers, digit strings, exact decimals and ordinals. Plain Python, no Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Number words.
DIGITS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
OH = {"oh", "o"}
ZEROS = {"zero", "oh", "o", "nought", "naught", "nil"}
POWERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12, "quadrillion": 15, "quintillion": 18, "sextillion": 21, "septillion": 24, "octillion": 27, "nonillion": 30, "decillion": 33, "undecillion": 36}
REPEATS = {"single": 1, "double": 2, "triple": 3, "quadruple": 4}
SIGNS = {"minus": "-", "negative": "-", "plus": "", "positive": ""}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90}

SMALL = DIGITS | TEENS | TENS
LARGEST = 2**127 - 1
HYPHENS = re.compile("[-‐‑‒–—−]")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MOST_DIGITS = 1_000_000


def lower(text: str) -> str:
    """Lower case for ASCII letters alone."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def words_of(text: str) -> list[str]:
    """Lower-case words, hyphenated ones apart."""
    return HYPHENS.sub(" ", lower(text)).split()


def _joined_by_and(words: list[str]) -> list[str] | None:
    """The words without 'and', which must stand singly between others."""
    if not words or words[0] == "and" or words[-1] == "and":
        return None
    if any(a == b == "and" for a, b in zip(words, words[1:])):
        return None
    return [w for w in words if w != "and"]


def spoken_integer(words: list[str]) -> int | None:
    """
    The value of a number in words: single digits in a row are read off ("one oh five" 105), other small numbers without a
    scale between add up ("two thirty" 32), scales must fall.
    """
    if len(words) > 1 and all(w in DIGITS or w in OH for w in words):
        n = int("".join(str(DIGITS.get(w, 0)) for w in words))
        return n if n <= LARGEST else None
    plain = _joined_by_and(words)
    if not plain:
        return None
    total, group, before, filled = 0, 0, None, False
    for w in plain:
        if w in SMALL:
            group, filled = group + SMALL[w], True
        elif w == "hundred":
            group, filled = (group if filled else 1) * 100, True
        elif w in POWERS:
            if before is not None and POWERS[w] >= before:
                return None
            before = POWERS[w]
            total += (group if filled else 1) * 10**before
            group, filled = 0, False
        else:
            return None
    n = total + group
    return n if n <= LARGEST else None


def groups_read_off(words: list[str]) -> str | None:
    """Digits of groups below a hundred one after another: "seven eighty eight" 788, "ten oh five" 1005."""
    out, i = [], 0
    while i < len(words):
        w = words[i]
        if w in DIGITS or w in OH:
            out.append(str(DIGITS.get(w, 0)))
        elif w in TEENS:
            out.append(str(TEENS[w]))
        elif w in TENS:
            n = TENS[w]
            if i + 1 < len(words) and DIGITS.get(words[i + 1], 0):
                i += 1
                n += DIGITS[words[i]]
            out.append(str(n))
        else:
            return None
        i += 1
    return "".join(out) if out else None


def digit_word(w: str) -> str | None:
    return "0" if w in ZEROS else str(DIGITS[w]) if w in DIGITS else None


def digit_sequence(text: str) -> str | None:
    """Digits spoken one by one or written, with repetition words ("double oh seven" 007)."""
    out, times = [], 0
    for w in lower(text).split():
        if w in REPEATS:
            if times:
                return None
            times = REPEATS[w]
        elif w.isascii() and w.isdigit():
            if times and len(w) > 1:
                return None
            out.append(w * max(times, 1))
            times = 0
        else:
            d = digit_word(w)
            if d is None:
                return None
            out.append(d * max(times, 1))
            times = 0
    return "".join(out) if out and not times else None


def grouped_digits(text: str) -> str | None:
    """At least two groups from 10 to 99: "twenty three forty five" 2345."""
    out, words, i = [], words_of(text), 0
    while i < len(words):
        w = words[i]
        if w in TEENS:
            out.append(str(TEENS[w]))
        elif w in TENS:
            n = TENS[w]
            if i + 1 < len(words) and DIGITS.get(words[i + 1], 0):
                i += 1
                n += DIGITS[words[i]]
            out.append(str(n))
        else:
            return None
        i += 1
    return "".join(out) if len(out) > 1 else None


def cardinal(text: str) -> str | None:
    words = words_of(text)
    sign, rest = (SIGNS[words[0]], words[1:]) if words and words[0] in SIGNS else ("", words)
    if not rest or rest[0] in SIGNS:
        return None
    n = spoken_integer(rest)
    if n is not None:
        return f"{sign}{n}"
    return digit_sequence(text) if rest is words else None


def cardinal_options(text: str) -> list[str]:
    """The canonical reading, then the one that reads groups off if it differs."""
    words, first = words_of(text), cardinal(text)
    out = [first] if first is not None else []
    if first is not None or any(w in OH for w in words):
        other = groups_read_off(words)
        if other is not None and other not in out and len(other) < 39 and str(int(other)) == other:
            out.append(other)
    return out


@dataclass(frozen=True)
class Decimal:
    """±digits * 10 ** -scale in lowest form; zero keeps its sign."""

    negative: bool
    digits: str
    scale: int

    @classmethod
    def of(cls, negative: bool, digits: str, scale: int) -> Decimal:
        digits = digits.lstrip("0")
        if not digits:
            return cls(negative, "0", 0)
        kept = digits.rstrip("0")
        return cls(negative, kept, scale - (len(digits) - len(kept)))

    def shifted(self, power: int) -> Decimal:
        return Decimal.of(self.negative, self.digits, self.scale - power)

    def text(self) -> str | None:
        """Plain digits; None beyond MOST_DIGITS characters."""
        if self.scale <= 0:
            if len(self.digits) - self.scale > MOST_DIGITS:
                return None
            body = self.digits + "0" * -self.scale
        else:
            if self.scale > MOST_DIGITS:
                return None
            padded = self.digits.rjust(self.scale + 1, "0")
            body = f"{padded[:-self.scale]}.{padded[-self.scale:]}"
        return "-" * self.negative + body


def _scaled_integer(words: list[str]) -> int | None:
    """A number in words, or one times a last scale that need not fall ("two thousand five hundred million")."""
    n = spoken_integer(words)
    if n is None and len(words) > 1 and words[-1] in POWERS:
        head = spoken_integer(words[:-1])
        n = head * 10 ** POWERS[words[-1]] if head is not None else None
    return n if n is not None and n <= LARGEST else None


def _fraction_digits(words: list[str]) -> str | None:
    out = [digit_word(w) if not (w.isascii() and w.isdigit()) else w for w in words]
    return "".join(out) if out and None not in out else None


def decimal_words(words: list[str]) -> Decimal | None:
    """A spoken decimal: sign, integer, point and digits, at most one scale after the digits, power of ten."""
    for i in range(len(words) - 4):
        if words[i : i + 4] == ["times", "ten", "to", "the"]:
            mantissa, power = decimal_words(words[:i]), words[i + 4 :]
            sign = -1 if power[0] in ("minus", "negative") else 1
            power = power[1:] if power[0] in SIGNS else power
            n = spoken_integer(power) if power else None
            if n is None and power and power[-1] in ORDINALS:
                n = ordinal_value(power)
            return mantissa.shifted(sign * n) if mantissa is not None and n is not None else None
    negative = bool(words) and words[0] in ("minus", "negative")
    if words and words[0] in SIGNS:
        words = words[1:]
    if not words or words[0] in SIGNS:
        return None
    at = [i for i, w in enumerate(words) if w in ("point", "dot")]
    if not at:
        n = _scaled_integer(words)
        return Decimal.of(negative, str(n), 0) if n is not None else None
    if len(at) > 1:
        return None
    whole, part = words[: at[0]], words[at[0] + 1 :]
    power = 0
    if part and part[-1] in POWERS:
        power, part = POWERS[part[-1]], part[:-1]
    n = _scaled_integer(whole) if whole else 0
    if n is None and len(whole) == 1 and whole[0].isascii() and whole[0].isdigit():
        n = int(whole[0])
    digits = _fraction_digits(part)
    if n is None or digits is None:
        return None
    return Decimal.of(negative, f"{n}{digits}", len(digits)).shifted(power)


SUFFIXES = {"k": 3, "m": 6, "mn": 6, "b": 9, "bn": 9, "t": 12, "tn": 12, "q": 15} | POWERS
SURFACE = re.compile(r"([+-]?)([0-9.,\s'’   ]*[0-9][0-9.,\s'’   ]*)(?:e([+-]?[0-9]+))?\s*([a-z]*)", re.I)


def _mantissa(text: str) -> tuple[str, int] | None:
    """Digits and scale of a written number; tells grouping from decimal separators."""
    if text != text.strip():
        return None
    text = re.sub(r"[\s'’   ]", "_", text)
    groups = "_" in text
    commas, dots = text.count(","), text.count(".")
    mark = None
    if commas and dots:
        mark = "," if text.rfind(",") > text.rfind(".") else "."
        group = "." if mark == "," else ","
    elif commas == 1:
        head, tail = text.split(",")
        mark, group = (None, ",") if len(tail) == 3 and 1 <= len(head.lstrip("_")) <= 3 and head.isdigit() and head != "0" else (",", "_")
    elif dots == 1:
        mark, group = ".", "_"
    else:
        group = "," if commas else "." if dots else "_"
    if groups and group != "_":
        text = text.replace("_", "") if re.fullmatch(r"[0-9]{1,3}(?:,_?[0-9]{3})+", text) else text
    whole, _, part = text.rpartition(mark) if mark else (text, "", "")
    if mark and text.count(mark) > 1:
        return None
    if part and not part.isdigit():
        return None
    if not whole:
        return (part, len(part)) if part else None
    if not re.fullmatch(rf"[0-9]+|[0-9]{{1,3}}(?:{re.escape(group)}[0-9]{{3}})+", whole):
        return None
    return re.sub("[^0-9]", "", whole) + part, len(part)


def decimal_surface(text: str) -> Decimal | None:
    """A written number: grouping, decimal comma or point, exponent, scale suffix, parentheses for negative."""
    text = text.strip()
    negative = False
    if text.startswith("(") and text.endswith(")"):
        negative, text = True, text[1:-1].strip()
    m = SURFACE.fullmatch(text)
    if not m or (negative and m[1]):
        return None
    parsed = _mantissa(m[2].strip())
    suffix = lower(m[4])
    if parsed is None or (suffix and suffix not in SUFFIXES):
        return None
    if m[3] and len(m[3]) > 9:
        return None
    value = Decimal.of(negative or m[1] == "-", *parsed)
    return value.shifted(int(m[3] or 0) + SUFFIXES.get(suffix, 0))


def decimal_value(text: str) -> Decimal | None:
    words = words_of(text) if not re.search("[0-9]", text) else lower(text).split()
    return decimal_words(words) or decimal_surface(text)


def decimal(text: str) -> str | None:
    value = decimal_value(text)
    return value.text() if value is not None else None


def suffix_of(n: int) -> str:
    """st, nd, rd or th."""
    return "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_text(n: int) -> str:
    out = ""
    for value, mark in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += mark * (n // value)
        n %= value
    return out


def roman_value(text: str, strict: bool = True) -> int | None:
    """The value of a Roman numeral; strict: in its canonical spelling alone."""
    if not text or any(c not in ROMAN for c in text):
        return None
    values = [ROMAN[c] for c in text]
    n = sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))
    return n if 0 < n < 4000 and (not strict or roman_text(n) == text) else None


def ordinal_value(words: list[str]) -> int | None:
    """The value of an ordinal in words; only its last word is ordinal."""
    if words and words[0] == "the":
        words = words[1:]
    if not words or _joined_by_and(words) is None:
        return None
    last = words[-1]
    if last in ORDINALS:
        head, n = words[:-1], ORDINALS[last]
        if head and head[-1] == "and":
            head = head[:-1]
        if not head:
            return n
        tail = [w for w, v in SMALL.items() if v == n]
        joins = head[-1] == "hundred" or head[-1] in POWERS or (head[-1] in TENS and n < 10)
        return spoken_integer([*head, *tail]) if tail and joins else None
    if last.endswith("th") and (last[:-2] in POWERS or last == "hundredth"):
        scale = last[:-2]
        return spoken_integer([*words[:-1], scale]) if len(words) > 1 else spoken_integer(["one", scale])
    return None


def ordinal_number(text: str) -> int | None:
    """The value of an ordinal in words, digits with a fitting suffix, or Roman numerals."""
    text = text.strip()
    m = re.fullmatch(r"([0-9]{1,3}(?:,\s?[0-9]{3})+|[0-9]+)\s?(st|nd|rd|th|º|ª)(s?)", text, re.I)
    if m:
        n = int(re.sub("[^0-9]", "", m[1]))
        if n <= LARGEST and (m[2] in "ºª" and not m[3] or lower(m[2]) == suffix_of(n)):
            return n
        return None
    m = re.fullmatch(r"([IVXLCDM]+)(st|nd|rd|th)?\.?", text)
    if m and (n := roman_value(m[1])):
        return n if m[2] in (None, suffix_of(n)) else None
    words = words_of(text)
    if len(words) == 1 and words[0].endswith("s") and words[0][:-1] in ORDINALS:
        words = [words[0][:-1]]
    return ordinal_value(words)


def ordinal(text: str) -> str | None:
    n = ordinal_number(text) if not text.strip().endswith(".") else None
    return f"{n}{suffix_of(n)}" if n is not None else None
