"""Rewriting without context: the longest readable span from the left, by a fixed order of kinds; and the way back, from written to spoken."""

from __future__ import annotations

import re

from voxscribe.functions import decode, gate
from voxscribe.functions import numbers as n
from voxscribe.functions.dates import MONTHS
from voxscribe.functions.realize import KINDS, candidates

ORDER = ["WHITELIST", "MONEY", "TIME", "DATE", "MEASUREMENT", "ELECTRONIC", "PHONE", "ORDINAL", "DECIMAL", "CARDINAL", "WORD", "DIGIT_SEQUENCE"]


def normalize_sentence(text: str) -> str:
    """Left to right, the longest span that any kind reads, as the first kind of the order; an abbreviated phrase is a span by itself."""
    at = decode.tokens(text)
    words = [text[a:b] for a, b in at]
    masks, ends = gate.masks(words, text), gate.address_ends(words)
    place = {b: j for j, (_, b) in enumerate(at, 1)}
    chosen, i = [], 0
    while i < len(at):
        runs, left = [], gate.ALL & ~gate.BIT["WHITELIST"]
        for j in range(i, len(at)):
            left &= masks[j] if j < ends[i] else masks[j] & ~gate.BIT["ELECTRONIC"]
            if not left:
                break
            runs.append((j + 1, [k for k in ORDER if left & gate.BIT[k]]))
        phrase = gate.PHRASES.match(text, at[i][0])
        if phrase and phrase.end() in place:
            runs.append((place[phrase.end()], ["WHITELIST"]))
        for j, kinds in sorted(runs, key=lambda r: -r[0]):
            span = text[at[i][0] : at[j - 1][1]]
            found = candidates(span, kinds)
            if found:
                best = min(found, key=lambda c: min(ORDER.index(k) for k in ORDER if c[1] >> KINDS.index(k) & 1))
                chosen.append(decode.Candidate(i, j, at[i][0], at[j - 1][1], span, *best))
                i = j
                break
        else:
            i += 1
    return decode.render(text, chosen)[0]


SMALL = {v: k for k, v in n.SMALL.items()}
ORDINAL = {v: k for k, v in n.ORDINALS.items()}
SCALES = sorted(((10**p, w) for w, p in n.POWERS.items()), reverse=True) + [(100, "hundred")]


def cardinal(value: int) -> str:
    """The words of a whole number below 10 ** 39."""
    if value < 0:
        return f"minus {cardinal(-value)}"
    if value in SMALL:
        return SMALL[value]
    if value < 100:
        return f"{SMALL[value - value % 10]} {SMALL[value % 10]}"
    size, name = next(s for s in SCALES if s[0] <= value)
    return f"{cardinal(value // size)} {name}" + (f" {cardinal(value % size)}" if value % size else "")


def ordinal(value: int) -> str:
    head, _, last = cardinal(value).rpartition(" ")
    said = ORDINAL[n.SMALL[last]] if last in n.SMALL else f"{last}th"
    return f"{head} {said}".strip()


def digits(text: str) -> str:
    return " ".join(SMALL[int(d)] for d in text if d.isdigit())


def _clock(m: re.Match) -> str:
    hour, minute, period = int(m[1]), int(m[2]), (m[3] or "").replace(".", "").lower()
    tail = "hundred" if minute == 0 and not period else "" if minute == 0 else f"oh {cardinal(minute)}" if minute < 10 else cardinal(minute)
    return " ".join(x for x in (cardinal(hour), tail, " ".join(period)) if x)


def _money(m: re.Match) -> str:
    whole, cents = int(m[1].replace(",", "")), int((m[2] or "0").ljust(2, "0"))
    out = f"{cardinal(whole)} dollar{'s' * (whole != 1)}"
    return out + (f" and {cardinal(cents)} cent{'s' * (cents != 1)}" if cents else "")


WRITTEN = [
    (re.compile(r"\$([0-9][0-9,]*)(?:\.([0-9]{1,2}))?(?![0-9])"), _money),
    (re.compile(r"\b([01]?[0-9]|2[0-3]):([0-5][0-9])(?:\s?([ap]\.?m\.?))?"), _clock),
    (re.compile(rf"\b({'|'.join(MONTHS)}) ([0-9]{{1,2}})(?:st|nd|rd|th)?\b", re.I), lambda m: f"{m[1]} {ordinal(int(m[2]))}"),
    (re.compile(r"\b([0-9]{3})-([0-9]{3})-([0-9]{4})\b"), lambda m: digits(m[0])),
    (re.compile(r"\b([0-9]+)(?:st|nd|rd|th)\b"), lambda m: ordinal(int(m[1]))),
    (re.compile(r"(?<![0-9.])(-?[0-9]+)\.([0-9]+)(?![0-9.])"), lambda m: f"{cardinal(int(m[1]))} point {digits(m[2])}"),
    (re.compile(r"([0-9]+)%"), lambda m: f"{cardinal(int(m[1]))} percent"),
    (re.compile(r"\b0[0-9]+\b"), lambda m: digits(m[0])),
    (re.compile(r"\b[0-9]{1,3}(?:,[0-9]{3})+\b|\b[0-9]+\b"), lambda m: cardinal(int(m[0].replace(",", "")))),
]


def verbalize(text: str) -> str:
    """Written amounts, times, dates, phones, ordinals, decimals and numbers as words."""
    for pattern, say in WRITTEN:
        text = pattern.sub(say, text)
    return text
