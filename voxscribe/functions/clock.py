"""Spoken times of day and durations."""

from __future__ import annotations

import re

from voxscribe.functions.numbers import DIGITS, SMALL, TEENS, TENS, ZEROS, lower

# Names of time zones.
ZONES = set("ut utc gmt z et ct mt pt est edt cst cdt mst mdt pst pdt ast adt nst ndt akst akdt hst hdt lint cet cest eet eest wet west bst jst kst wst chst aest aedt acst acdt awst nzst nzdt hast hadt sst gst sgt hkt msk myt ist irst irdt pkt wat pht met uzt".split())
# Phrases for the half of the day.
PERIODS = {"a.m.": ["a m", "am", "in the morning"], "p.m.": ["p m", "pm", "in the afternoon", "in the evening", "at night"]}
UNITS = {"hour": 0, "hours": 0, "minute": 1, "minutes": 1, "second": 2, "seconds": 2, "millisecond": 3, "milliseconds": 3}


def _split(text: str) -> list[str]:
    text = lower(text).replace("o'clock", "o clock").replace("o’clock", "o clock")
    text = re.sub(r"\b([ap])\.\s?m\.(?=\s|$)", r"\1 m", text)
    return re.sub("[-‐‑]", " ", text).split()


def _digit(w: str) -> int | None:
    return 0 if w in ZEROS else DIGITS.get(w)


def _number(words: list[str]) -> int | None:
    """A number below a hundred: one word, tens and unit, or digits."""
    if len(words) == 1:
        w = words[0]
        if w.isascii() and w.isdigit() and len(w) <= 2:
            return int(w)
        return 0 if w in ZEROS else (DIGITS | TEENS | TENS).get(w)
    if len(words) == 2 and words[0] in TENS and DIGITS.get(words[1], 0):
        return TENS[words[0]] + DIGITS[words[1]]
    return None


def _minute(words: list[str]) -> int | None:
    if len(words) == 2 and words[0] in ZEROS:
        return _digit(words[1])
    n = _number(words)
    return n if n is not None and n < 60 else None


def _clock(hour: int, minute: int, period: str, zone: str) -> str | None:
    if minute > 59 or hour > (12 if period else 24) or (hour == 24 and minute):
        return None
    return " ".join(x for x in (f"{hour:02d}:{minute:02d}", period, zone) if x)


def _take_period(words: list[str]) -> tuple[list[str], str]:
    for period, phrases in PERIODS.items():
        for phrase in phrases:
            tail = phrase.split()
            if len(words) > len(tail) and words[-len(tail) :] == tail:
                return words[: -len(tail)], period
    return words, ""


def zone_of(words: list[str]) -> str | None:
    """A time zone, spelled or as a word, perhaps with hours and minutes plus or minus."""
    at = next((i for i, w in enumerate(words) if w in ("plus", "minus")), len(words))
    name, offset = words[:at], words[at + 1 :]
    if not name or (len(name) > 1 and any(len(w) > 1 for w in name)) or "".join(name) not in ZONES:
        return None
    out = "".join(name).upper()
    if at == len(words):
        return out
    cut = offset.index("colon") if "colon" in offset else None
    hours, minutes = (offset, []) if cut is None else (offset[:cut], offset[cut + 1 :])
    h = _number(hours) if hours else None
    m = _number(minutes) if minutes else None
    if h is None or h > 23 or (cut is not None and (m is None or m > 59)):
        return None
    return f"{out}{'+' if words[at] == 'plus' else '-'}{h}" + (f":{m:02d}" if m is not None else "")


def _duration(words: list[str]) -> str | None:
    """Hours, minutes, seconds, milliseconds in falling order, two of them at least."""
    found, number = [], []
    for w in words:
        if w in UNITS:
            if not number or (number[0] == "and" and not found) or (found and UNITS[w] <= found[-1][0]):
                return None
            words_of_it = number[1:] if number[0] == "and" else number
            n = _number(words_of_it) if words_of_it else None
            if n is None:
                return None
            found.append((UNITS[w], n))
            number = []
        else:
            number.append(w)
    if number or len(found) < 2:
        return None
    of = dict(found)
    if any(n > limit for u, n in found for limit in [(99, 59, 59, 999)[u]]):
        return None
    if 0 in of:
        out = f"{of[0]:02d}:{of.get(1, 0):02d}" + (f":{of.get(2, 0):02d}" if 2 in of or 3 in of else "")
    else:
        out = f"{of.get(1, 0):02d}:{of.get(2, 0):02d}"
    return out + (f".{of[3]}" if 3 in of else "")


def _relative(words: list[str], period: str, zone: str) -> str | None:
    for i, w in enumerate(words):
        if w in ("past", "after", "to", "before"):
            head, tail = words[:i], words[i + 1 :]
            head = head[1:] if head[:1] == ["a"] else head
            head = head[:-1] if head[-1:] in (["minutes"], ["minute"]) else head
            minute = 15 if head == ["quarter"] else 30 if head == ["half"] else _number(head) if head else None
            hour = _number(tail) if tail else None
            if minute is None or not 0 < minute < 60 or hour is None:
                return None
            if w in ("to", "before"):
                hour, minute = {0: 23, 1: 12}.get(hour, hour - 1), 60 - minute
            return _clock(hour, minute, period, zone)
    return None


def _core(words: list[str], zone: str) -> str | None:
    words, period = _take_period(words)
    if not period and words in (["midnight"], ["noon"]):
        return _clock(0 if words[0] == "midnight" else 12, 0, "", zone)
    if not period and not zone and (d := _duration(words)):
        return d
    if any(w in ("past", "after", "to", "before") for w in words):
        return _relative(words, period, zone)
    if len(words) > 1 and words[-1] == "hundred":
        hour = _number(words[:-1])
        return _clock(hour, 0, period, zone) if hour is not None else None
    if len(words) > 2 and words[-2:] == ["o", "clock"]:
        hour = _number(words[:-2])
        return _clock(hour, 0, period, zone) if hour else None
    if (hour := _number(words)) is not None and (period or zone):
        return _clock(hour, 0, period, zone)
    for cut in (2, 1):  # the longer hour first: "twenty one five" is 21:05
        if len(words) > cut:
            hour, minute = _number(words[:cut]), _minute(words[cut:])
            if hour is not None and minute is not None and (made := _clock(hour, minute, period, zone)):
                return made
    return None


def time(text: str) -> str | None:
    words = _split(text)
    if len(words) > 4 and all(w in SMALL for w in words):  # an hour and a minute take two words each at most
        return None
    for cut in range(len(words), 0, -1):
        zone = zone_of(words[cut:]) if cut < len(words) else ""
        if zone is not None and (out := _core(words[:cut], zone)):
            return out
    return None
