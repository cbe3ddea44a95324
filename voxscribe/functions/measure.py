"""Spoken measurements: exact rational values and units made from prefixes and bases."""

from __future__ import annotations

import functools
import re
from fractions import Fraction

from voxscribe.functions.numbers import DIGITS, HYPHENS, ORDINALS, POWERS, SIGNS, decimal_words, lower, ordinal_value, spoken_integer

# Prefixes and units.
PREFIXES = {"": "", "peta": "P", "tera": "T", "giga": "G", "mega": "M", "kilo": "k", "hecto": "h", "deca": "da", "deci": "d", "centi": "c", "milli": "m", "micro": "μ", "nano": "n", "pico": "p"}
SCALED = {"meter": "m", "metre": "m", "gram": "g", "second": "s", "liter": "L", "litre": "L", "watt": "W", "volt": "V", "ampere": "A", "amp": "A", "joule": "J", "pascal": "Pa", "hertz": "Hz", "newton": "N", "farad": "F", "henry": "H", "coulomb": "C", "siemens": "S", "sievert": "Sv", "becquerel": "Bq", "ohm": "Ω", "bit": "bit", "byte": "B", "calorie": "cal", "mole": "mol", "bar": "bar", "watt hour": "Wh", "amp hour": "Ah", "electron volt": "eV"}
SINGLE = {"inch": "in", "foot": "ft", "yard": "yd", "mile": "mi", "ounce": "oz", "fluid ounce": "fl oz", "pound": "lb", "stone": "st", "ton": "ton", "tonne": "ton", "gallon": "gal", "barrel": "bbl", "acre": "acre", "hectare": "ha", "minute": "min", "hour": "h", "day": "day", "week": "week", "month": "month", "year": "yr", "light year": "ly", "degree": "°", "percent": "%", "knot": "kt", "lumen": "lm", "candela": "cd", "decibel": "dB", "dalton": "Da", "chain": "ch", "atmosphere": "atm", "horsepower": "hp", "hundredweight": "cwt", "kelvin": "K", "celsius": "°C", "fahrenheit": "°F", "degree celsius": "°C", "degree fahrenheit": "°F", "degree c": "°C", "degree f": "°F", "neper": "Np", "astronomical unit": "AU", "atomic mass unit": "amu", "c c": "cm³", "kilogram force": "kgf", "millimeter of mercury": "mmHg", "pixel per inch": "ppi", "revolution per minute": "rpm", "mile per hour": "mph", "bit per second": "bps", "newton meter": "Nm"}
AREAS = {"inch": "in", "foot": "ft", "yard": "yd", "mile": "mi"}
#: Spoken units whose symbol isn't that of the rule above.
SPECIAL = {
    "liter": "l",
    "milliliter": "ml",
    "centiliter": "cl",
    "micro liter": "µL",
    "micro litre": "µL",
    "micro ampere": "µA",
    "micro pascal": "µPa",
    "microgram": "ug",
    "microsecond": "us",
    "millivolt": "mv",
    "ohm": "ohm",
    "pascal": "pa",
    "byte": "b",
    "decibel": "db",
    "astronomical unit": "au",
    "c c": "cc",
    "gigawatt hour": "gWh",
    "megabit": "mbit",
    "gigabit": "gbit",
    "kilobit": "kbit",
    "terabit": "tbit",
    "tera bit": "Tb",
    "petabit": "Pb",
    "peta bit": "Pb",
    "mega siemens": "ms",
    "pico siemen": "pS",
    "kilobit per second": "Kb/s",
    "megabit per second": "Mb/s",
    "gigabit per second": "Gb/s",
    "kilobyte per second": "KB/s",
    "kilo byte per second": "KB/s",
    "kilogram force": "kgf",
    "barrel of oil per day": "bpd",
    "gallon per minute": "gal/min",
    "per square second": "/s²",
    "per year": "/year",
    "per barrel": "/barrel",
    "per square mile": "/mi²",
    "per mega gram": "/Mg",
}
PLURALS = {"foot": "feet", "inch": "inches", "henry": "henrys"}
#: Symbols as they are written, besides those that the units above have.
WRITTEN = {"%": "%", "p.c.": "%", "percent": "%", '"': "in", "'": "ft", "mi²": "sq mi", "ft²": "sq ft", "in²": "sq in", "yd²": "sq yd", "cm3": "cm³", "m3": "m³", "km2": "km²", "m2": "m²", "GB": "GB", "Gb": "Gbit", "Mb": "Mbit", "Kb": "kbit", "kb": "kbit", "l": "L", "ml": "mL", "uL": "μL", "µm": "μm", "um": "μm", "h": "h", "hr": "h", "min": "min", "sec": "s", "kph": "km/h", "KB": "KB"}


def _plural(name: str) -> str:
    head, _, last = name.rpartition(" ")
    if last in ("hertz", "siemens", "horsepower", "hundredweight", "kelvin", "celsius", "fahrenheit", "percent", "c", "f"):
        last_plural = last
    else:
        last_plural = PLURALS.get(last, last + "s")
    return f"{head} {last_plural}".strip()


@functools.cache
def units() -> dict[str, str]:
    """Spoken unit → symbol."""
    out: dict[str, str] = {}

    def take(name: str, mark: str) -> None:
        for form in (name, _plural(name)):
            out.setdefault(form, mark)
        head, _, rest = name.partition(" ")
        if rest:
            out.setdefault(f"{PLURALS.get(head, head + 's')} {rest}", mark)

    for table in (SPECIAL, SINGLE):
        for name, mark in table.items():
            take(name, mark)
    for base, mark in SCALED.items():
        for prefix, p in PREFIXES.items():
            symbol = "KB" if (p, mark) == ("k", "B") else p + mark
            for joined in {f"{prefix}{base}", f"{prefix} {base}".strip()}:
                take(joined, symbol)
                if mark == "m":
                    take(f"square {joined}", symbol + "²")
                    take(f"cubic {joined}", symbol + "³")
    for name, mark in AREAS.items():
        take(f"square {name}", f"sq {mark}")
        take(f"cubic {name}", f"cu {mark}")
    return out


@functools.cache
def symbols() -> dict[str, str]:
    return {v: v for v in units().values()} | WRITTEN


def unit(words: list[str]) -> str | None:
    """The symbol of a spoken unit, with 'per' between units or first."""
    text = " ".join(words)
    if text in units():
        return units()[text]
    if "per" in words:
        at = len(words) - 1 - words[::-1].index("per")
        top, bottom = words[:at], words[at + 1 :]
        low = units().get(" ".join(bottom))
        if low is None:
            return None
        if not top:
            return f"/{low}"
        high = unit(top)
        return f"{high}/{low}" if high and "/" not in high else None
    return None


DENOMINATORS = {"half": 2, "halves": 2, "quarter": 4, "quarters": 4}


def _denominator(words: list[str]) -> int | None:
    if len(words) == 1 and words[0] in DENOMINATORS:
        return DENOMINATORS[words[0]]
    last = words[-1]
    single = last[:-1] if last.endswith("s") and (last[:-1] in ORDINALS or last[:-1].endswith("th")) else last
    return ordinal_value([*words[:-1], single]) if single in ORDINALS or single.endswith("th") else None


def _fraction(words: list[str]) -> Fraction | None:
    """'half', 'a third', 'three quarters', 'fifty two thirds': a numerator and a denominator's ordinal."""
    if words[:1] in (["a"], ["an"]):
        words = ["one", *words[1:]]
    if words in (["half"], ["quarter"]):
        words = ["one", *words]
    for cut in range(1, len(words)):  # the longest denominator: "one ten thousandth"
        top, bottom = spoken_integer(words[:cut]), _denominator(words[cut:])
        if top is not None and bottom:
            return Fraction(top, bottom)
    return None


def number(words: list[str]) -> Fraction | None:
    """A decimal, a whole number, a fraction, or a whole and a fraction."""
    sign = -1 if words[:1] in (["minus"], ["negative"]) else 1
    if words and words[0] in SIGNS:
        words = words[1:]
    if not words or words[0] in SIGNS:
        return None
    value = decimal_words(["point" if w == "dot" else w for w in words])
    if value is None and len(words) > 2 and words[-1] in POWERS and words[-2] in POWERS:
        return None
    if value is not None:
        return sign * Fraction(int(value.digits)) / Fraction(10) ** value.scale
    body = words[:-1] if words[-1] == "of" else words
    if "over" in body:
        at = body.index("over")
        top, bottom = spoken_integer(body[:at]), spoken_integer(body[at + 1 :])
        return sign * Fraction(top, bottom) if top is not None and bottom else None
    if "and" in body[1:-1]:
        at = len(body) - 1 - body[::-1].index("and")
        whole, part = spoken_integer(body[:at]), _fraction(body[at + 1 :])
        if whole is not None and part is not None and part < 1:
            return sign * (whole + part)
    part = _fraction(body) if body else None
    return sign * part if part is not None else None


def shown(value: Fraction) -> str:
    """Plain digits, at most twelve after the point, cut off."""
    n = abs(value.numerator) * 10**12 // value.denominator
    whole, part = divmod(n, 10**12)
    tail = str(part).rjust(12, "0").rstrip("0")
    return "-" * (value < 0) + str(whole) + (f".{tail}" if tail else "")


def _joined(value: str, mark: str) -> str:
    return value + mark if mark in ("%", "°") else f"{value} {mark}"


def measurement(text: str) -> str | None:
    words = HYPHENS.sub(" ", lower(text)).split()
    if not words or any(ch.isdigit() for ch in text):
        return None
    for i, w in enumerate(words):
        if w in ("foot", "feet") and 0 < i < len(words) - 1:
            feet = number(words[:i])
            rest = words[i + 1 :]
            rest = rest[:-1] if rest[-1] in ("inch", "inches") else rest
            inches = spoken_integer(rest) if rest else None
            if feet is not None and feet.denominator == 1 and inches is not None and 0 <= inches < 12:
                return f"{feet} ft {inches} in"
    whole = unit(words)
    if whole is not None and ("per" in words or len(words) > 3):
        return whole
    for cut in range(1, len(words)):
        mark = unit(words[cut:])
        if mark is None:
            continue
        head = words[:cut]
        article = head[-1] in ("a", "an")
        if article:
            if len(head) > 1 and (head[-2] == "of" or head[-2] == "half" or head[-2] == "quarter"):
                head = head[:-1]
            else:
                continue
        value = number(head)
        if value is not None:
            return _joined(shown(value), mark)
    return None


VULGAR = {"½": Fraction(1, 2), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "¼": Fraction(1, 4), "¾": Fraction(3, 4), "⅕": Fraction(1, 5), "⅛": Fraction(1, 8)}


def surface(text: str) -> tuple[str, str] | None:
    """Value (with its sign, to twelve places) and unit of a written measurement; null where it can't be read, as with a denominator of zero."""
    text = text.strip()
    m = re.match(r"([+-]?)\s*([0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)?\s?((?:[½⅓⅔¼¾⅕⅛])|(?:[0-9]+/[0-9]+(?:,[0-9]{3})*))?", text)
    sign, whole, part = m[1], m[2], m[3]
    rest = text[m.end() :]
    if whole and not part and (n := re.match(r"\s?/\s?([0-9]+(?:,[0-9]{3})*)(?![0-9])", rest)):
        below = int(n[1].replace(",", ""))
        if not below:
            return None
        value, rest = Fraction(whole.replace(",", "")) / below, rest[n.end() :]
    elif whole or part:
        value = Fraction(whole.replace(",", "")) if whole else Fraction(0)
        if part in VULGAR:
            value += VULGAR[part]
        elif part:
            top, _, bottom = part.partition("/")
            below = int(bottom.replace(",", ""))
            if not below:
                return None
            value += Fraction(int(top), below)
    else:
        value = None
    mark = _written(rest.strip())
    if mark is None:
        return None
    return (("-" if sign == "-" else "") + shown(value) if value is not None else "", mark)


def _written(text: str) -> str | None:
    if text in symbols():
        return symbols()[text]
    spoken = unit(lower(text).split())
    if spoken is not None:
        return symbols().get(spoken, spoken)
    if "/" in text:
        top, _, bottom = text.partition("/")
        low = _written(bottom.strip())
        high = _written(top.strip()) if top.strip() else ""
        return f"{high}/{low}" if low and high is not None and "/" not in low else None
    return None
