"""Spoken amounts of money."""

from __future__ import annotations

import functools
import re

from voxscribe.functions.numbers import DIGITS, HYPHENS, POWERS, SMALL, TENS, digit_word, lower

# How amounts are shown where that isn't the code and a space.
DISPLAYS = {"USD": "$", "GBP": "£", "EUR": "€", "INR": "Rs", "JPY": "¥", "BRL": "R$", "DEM": "DM"}
# The names of each currency, in the singular; a name is made plural by the rules below.
CURRENCIES = {
    "USD": ["united states dollar", "dollar", "buck"],
    "CAD": ["canadian dollar"],
    "AUD": ["australian dollar"],
    "NZD": ["new zealand dollar"],
    "TWD": ["new taiwan dollar"],
    "HKD": ["hong kong dollar"],
    "SGD": ["singapore dollar"],
    "BMD": ["bermudian dollar"],
    "BSD": ["bahamian dollar"],
    "NAD": ["namibian dollar"],
    "FJD": ["fiji dollar"],
    "BND": ["brunei dollar"],
    "JMD": ["jamaican dollar"],
    "BBD": ["barbados dollar"],
    "XCD": ["east caribbean dollar"],
    "SRD": ["surinamese dollar"],
    "SBD": ["solomon islands dollar"],
    "TTD": ["trinidad and tobago dollar", "tobago dollar"],
    "GBP": ["british pound", "pound", "quid"],
    "EGP": ["egyptian pound"],
    "LBP": ["lebanese pound"],
    "SDG": ["sudanese pound"],
    "SSP": ["south sudanese pound"],
    "IEP": ["irish pound"],
    "CYP": ["cypriot pound"],
    "SHP": ["saint helena pound"],
    "SYP": ["syrian pound"],
    "EUR": ["euro"],
    "INR": ["indian rupee", "rupee"],
    "PKR": ["pakistani rupee"],
    "NPR": ["nepalese rupee"],
    "LKR": ["sri lanka rupee"],
    "SCR": ["seychelles rupee"],
    "JPY": ["japanese yen", "yen"],
    "KRW": ["korean won", "won"],
    "CNY": ["chinese yuan", "yuan"],
    "BRL": ["brazilian real", "real"],
    "NOK": ["norwegian krone", "kroner"],
    "DKK": ["danish krone"],
    "SEK": ["swedish krona", "kronor"],
    "ISK": ["icelandic krona"],
    "CHF": ["swiss franc", "franc", "generic franc"],
    "RWF": ["rwandan franc"],
    "GNF": ["guinean franc"],
    "CDF": ["congolese franc"],
    "DJF": ["djiboutian franc"],
    "BEF": ["belgian franc"],
    "FRF": ["french franc"],
    "BIF": ["burundian franc"],
    "DEM": ["german mark", "mark"],
    "BAM": ["convertible mark", "bosnia and herzegovina convertible mark"],
    "DOP": ["dominican peso", "peso"],
    "PHP": ["philippine peso"],
    "ARS": ["argentine peso"],
    "CLP": ["chilean peso"],
    "MXN": ["mexican peso"],
    "PLN": ["polish zloty", "zloty"],
    "CZK": ["czech koruna", "koruna"],
    "SKK": ["slovak koruna"],
    "HUF": ["hungarian forint", "forint"],
    "AZN": ["azerbaijani manat", "manat"],
    "TMT": ["turkmenistani manat"],
    "MYR": ["malaysian ringgit", "ringgit"],
    "THB": ["thai baht", "baht"],
    "VND": ["vietnamese dong", "dong"],
    "IDR": ["indonesian rupiah", "rupiah"],
    "BDT": ["bangladeshi taka", "taka"],
    "AED": ["united arab emirates dirham", "dirham", "emirates dirham", "arab emirates dirham"],
    "SAR": ["saudi riyal", "riyal"],
    "QAR": ["qatari rial", "rial"],
    "IRR": ["iranian rial"],
    "OMR": ["omani rial"],
    "ILS": ["israeli new sheqel"],
    "ZAR": ["south african rand", "rand"],
    "MVR": ["maldivian rufiyaa"],
    "BWP": ["botswana pula", "pula"],
    "GMD": ["gambian dalasi", "dalasi"],
    "KES": ["kenyan shilling", "shilling"],
    "TZS": ["tanzanian shilling"],
    "UGX": ["ugandan shilling"],
    "NGN": ["nigerian naira", "naira"],
    "ETB": ["ethiopian birr", "birr"],
    "RUB": ["russian ruble", "ruble", "rouble"],
    "BYR": ["belarusian ruble"],
    "UAH": ["ukrainian hryvnia", "hryvnia"],
    "RSD": ["serbian dinar", "dinar"],
    "KWD": ["kuwaiti dinar"],
    "TND": ["tunisian dinar"],
    "LYD": ["libyan dinar"],
    "DZD": ["algerian dinar"],
    "BGN": ["bulgarian lev", "lev"],
    "HRK": ["croatian kuna"],
    "ESP": ["spanish peseta", "peseta"],
    "ITL": ["italian lira", "lira"],
    "PTE": ["portuguese escudo"],
    "CVE": ["cape verde escudo", "escudo"],
    "GRD": ["greek drachma"],
    "ATS": ["austrian schilling", "schilling"],
    "FIM": ["finnish markka"],
    "GHS": ["ghanaian cedi"],
    "KZT": ["kazakhstani tenge"],
    "CRC": ["costa rican colon", "colon"],
    "MOP": ["macanese pataca", "pataca"],
    "AWG": ["aruban florin", "florin"],
    "NLG": ["netherlands guilder"],
    "MDL": ["moldovan leu"],
    "MNT": ["mongolian tugrik"],
    "KHR": ["cambodian riel"],
    "AFN": ["afghan afghani", "afghani"],
    "LAK": ["lao kip", "kip"],
    "PGK": ["papua new guinean kina", "kina"],
    "SLL": ["sierra leonean leone", "leone"],
    "ERN": ["eritrean nakfa"],
    "MKD": ["macedonian denar"],
    "AOA": ["angolan kwanza"],
    "VEF": ["venezuelan bolivar fuerte"],
    "EEK": ["estonian kroon"],
    "WST": ["samoan tala"],
    "HNL": ["honduran lempira"],
    "MMK": ["myanma kyat"],
    "PAB": ["panamanian balboa"],
    "MRO": ["mauritanian ouguiya"],
    "SIT": ["slovenian tolar"],
    "UZS": ["uzbekistan som"],
    "VUV": ["vanuatu vatu"],
    "LSL": ["lesotho loti"],
    "ANG": ["netherlands antillean guilder", "antillean guilder"],
    "MCF": ["monegasque franc"],
    "LTL": ["lithuanian litas"],
    "LVL": ["latvian lats"],
    "XPT": ["platinum ounce"],
    "XAG": ["silver ounce"],
    "MTL": ["maltese lira"],
    "VAL": ["vatican lira"],
    "SML": ["sammarinese lira"],
}
# The names of minor units.
MINORS = {
    "USD": ["cent", "united states cent"],
    "GBP": ["pence", "penny", "pennies", "british pence"],
    "EUR": ["euro cent", "centime"],
    "INR": ["paise", "paisa"],
    "JPY": ["sen"],
    "BRL": ["centavo"],
    "CAD": ["canadian cent"],
    "CHF": ["swiss rappen", "rappen"],
    "CNY": ["fen", "jiao", "chinese fen", "chinese jiao"],
    "KRW": ["jeon"],
    "MYR": ["malaysian sen"],
    "DEM": ["german pfennig", "pfennig"],
    "PLN": ["polish grosz", "grosz", "polish groszy"],
    "CZK": ["czech haler", "haler"],
    "RUB": ["kopek", "kopec"],
    "NOK": ["ore", "norwegian ore"],
    "DKK": ["danish ore"],
    "SEK": ["swedish ore"],
    "PKR": ["pakistani paise"],
    "GHS": ["pesewa", "ghanaian pesewa"],
    "ESP": ["centimo"],
    "IEP": ["irish penny", "irish pennies"],
    "AED": ["fils"],
    "ATS": ["groschen", "austrian groschen"],
    "KZT": ["tiin", "kazakhstani tiin"],
    "MOP": ["avo"],
    "LBP": ["piastre"],
    "MCF": ["monegasque centime"],
    "NIO": ["cordoba centavo"],
    "SKK": ["halier"],
    "CRC": ["costa rican centimo"],
    "LTL": ["centsas"],
}
PLURALS = {"krone": "kroner", "krona": "kronor", "penny": "pennies", "fuerte": "fuertes"}
#: Minor units that may divide the major by ten.
TENTHS = {"jeon", "jiao", "sen"}
SCALES = {"thousand": 3, "lakh": 5, "lakhs": 5, "million": 6, "crore": 7, "crores": 7, "billion": 9, "trillion": 12}
FRACTIONS = {"half": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fifth": 5, "fifths": 5}


@functools.cache
def names() -> dict[str, tuple[str, bool]]:
    """Phrase → (code, minor); the first that takes a phrase keeps it."""
    out: dict[str, tuple[str, bool]] = {}

    def take(phrase: str, code: str, minor: bool) -> None:
        last = phrase.split()[-1]
        for form in (phrase, phrase[: -len(last)] + PLURALS.get(last, last + "s")):
            out.setdefault(form, (code, minor))

    for phrases, minor in ((CURRENCIES, False), (MINORS, True)):
        for code, singular in phrases.items():
            for phrase in singular:
                take(phrase, code, minor)
    # Fixed value: a plural of its own.
    out["icelandic kronur"] = ("ISK", False)
    return out


def display(code: str, amount: str) -> str:
    mark = DISPLAYS.get(code, code)
    return f"{mark} {amount}" if mark == code else mark + amount


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(",.;:!?") for x in HYPHENS.sub(" ", lower(text)).split()) if w]


@functools.cache
def _longest() -> dict[str, int]:
    """First word → most words of a currency phrase that begins with it."""
    out: dict[str, int] = {}
    for phrase in names():
        first, *rest = phrase.split()
        out[first] = max(out.get(first, 0), 1 + len(rest))
    return out


def _find(words: list[str], minor: bool) -> tuple[int, int, str] | None:
    """Start, end and code of the longest currency phrase, the earliest of equals."""
    best = None
    for i, w in enumerate(words):
        for j in range(min(len(words), i + _longest().get(w, 0)), i, -1):
            hit = names().get(" ".join(words[i:j]))
            if hit and hit[1] == minor:
                if best is None or j - i > best[1] - best[0]:
                    best = (i, j, hit[0])
                break
    return best


def integer(words: list[str]) -> int | None:
    """An amount in words: scales may repeat and then multiply what stands before, lakh and crore count."""
    if not words or words[0] == "and" or words[-1] == "and":
        return None
    plain = [w for w in words if w != "and"]
    if len(plain) == 1 and plain[0].isascii() and plain[0].isdigit():
        return int(plain[0])
    if len(plain) == 2 and DIGITS.get(plain[0], 0) and plain[1] in TENS:  # "five fifty"
        return DIGITS[plain[0]] * 100 + TENS[plain[1]]
    if len(plain) > 1 and all(w in DIGITS or w in ("oh", "o") for w in plain):
        return int("".join(str(DIGITS.get(w, 0)) for w in plain))
    total, group, filled, before = 0, 0, False, None
    for w in plain:
        if w in SMALL:
            group, filled = group + SMALL[w], True
        elif w == "hundred":
            group, filled = (group if filled else 1) * 100, True
        elif w in SCALES or w in POWERS:
            power = SCALES.get(w) or POWERS[w]
            if before is not None and power >= before:
                total, group = (total + group) * 10**power, 0
            else:
                total, group = total + (group if filled else 1) * 10**power, 0
            before, filled = power, False
        else:
            return None
    return total + group


def _trimmed(whole: int, part: str) -> str:
    part = part.rstrip("0")
    return f"{whole}.{part}" if part else str(whole)


def amount(words: list[str]) -> str | None:
    """Integer, decimal with a scale after it, or mixed fraction with a scale."""
    if "point" in words:
        at = words.index("point")
        head, tail = words[:at], words[at + 1 :]
        power = 0
        if tail and tail[-1] in SCALES:
            power, tail = SCALES[tail[-1]], tail[:-1]
        whole = integer(head) if head else 0
        digits = [digit_word(w) for w in tail]
        if whole is None or not digits or None in digits:
            return None
        digits = "".join(digits).ljust(power, "0")
        return _trimmed(int(f"{whole}{digits[:power]}"), digits[power:])
    if "and" in words and len(words) > 2:
        at = len(words) - 1 - words[::-1].index("and")
        tail = words[at + 1 :]
        scale = SCALES[tail[-1]] if tail and tail[-1] in SCALES else 0
        tail = tail[:-1] if scale else tail
        if len(tail) == 2 and tail[1] in FRACTIONS and (tail[0] == "a" or tail[0] in DIGITS):
            whole, top = integer(words[:at]), 1 if tail[0] == "a" else DIGITS[tail[0]]
            if whole is not None:
                digits = str(10 ** (12 + scale) * top // FRACTIONS[tail[1]] + whole * 10 ** (12 + scale)).rjust(13, "0")
                return _trimmed(int(digits[:-12]), digits[-12:])
    n = integer(words)
    return str(n) if n is not None else None


def _with_minor(major: str, minor: int, places: int) -> str | None:
    whole, _, part = major.partition(".")
    if part:
        return None
    n = int(whole) * 10**places + minor
    return _trimmed(n // 10**places, str(n % 10**places).rjust(places, "0"))


def _places(phrase: str, minor: int) -> int:
    return 1 if phrase.split()[-1].rstrip("s") in TENTHS and minor < 10 else 2


def money(text: str) -> str | None:
    words = _words(text)
    if "." in text and re.search(r"\b[A-Z]\.", text):
        return None
    sign = "-" if words[:1] in (["minus"], ["negative"]) else ""
    words = words[1:] if sign else words
    major, minor = _find(words, False), _find(words, True)
    if major is None or (minor is not None and minor[0] <= major[0] and major[1] <= minor[1]):
        if minor is None or minor[1] != len(words):
            return None
        n = integer(words[: minor[0]])
        return sign + display(minor[2], _with_minor("0", n, _places(" ".join(words[minor[0] : minor[1]]), n))) if n is not None else None
    start, end, code = major
    value = amount(words[:start]) if start else None
    if value is None:
        return None
    rest = words[end:]
    if rest:
        rest = rest[1:] if rest[0] == "and" else rest
        minor = _find(rest, True)
        if minor is None:
            n = integer(rest)  # implied cents
            if n is None or n > 99 or rest[0] in ("oh", "o"):
                return None
            value = _with_minor(value, n, 2)
        else:
            if minor[1] != len(rest) or not minor[0]:
                return None
            n = integer(rest[: minor[0]])
            value = _with_minor(value, n, _places(" ".join(rest[minor[0] :]), n)) if n is not None else None
        if value is None:
            return None
    return sign + display(code, value)
