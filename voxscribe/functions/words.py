"""Realizers for punctuation, abbreviations, identifiers, phone numbers and electronic addresses."""

from __future__ import annotations

import re

from voxscribe.functions.numbers import DIGITS, OH, cardinal, digit_sequence, groups_read_off, grouped_digits, lower, spoken_integer, words_of

# Names of symbols.
SYMBOLS = {
    ".": ["period", "full stop", "dot"],
    ",": ["comma"],
    ":": ["colon"],
    ";": ["semicolon", "semi colon"],
    "!": ["exclamation", "exclamation point", "exclamation mark", "bang"],
    "?": ["question", "question mark"],
    "-": ["hyphen", "hyphen minus", "hyphen-minus", "dash", "minus"],
    "–": ["en dash"],
    "—": ["em dash", "long dash"],
    "...": ["ellipsis", "dot dot dot", "three dots"],
    "&": ["ampersand", "and sign"],
    "*": ["asterisk", "star"],
    "@": ["at sign", "at symbol"],
    "#": ["hash", "number sign", "pound sign"],
    "%": ["percent", "percent sign"],
    "+": ["plus", "plus sign"],
    "=": ["equals", "equal sign"],
    "~": ["tilde"],
    "_": ["underscore"],
    "|": ["pipe", "vertical bar"],
    "/": ["slash", "forward slash"],
    "\\": ["back slash", "backslash"],
    '"': ["double quote", "quotation mark", "open quote", "close quote"],
    "'": ["single quote", "apostrophe"],
}
BRACKETS = {"parenthesis": "()", "bracket": "[]", "square bracket": "[]", "brace": "{}", "curly brace": "{}", "angle bracket": "<>"}
PUNCTUATION = {name: mark for mark, names in SYMBOLS.items() for name in names}
PUNCTUATION |= {f"{side} {name}": marks[i] for name, marks in BRACKETS.items() for i, sides in enumerate((("open", "left"), ("close", "right"))) for side in sides}

# Abbreviations of spoken phrases.
ABBREVIATIONS = {"l g a eleven fifty": "LGA 1150", "s and p five hundred": "S&P 500", "seven eleven": "7-eleven", "for example": "e.g.", "doctor": "dr.", "misses": "mrs.", "mister": "mr.", "saint": "st.", "r t x": "RTX"}


def punctuation(text: str) -> str | None:
    return PUNCTUATION.get(" ".join(lower(text).split()))


def abbreviation(text: str) -> str | None:
    """The text with the first occurrence of each listed phrase abbreviated, if any stands there as whole words."""
    if not text.isascii():
        return None
    out = text
    for phrase, short in ABBREVIATIONS.items():
        m = re.search(rf"(?<![A-Za-z0-9_]){phrase}(?![A-Za-z0-9_])", out, re.I)
        if m:
            new = short[0].upper() + short[1:] if m[0][0].isupper() else short
            out = out[: m.start()] + new + out[m.end() :]
    return out if out != text else None


def _number(words: list[str]) -> str | None:
    """Digits of a chunk of number words inside an identifier."""
    if all(w in DIGITS or w in OH for w in words):
        return "".join(str(DIGITS.get(w, 0)) for w in words)
    if all(w.isascii() and w.isdigit() for w in words):
        return "".join(words)
    text = " ".join(words)
    return grouped_digits(text) or (groups_read_off(words) if any(w in OH for w in words) else None) or _plain(words) or digit_sequence(text)


def _plain(words: list[str]) -> str | None:
    n = spoken_integer(words)
    return None if n is None or words[-1] == "and" else str(n)


def _is_letter(w: str) -> bool:
    return len(w) == 1 and w.isascii() and w.isalpha()


def _segment(w: str) -> bool:
    """A name that starts with a letter."""
    return w.isascii() and w.isalnum() and w[0].isalpha()


def flag(words: list[str]) -> str | None:
    dashes = 2 if [lower(w) for w in words[:2]] == ["double", "dash"] else 1 if words and lower(words[0]) == "dash" else 0
    rest = words[dashes:]
    if dashes == 1 and len(rest) == 1 and _segment(rest[0]) and lower(rest[0]) not in DIGITS:
        return "-" + rest[0]
    if dashes == 2 and len(rest) == 1 and _segment(rest[0]):
        return "--" + rest[0]
    return None


def underscored(words: list[str]) -> str | None:
    capitals = [lower(w) for w in words[:2]] == ["all", "caps"]
    rest = words[2:] if capitals else words
    if len(rest) < 3 or len(rest) % 2 == 0:
        return None
    names, marks = rest[::2], rest[1::2]
    if any(lower(m) != "underscore" for m in marks) or not all(_segment(n) and lower(n) != "underscore" for n in names):
        return None
    out = "_".join(names)
    return out.upper() if capitals else out


def version(words: list[str]) -> str | None:
    """Three or more numbers with dots between, perhaps after a v."""
    words = [lower(w) for w in words]
    prefix = ""
    if words and re.fullmatch("v[0-9]*", words[0]):
        prefix, words = "v", [*([words[0][1:]] if words[0][1:] else []), *words[1:]]
    parts: list[list[str]] = [[]]
    for w in words:
        if w in ("point", "dot"):
            parts.append([])
        else:
            parts[-1].append(w)
    if len(parts) < 3 or not all(parts):
        return None
    numbers = [_number(p) for p in parts]
    return prefix + ".".join(numbers) if None not in numbers else None


def mixed(words: list[str]) -> str | None:
    """Single letters and numbers, with dashes and slashes between: "A B dash zero zero seven" AB-007."""
    marks = {"dash": "-", "hyphen": "-", "slash": "/"}
    out, chunk, letters, numbers, after_mark = "", [], False, False, True

    def close() -> bool:
        nonlocal out, chunk, numbers
        if chunk:
            n = _number(chunk)
            if n is None or chunk[0] == "and" or chunk[-1] == "and":
                return False
            out, chunk, numbers = out + n, [], True
        return True

    for w in words:
        low = lower(w)
        if low in marks:
            if after_mark or not close():
                return None
            out, after_mark = out + marks[low], True
            continue
        after_mark = False
        if _is_letter(w) and not (low == "o" and chunk):
            if not close():
                return None
            out, letters = out + w, True
        else:
            chunk.append(low)
    if after_mark or not close() or not (letters and numbers):
        return None
    return out


def marked_number(text: str) -> str | None:
    """A number with one punctuation mark attached: "twenty!" to "20 !"."""
    text = text.strip()
    if len(text) < 2 or text[-1].isalnum() or text[-1].isspace() or not text[-2].isalnum():
        return None
    n = cardinal(text[:-1])
    return f"{n} {text[-1]}" if n is not None else None


def word(text: str) -> str | None:
    words = text.split()
    return flag(words) or underscored(words) or version(words) or marked_number(text) or mixed(words)


PHONE_WORDS = set(DIGITS) | OH


def _grouped_phone(digits: str) -> str | None:
    n = len(digits)
    if n == 10:
        return f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
    if n == 7:
        return f"{digits[:3]}-{digits[3:]}"
    if n == 8:
        return f"{digits[:3]}-{digits[3:]}"
    return digits if n > 2 else None


def _international(digits: str) -> str | None:
    """Country code of two digits where fourteen are given, else what stands before ten."""
    if len(digits) == 14:
        return f"+{digits[:2]} {digits[2:5]} {digits[5:9]} {digits[9]} {digits[10:]}"
    if 11 <= len(digits) <= 13:
        code, rest = digits[:-10], digits[-10:]
        return f"+{code} {rest[:3]}-{rest[3:6]}-{rest[6:]}"
    return None


def phone(text: str) -> str | None:
    words = lower(text).split()
    if not words:
        return None
    if words[0] in ("extension", "ext"):
        digits = digit_sequence(" ".join(words[1:])) if words[1:] else None
        return f"extension {digits}" if digits else None
    spoken = lambda part: "".join(str(DIGITS.get(w, 0)) for w in part) if part and all(w in PHONE_WORDS for w in part) else None
    if words[0] == "x":
        digits = spoken(words[1:])
        return f"x{digits}" if digits else None
    if words[0] == "plus":
        digits = spoken(words[1:])
        return _international(digits) if digits else None
    if words[:3] == ["s", "s", "n"] or words[0] == "ssn":
        rest = words[3:] if words[0] == "s" else words[1:]
        digits = spoken([w for w in rest if w != "is"])
        return f"ssn{' is' if 'is' in rest else ''} {digits[:3]}-{digits[3:5]}-{digits[5:]}" if digits and len(digits) == 9 else None
    if "dot" in words:
        parts = [spoken(p.split()) for p in " ".join(words).split("dot")]
        return ".".join(parts) if len(parts) == 4 and all(p and len(p) <= 3 and int(p) < 256 for p in parts) else None
    area = words[:2] == ["area", "code"]
    if area:
        words = words[2:]
    out, gap = [], True
    for w in words:
        if w in ("sil", "dash", "hyphen"):
            if gap:
                return None
            gap = True
        elif w in PHONE_WORDS:
            out.append(w)
            gap = False
        else:
            return None
    digits = spoken(out)
    if gap or digits is None or (area and len(digits) != 10):
        return None
    return _grouped_phone(digits)


MARKS = {"dash": "-", "hyphen": "-", "underscore": "_", "plus": "+", "slash": "/", "colon": ":", "percent": "%", "equals": "=", "question": "?", "hash": "#", "ampersand": "&"}


def _run(tokens: list[str]) -> str | None:
    """One name of an address: spelled letters and digits, with one longer word at most."""
    if sum(len(t) > 1 and lower(t) not in DIGITS and lower(t) != "oh" for t in tokens) > 1:
        return None
    out = ""
    for i, t in enumerate(tokens):
        low = lower(t)
        if low in DIGITS:
            out += str(DIGITS[low])
        elif low == "oh":
            out += "0"
        elif low == "o":
            near = [x for x in (tokens[i - 1 : i] + tokens[i + 1 : i + 2]) if _is_letter(x)]
            out += t if near else "0"
        elif t.isascii() and t.isalnum():
            if ("underscore" in low or low.startswith("plus")) and low not in MARKS:
                return None
            out += t
        else:
            return None
    return out


def _pieces(tokens: list[str], marks: dict[str, str]) -> str | None:
    """Names with marks between; no mark first, last or after another."""
    out, name = "", []
    for t in tokens:
        if lower(t) in marks:
            run = _run(name) if name else None
            if not run:
                return None
            out, name = out + run + marks[lower(t)], []
        else:
            name.append(t)
    run = _run(name) if name else None
    return out + run if run else None


def _host(tokens: list[str]) -> str | None:
    host = _pieces(tokens, {"dot": ".", "dash": "-", "hyphen": "-"})
    if host is None or "." not in host:
        return None
    labels = host.split(".")
    return host if all(re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?", x) for x in labels) and labels[-1].isalpha() and len(labels[-1]) > 1 else None


def electronic(text: str) -> str | None:
    if not text.isascii() or "qzxospelledletterxzq" in text:
        return None
    tokens = text.split()
    low = [lower(t) for t in tokens]
    for names, scheme in ((["h", "t", "t", "p", "s"], "https"), (["h", "t", "t", "p"], "http"), (["https"], "https"), (["http"], "http")):
        n = len(names)
        if low[:n] == names and low[n : n + 3] == ["colon", "slash", "slash"]:
            rest = tokens[n + 3 :]
            cut = next((i for i, t in enumerate(rest) if lower(t) == "slash"), len(rest))
            host, path = _host(rest[:cut]), rest[cut + 1 :]
            if host is None or (cut < len(rest) and not path):
                return None
            tail = _pieces(path, MARKS | {"dot": "."}) if path else ""
            return None if tail is None else f"{scheme}://{host}" + (f"/{tail}" if path else "")
    if "dot" not in low:
        return None
    if low.count("at") == 1:
        at = low.index("at")
        name, host = _pieces(tokens[:at], {"dot": ".", "dash": "-", "hyphen": "-", "underscore": "_", "plus": "+"}), _host(tokens[at + 1 :])
        return f"{name}@{host}" if name and host else None
    return _host(tokens) if "at" not in low else None
