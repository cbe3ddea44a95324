"""Realizers, comparators, decoder and calendar values by golden vectors and invariants."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxscribe.functions import baseline, compare, decode, gate, numbers, pieces, score, temporal
from voxscribe.functions.realize import KINDS, candidates, kinds_of, realize, realize_options
from voxscribe.plans.candidates import normalize_text, reading_of

GOLD = {
    "DIGIT_SEQUENCE": {"zero zero seven two": "0072", "double oh seven": "007", "four double five triple zero": "455000", "12 three 045": "123045", "twenty-three forty-five": "2345", "double": None, "double 12": None, "one-two": None, "seven eighty eight": None, "": None},
    "CARDINAL": {"NEGATIVE Forty Two": "-42", "minus zero": "-0", "one undecillion": "1" + "0" * 36, "seven eighty eight": "95", "one hundred and twenty-three": "123", "four hundred's": None, "one septillion two octillion": None},
    "TIME": {"one oh five": "01:05", "ten fifty p m": "10:50 p.m.", "quarter to one": "12:45", "half to three": "02:30", "two forty five g m t minus six": "02:45 GMT-6", "nine minutes three seconds and twenty nine milliseconds": "09:03.29", "sixteen hundred": "16:00", "twenty five ten": None, "ten sixty": None, "ten fifty p.m. tomorrow": None},
    "DATE": {"three slash four slash twenty twenty six": "3/4/2026", "saturday the thirtieth of june twenty twelve": "saturday 30 june 2012", "fourteen hundred b c e": "1400BCE", "seven forties": "740s", "february twenty ninth twenty twenty four": "february 29 2024", "april thirty first": None, "february twenty ninth twenty twenty three": None},
    "MONEY": {"two dollars and fifty cents": "$2.5", "one lakh rupees": "Rs100000", "three won and six jeon": "KRW 3.6", "one and a half million dollars": "$1500000", "fifty euro cents": "€0.5", "twenty dollars U.S.": None, "five euros tomorrow": None},
    "DECIMAL": {"one point oh five": "1.05", "minus zero point zero": "-0", "six point three seven one five times ten to the fourteen": "637150000000000", "1 234": "1234", "one point five percent": None, "1,2,3": None, "1e1000000": None},
    "PHONE": {"nine eight two zero five five one two three four": "982-055-1234", "x four eight two one": "x4821", "extension two oh four": "extension 204", "three two nine two sil three two nine seven": "329-23297", "area code": None, "three two sil sil nine": None},
    "ELECTRONIC": {"john dot smith at gmail dot com": "john.smith@gmail.com", "h t t p colon slash slash example dot com slash path": "http://example.com/path", "R O B at example dot com": "ROB@example.com", "o at example dot com": "0@example.com", "dot com": None, "a at gmail dot com tomorrow": None},
    "MEASUREMENT": {"two hundred kilometers per hour": "200 km/h", "five foot ten": "5 ft 10 in", "minus five degrees": "-5°", "thirty three and a third revolutions per minute": "33.333333333333 rpm", "per hour": "/h", "one ten thousandth of a millimeter": "0.0001 mm", "two meters squared": None, "five kg": None},
    "ORDINAL": {"one hundred and twenty-second": "122nd", "XXVth": "25th", "5ª": "5th", "1,500th": "1500th", "21rd": None, "twenty fourths": None, "IC": None},
    "PUNCTUATION": {"Question   Mark": "?", "dot dot dot": "...", "em dash": "—", "new line": None},
    "WHITELIST": {"Doctor dao": "Dr. dao", "doctor doctor": "dr. doctor", "seven eleven stores": "7-eleven stores", "doctorate dao": None, "é doctor": None},
    "WORD": {"B two B": "B2B", "A B dash zero zero seven": "AB-007", "double dash role": "--role", "all caps account underscore region": "ACCOUNT_REGION", "v three dot one dot nine": "v3.1.9", "twenty!": "20 !", "all caps auth": None, "v3 dot one": None},
}


@pytest.mark.parametrize("kind", KINDS)
def test_golden_vectors(kind):
    for text, want in GOLD[kind].items():
        assert realize(kind, text) == want, text
    assert realize(kind, None) is None and realize(kind, " \t") is None and realize_options(kind, None) == []


def test_two_readings_of_cardinals():
    assert realize_options("CARDINAL", "seven eighty eight") == ["95", "788"]
    assert realize_options("CARDINAL", "ten oh five") == ["1005"]
    assert realize_options("CARDINAL", "two") == ["2"]


def test_unknown_kinds_raise():
    with pytest.raises(ValueError):
        realize("NOTHING", "one")
    with pytest.raises(ValueError):
        compare.equivalent("WORD", "a", "a")


EQUAL = {
    "CARDINAL": [("12345", "12, 345"), ("12345", "012345"), ("14", "XIV's"), ("-0", "-000")],
    "DATE": [("4 march 2014", "2014-03-04"), ("4 march 2014", "03/04/2014"), ("4 march 2014", "Tuesday, Mar. 4, 2014"), ("november 17 09", "11/17/09"), ("31BC", "31 B.C.")],
    "TIME": [("04:30", "0430"), ("04:30", "04.30"), ("02:45 GMT-6", "2:45 gmt-06:00"), ("01:00 p.m.", "PM1")],
    "MONEY": [("$1000000", "$1M"), ("PHP 5.3", "₱5.30"), ("Rs100000", "INR 1 lakh")],
    "DECIMAL": [("1.5M", "1500000"), ("1,5", "1.50"), ("(1.5)", "-1.5")],
    "MEASUREMENT": [("2½ mm", "2.5 millimeters"), ("33 1/3 rpm", "33.333333333333 revolutions per minute")],
    "ORDINAL": [("VIII", "the eighth"), ("33, 140th", "thirty three thousand one hundred fortieth")],
    "PHONE": [("(212) 555 0123", "212-555-0123"), ("SSN 799-12-3113", "ssn is 799-12-3113")],
    "DIGIT_SEQUENCE": [("77–152", "77152"), ("(771) 52", "77152")],
}
DIFFERENT = {
    "CARDINAL": [("14", "15"), ("-14", "XIV")],
    "DATE": [("31BC", "31 AD"), ("2020 tomorrow", "2020 tomorrow")],
    "TIME": [("04:30 ET", "04:30 UTC"), ("04:30!", "04:30!")],
    "MONEY": [("$5", "CAD 5"), ("$5", "$5 tomorrow")],
    "DECIMAL": [("-0", "0"), ("1.2", "1.2 million")],
    "MEASUREMENT": [("43m", "43 minutes"), ("1 m/s", "1 km/h")],
    "ORDINAL": [("IV", "IIII"), ("1st", "1th")],
    "PHONE": [("123.123.0.40", "123123040")],
    "DIGIT_SEQUENCE": [("(77152", "77152"), ("77152", "77152A")],
}


@pytest.mark.parametrize("kind", compare.KINDS)
def test_comparators(kind):
    assert all(compare.equivalent(kind, a, b) for a, b in EQUAL[kind])
    assert not any(compare.equivalent(kind, a, b) for a, b in DIFFERENT[kind])


def test_unreadable_texts_compare_by_kind():
    assert {k: compare.equivalent(k, "??", "!!") for k in compare.KINDS} == {k: k not in ("MONEY", "DATE", "TIME") for k in compare.KINDS}


def spelled(n):
    if n < 100:
        small = {v: k for k, v in numbers.SMALL.items()}
        return small[n] if n in small else f"{small[n - n % 10]} {small[n % 10]}"
    for power, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= power:
            return f"{spelled(n // power)} {name}" + (f" {spelled(n % power)}" if n % power else "")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**11))
def test_cardinals_round_trip(n):
    assert realize("CARDINAL", spelled(n)) == str(n)
    assert realize("DECIMAL", spelled(n)) == str(n)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_nothing_raises_on_any_text(text):
    for kind in KINDS:
        realize_options(kind, text)
    for kind in compare.KINDS:
        compare.equivalent(kind, text, text)
    normalize_text(text)


VOCABULARY = "one two oh five twenty thirty hundred thousand million and point dot dash slash underscore at for example doctor dao march april first twenty per hour meters dollars cents half a quarter the of p m utc noon double X IV B v3 gmail com minus plus seven eleven question mark - , ! 12 3rd".split()


def test_gate_loses_no_candidate():
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 8)))
        assert decode.build_candidates(text) == decode.build_candidates(text, lambda span, kinds: candidates(span, kinds_of(kinds)), gate.runs), text
        for i, j, kinds in gate.runs(text, at := decode.tokens(text)):
            span = text[at[i][0] : at[j - 1][1]]
            assert candidates(span, kinds_of(kinds)) == reading_of(span), (text, span)


LONG = ["thirty filler words go here " * 6 + "code " + "eight " * 40 + "end", "h t t p s colon slash slash w w w dot " + "a b c d e f g h " * 6 + "dot com slash path now", "one two " * 100, "the doctor saw " + "two three five " * 20]


def test_long_runs_have_the_candidates_of_full_enumeration():
    """Runs of over thirty tokens in texts of over sixty, with every run of tokens read."""
    for text in LONG:
        gated = decode.build_candidates(text, lambda span, kinds: candidates(span, kinds_of(kinds)), gate.runs)
        memo = {}
        full = decode.build_candidates(text, lambda span, _: memo[span] if span in memo else memo.setdefault(span, candidates(span)))
        assert gated == full
    assert "8" * 40 in normalize_text(LONG[0])["text"]
    assert "8" * 40 in baseline.normalize_sentence(LONG[0])


def test_zero_denominators_are_unreadable():
    for text in ("1/0", "0/0", "1 0/0", "5/0 m", "1/0%", "1/0,000 kg"):
        assert not compare.equivalent("MEASUREMENT", text, "1 m") and compare.equivalent("MEASUREMENT", text, text)


def test_candidates_keep_their_invariants():
    rng = random.Random(2)
    for _ in range(100):
        text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 7)))
        found = decode.build_candidates(text)
        assert found == sorted(found, key=lambda c: (c.token_start, c.token_end, c.replacement))
        for c in found:
            assert text[c.char_start : c.char_end] == c.text != c.replacement and c.kind_mask
    assert kinds_of(dict(candidates("seven three"))["73"]) == ["DIGIT_SEQUENCE", "CARDINAL", "DECIMAL"]


def paths(n, spans):
    if n == 0:
        yield []
        return
    for p in paths(n - 1, [s for s in spans if s[1] < n]):
        yield p
    for k, s in enumerate(spans):
        if s[1] == n:
            for p in paths(s[0], [t for t in spans if t[1] <= s[0]]):
                yield [*p, s]


def test_best_path_and_partition_against_all_paths():
    import math

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        spans = [(a, rng.randint(a + 1, n), rng.randint(-3, 5)) for a in (rng.randrange(n) for _ in range(rng.randint(0, 5)))]
        totals = [sum(s[2] for s in p) for p in paths(n, spans)]
        chosen, total = decode.best_path(n, [s[:2] for s in spans], [float(s[2]) for s in spans])
        assert total == max(totals) == sum(spans[k][2] for k in chosen)
        assert decode.log_partition(n, [s[:2] for s in spans], [float(s[2]) for s in spans]) == pytest.approx(math.log(sum(map(math.exp, totals))))


def test_tie_rule_and_bad_scores():
    assert decode.best_path(5, [(0, 5)], [0.0])[0] == [0]  # a zero edit over several characters arrives first
    assert decode.best_path(5, [(0, 5)], [-1.0]) == ([], 0.0)
    with pytest.raises(ValueError):
        decode.best_path(5, [(0, 5)], [float("nan")])


def test_rendering_and_targets():
    text = "pay twenty dollars at four thirty"
    found = decode.build_candidates(text)
    pick = [c for c in found if c.replacement in ("$20", "04:30") and c.text in ("twenty dollars", "four thirty")]
    out, places = decode.render(text, pick)
    assert out == "pay $20 at 04:30" and places == [(4, 7), (11, 16)]
    with pytest.raises(ValueError):
        decode.render(text, [pick[0], pick[0]])
    assert decode.reachable("meet at four thirty on march fourth", "meet at 04:30 on march 4th")
    assert not decode.reachable("seven three", "74")
    assert decode.reachable("the rate five percent", "the rate 5%") and not decode.reachable("the rate 5 %", "the rate 5%")
    loss = decode.path_loss(text, "pay $20 at 04:30", found, score.score(text, found))
    assert loss is not None and loss > 0 and decode.path_loss(text, "pay 30", found, score.score(text, found)) is None


WRITTEN = {
    "the room code is one oh five": "the room code is 105",
    "see you at one oh five": "see you at 01:05",
    "call nine eight two zero five five one two three four": "call 982-055-1234",
    "email john dot smith at gmail dot com": "email john.smith@gmail.com",
    "the rate is five percent": "the rate is 5%",
    "doctor dao is here": "dr. dao is here",
    "nothing to write here": "nothing to write here",
    "": "",
}


def test_sentences():
    assert {t: normalize_text(t)["text"] for t in WRITTEN} == WRITTEN


def test_calendar_values():
    day = dt.date(2026, 9, 19)
    assert [v for _, _, v in temporal.relative_matches("tomorrow, in two weeks, a week ago, in 11 days", day)] == ["2026-09-20", "2026-10-03", "2026-09-12"]
    assert temporal.relative_matches("next monday", dt.date(2026, 9, 23))[0][2] == "2026-09-28"
    assert temporal.numeric_date("03/04/2026", "DMY", None) == "2026-04-03" and temporal.numeric_date("03/04/2026", "MDY", None) == "2026-03-04"
    assert temporal.numeric_date("03/04/2026", None, None) is None and temporal.numeric_date("24/09/2026", None, None) == "2026-09-24"
    assert temporal.named_date("Thursday, September 30", 2027) == "2027-09-30" and temporal.named_date("Thursday, September 30", 2026) is None
    moment = dt.datetime(2026, 9, 19, 23, tzinfo=dt.timezone.utc)
    assert temporal.Context(moment, "Asia/Kolkata").day() == dt.date(2026, 9, 20)
    assert temporal.Context(moment.replace(tzinfo=None), "Asia/Kolkata").day() == day
    with pytest.raises(ValueError):
        temporal.Context(date_order="XYZ")


def test_resolved_text():
    context = temporal.Context(dt.datetime(2026, 9, 19), None, None, "DMY")
    out = normalize_text("meet tomorrow at four thirty or on march fourth twenty twenty seven", context)
    assert out["text"] == "meet tomorrow at 04:30 or on march 4 2027"
    assert out["resolved_text"] == "meet 2026-09-20 at 04:30 or on 2027-03-04"
    for s in out["spans"]:
        assert out["text"][s["start"] : s["end"]] == s["text"]


def whole_graph(text):
    """Written text and total of the best path over the graph of the whole text."""
    cands = decode.build_candidates(text, lambda span, kinds: candidates(span, kinds_of(kinds)), gate.runs)
    chosen, total = decode.best_path(len(text), [(c.char_start, c.char_end) for c in cands], score.score(text, cands))
    picked = sorted((cands[i] for i in chosen), key=lambda c: c.char_start)
    return decode.render(text, picked)[0], total, [c[2:] for c in picked]


def test_pieces_have_the_best_path_of_the_whole_text():
    rng = random.Random(5)
    some = "one two seven nine zero oh ten twelve twenty ninety hundred thousand and and point dollars cents percent march fourth first monday at on for order number room call phone until the of a is was a b p m half past quarter to v VII 7 42 5th , . ? ! - example seven eleven doctor dash dot com underscore minus kilometers per hour comma double noon école ſaint \u212a".split(" ")
    pieces._spans.clear()
    pieces._pieces.clear()
    for _ in range(1500):
        text = "".join(rng.choice(some) + rng.choice([" ", " ", " ", " ", "  ", ""]) for _ in range(rng.randint(1, 16)))
        written, total, picked = whole_graph(text)
        got = normalize_text(text)
        assert (got["text"], got["score"]) == (written, total), text
        assert [(s["source_start"], s["source_end"], s["source_text"], s["text"], s["kind_mask"]) for s in got["spans"]] == picked, text


def test_no_reading_scores_above_its_ceiling():
    rng = random.Random(9)
    words = "one two seven zero oh twelve twenty ninety hundred thousand and dollars march fourth quarter past five point the a b double".split()
    for _ in range(3000):
        span = " ".join(rng.choices(words, k=rng.randint(1, 7)))
        for cues in (0, 31, rng.randrange(32)):
            small = all(w in numbers.SMALL for w in span.split())
            assert all(score.worth(span, r, m, cues) <= score.ceiling(len(span.split()), (1 << 13) - 1, cues, small) for r, m in candidates(span))
            for r, m in candidates(span):
                assert score.worth(span, r, m, cues) <= score.ceiling(len(span.split()), m, cues, small)


def test_pieces_are_read_once():
    """Two texts that differ before and after an amount share its readings; digits read one by one share those of their runs."""
    pieces._pieces.clear()
    pieces._spans.clear()
    first = "order number six one two was placed on march fourth nineteen ninety six for one hundred ninety seven thousand dollars and five cents"
    assert normalize_text(first)["text"] == "order number 612 was placed on march 4 1996 for $197000.05"
    known = len(pieces._spans)
    assert normalize_text(first.replace("six one two", "six one three").replace("fourth", "fifth"))["text"] == "order number 613 was placed on march 5 1996 for $197000.05"
    assert len(pieces._spans) - known < 30


def test_long_runs_of_small_numbers_are_neither_times_nor_years():
    for text in ("one two three four five", "twenty one twenty two five", "zero one zero two zero one two"):
        assert realize("TIME", text) is None and realize("DATE", text) is None
