"""The log-linear scorer, the baseline without context, and the way from written to spoken."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import voxscribe
from voxscribe.functions import baseline, decode, learned
from voxscribe.plans.candidates import normalize_text


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    w = 0.3 * rng.standard_normal(learned.SIZE)
    text, target = "code one five at two thirty", "code 15 at 02:30"
    g = np.zeros(learned.SIZE)
    loss = learned.gradient(text, target, w, g)
    assert loss > 0
    for i in rng.choice(np.flatnonzero(g), 12, replace=False):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (learned.gradient(text, target, up, np.zeros(learned.SIZE)) - learned.gradient(text, target, down, np.zeros(learned.SIZE))) / 2e-5
        assert slope == pytest.approx(g[i], abs=1e-5)
    assert learned.gradient("seven three", "74", w, g) is None


def test_learned_scorer_uses_context(spark, tmp_path):
    rng = random.Random(1)
    digits = "one two three four five six seven eight nine".split()
    pairs = []
    for _ in range(80):
        a, b = rng.randrange(9), rng.randrange(9)
        spoken = f"{digits[a]} oh {digits[b]}"
        pairs.append((f"the room code is {spoken}", f"the room code is {a + 1}0{b + 1}"))
        pairs.append((f"we meet at {spoken}", f"we meet at 0{a + 1}:0{b + 1}"))
    pairs.append(("x", "unreachable"))
    df = spark.createDataFrame(pairs, "text string, expected_text string")
    model, losses = learned.fit(df, epochs=10)
    assert losses[-1] < 0.2 * losses[0]
    for text, want in (("the room code is four oh two", "the room code is 402"), ("we meet at four oh two", "we meet at 04:02")):
        assert normalize_text(text, scorer=model)["text"] == want
    digest = model.save(str(tmp_path / "w.json"))
    again = learned.LogLinear.load(str(tmp_path / "w.json"), digest)
    assert np.allclose(again.weights, model.weights)
    with pytest.raises(ValueError):
        learned.LogLinear.load(str(tmp_path / "w.json"), "0")
    (tmp_path / "w.json").write_text((tmp_path / "w.json").read_text().replace("TIME", "TIMES"))
    with pytest.raises(ValueError):
        learned.LogLinear.load(str(tmp_path / "w.json"))


def test_baseline_ignores_context():
    assert baseline.normalize_sentence("the room code is one oh five") == "the room code is 01:05"
    assert baseline.normalize_sentence("pay twenty dollars to doctor dao") == "pay $20 to dr. dao"
    assert baseline.normalize_sentence("nothing here") == "nothing here" and baseline.normalize_sentence("") == ""


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15))
def test_written_and_spoken_round_trip(n):
    assert voxscribe.realize("CARDINAL", baseline.verbalize(str(n))) == str(n) or str(n).startswith("0")
    assert voxscribe.realize("ORDINAL", baseline.ordinal(max(n, 1))) == f"{max(n, 1)}{'th' if max(n, 1) % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(max(n, 1) % 10, 'th')}"


def test_verbalized_sentences():
    assert baseline.verbalize("pay $20.50 at 04:30 on march 4 or call 982-055-1234") == "pay twenty dollars and fifty cents at four thirty on march fourth or call nine eight two zero five five one two three four"
    assert baseline.verbalize("3.14 is 5% of the 21st, code 007") == "three point one four is five percent of the twenty first, code zero zero seven"


def test_public_names():
    assert all(hasattr(voxscribe, n) for n in voxscribe.__all__)
    assert voxscribe.build_info()["version"] == voxscribe.__version__
    assert isinstance(decode.build_candidates("one two")[0], voxscribe.Candidate)


def test_normalizer_with_saved_weights_and_contexts(tmp_path):
    path = str(tmp_path / "weights.json")
    weights = np.zeros(learned.SIZE)
    first = learned.LogLinear(weights).save(path)
    second = learned.LogLinear(weights + 0.001).save(path)
    assert first != second and learned.LogLinear.load(f"{path}.before", first) and not (tmp_path / "weights.json.new").exists()
    with pytest.raises(ValueError, match="digest"):
        voxscribe.Normalizer.from_pretrained(path, first)
    assert voxscribe.Normalizer.from_pretrained(path, second).normalize("two three") != ""
    own, other = voxscribe.Context(reference=dt.datetime(2026, 9, 19)), voxscribe.Context(reference=dt.datetime(2026, 1, 1))
    n = voxscribe.Normalizer(context=own)
    assert "2026-09-20" in n.normalize_resolved("call me tomorrow") and "2026-01-02" in n.normalize_resolved("call me tomorrow", other)
    out = n.normalize_structured("meet at four thirty")
    assert out.text == "meet at 04:30" and out.spans[0].text == "04:30" and n.normalize("") == ""
    with pytest.raises(TypeError):
        n.normalize(None)
    with pytest.raises(TypeError):
        voxscribe.Normalizer(context="today")
