"""Encoder inputs against plain loops, and the evaluation's run, audit and gate."""

import hashlib
import math

import numpy as np
import pytest

from voxscribe import sources
from voxscribe.functions import decode, encoding
from voxscribe.functions.realize import KINDS, kinds_of
from voxscribe.plans import evaluate


def by_fours(text):
    """Tokens of four characters between two special ones of none."""
    cuts = range(0, len(text), 4)
    return [1, *(100 + len(text[i : i + 4]) for i in cuts), 2], [(0, 0), *((i, min(i + 4, len(text))) for i in cuts), (0, 0)]


def ids_only(text):
    return [ord(c) for c in text], [(i, i + 1) for i in range(len(text))]


def test_alignment():
    offsets = [(0, 0), (0, 4), (4, 8), (9, 12), (0, 0)]
    assert encoding.aligned(4, 6, offsets) == (2, 3) and encoding.aligned(3, 8, offsets) == (1, 3) and encoding.aligned(6, 12, offsets) == (2, 4)
    for a, b in ((8, 9), (11, 13), (12, 20)):
        with pytest.raises(ValueError, match="no tokens cover"):
            encoding.aligned(a, b, offsets)


def example(text):
    cands = decode.build_candidates(text)
    return encoding.encode(text, cands, by_fours, ids_only), cands


def test_batches_and_pooling_match_plain_loops():
    examples = [example("booking id seven three"), example("nothing here"), example("pay twenty dollars at four thirty")]
    batch = encoding.collate(examples, pad=0)
    assert batch.ids.shape == (3, max(len(e.ids) for e, _ in examples)) and batch.offsets[-1] == sum(len(c) for _, c in examples) == len(batch.spans)
    rng = np.random.default_rng(0)
    tokens, replaced = rng.standard_normal((*batch.ids.shape, 5)), rng.standard_normal((*batch.replacement_ids.shape, 5))
    spans, heads = encoding.pooled_spans(tokens, batch.sentence, batch.spans), encoding.pooled_replacements(replaced, batch.replacement_mask)
    head = encoding.Head(5, seed=1)
    scores = head(batch, tokens, replaced)
    at = 0
    for s, (encoded, cands) in enumerate(examples):
        for (a, b), ids, c in zip(encoded.spans, encoded.replacements, cands):
            inside, said = tokens[s, a:b], replaced[at, : len(ids)]
            assert np.allclose(spans[at], np.concatenate([inside[0], inside[-1], inside.mean(0)]))
            assert np.allclose(heads[at], np.concatenate([said[0], said[-1], said.mean(0)]))
            flags = np.array([float(k in kinds_of(c.kind_mask)) for k in KINDS])
            assert (batch.kinds[at] == flags).all()
            z = np.concatenate([spans[at], flags @ head.kinds, heads[at]]) @ head.inner + head.inner_shift
            assert math.isclose(scores[at], sum(x * 0.5 * (1 + math.erf(x / math.sqrt(2))) * w for x, w in zip(z, head.outer)) + head.outer_shift, rel_tol=1e-9)
            at += 1
    chosen, total = decode.best_path(len("booking id seven three"), [(c.char_start, c.char_end) for c in examples[0][1]], scores[: batch.offsets[1]].tolist())
    assert total >= 0 and len(set(chosen)) == len(chosen)


def test_batches_that_tell_nothing_are_refused():
    encoded, cands = example("id seven three")
    with pytest.raises(ValueError, match="needs a sentence"):
        encoding.collate([], 0)
    with pytest.raises(ValueError, match="differ in number"):
        encoding.collate([(encoded, cands[1:])], 0)
    with pytest.raises(ValueError, match="no token"):
        encoding.collate([(encoded._replace(replacements=[[] for _ in cands]), cands)], 0)
    with pytest.raises(ValueError, match="empty or outside"):
        encoding.collate([(encoded._replace(spans=[(1, 1) for _ in cands]), cands)], 0)
    same = [cands[0], cands[0]._replace(replacement="other")]
    with pytest.raises(ValueError, match="tells"):
        encoding.collate([(encoding.Encoded(encoded.ids, [(1, 2)] * 2, [[7]] * 2), same)], 0)
    with pytest.raises(ValueError, match="over the limit"):
        encoding.encode("x " * 2000, [], by_fours, ids_only)
    empty = encoding.collate([(encoding.Encoded([1, 2], [], []), [])], 0)
    assert encoding.Head(4)(empty, np.zeros((1, 2, 4)), np.zeros((0, 0, 4))).shape == (0,)


def test_runs_keep_errors_and_audits_find_differences(spark):
    def flaky():
        def normalize(text):
            if text == "bad":
                raise RuntimeError("no")
            return text.upper()

        return normalize

    schema = "id int, text string, expected_text string, spans array<struct<start:int,category:string,replacement:string,span_kind:string>>"
    rows = spark.createDataFrame([(1, "a", "A", []), (2, "bad", "BAD", []), (3, "c", "c", [])], schema)
    out = evaluate.predicted(rows, flaky)
    got = {r["id"]: r for r in evaluate.scored(out).collect()}
    assert got[1]["strict_exact"] and got[2]["error"] == "RuntimeError: no" and got[2]["error_type"] == "backend_error" and not got[3]["strict_exact"] and got[1]["latency_ms"] >= 0
    left, right = out.select("id", "prediction"), spark.createDataFrame([(1, "A"), (3, "c"), (4, "D")], "id int, prediction string")
    found = evaluate.audit(left, right).first()
    assert (found["rows"], found["identical_rows"], found["mismatches"], found["one_sided"]) == (4, 1, 1, 2) and found["left_digest"] != found["right_digest"]
    assert sorted(r["id"] for r in evaluate.mismatches(left, right).collect()) == [2, 3, 4]
    again = evaluate.audit(left, left.repartition(3)).first()
    assert again["left_digest"] == again["right_digest"] and again["identical_rows"] == 3


def test_frozen_files(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_bytes(b"{}\n")
    digest = hashlib.sha256(b"{}\n").hexdigest()
    assert sources.frozen(spark, {str(path): digest}) == {str(path): digest}
    with pytest.raises(ValueError, match="SHA-256"):
        sources.frozen(spark, {str(path): "0" * 64})
