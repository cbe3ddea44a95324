"""One normalizer with its scorer and its context, for single texts and for DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from voxscribe.functions.learned import LogLinear
from voxscribe.functions.score import score
from voxscribe.functions.temporal import Context, Span
from voxscribe.plans import candidates


class Result(NamedTuple):
    """The written text, the same with dates resolved, the path's score, and the spans that were rewritten."""

    text: str
    resolved_text: str
    score: float
    spans: list[Span]


class Normalizer:
    """scorer: (text, candidates) → scores. A context given to a call stands in place of the normalizer's own, as a whole."""

    def __init__(self, scorer: Callable = score, context: Context | None = None):
        self.scorer, self.context = scorer, self._checked(context)
        self._memo: dict = {}

    @classmethod
    def from_pretrained(cls, path: str, digest: str | None = None, context: Context | None = None) -> Normalizer:
        """With weights that LogLinear.save wrote; they must have their digest, and the one given, and be for these kinds."""
        return cls(LogLinear.load(path, digest), context)

    @staticmethod
    def _checked(context: Context | None) -> Context | None:
        if context is not None and not isinstance(context, Context):
            raise TypeError("context must be a Context or None")
        return context

    def _effective(self, context: Context | None) -> Context | None:
        return self.context if self._checked(context) is None else context

    def normalize_structured(self, text: str, context: Context | None = None) -> Result:
        if not isinstance(text, str):
            raise TypeError("text must be a string")
        out = candidates.normalize_text(text, self._effective(context), self.scorer, self._memo)
        spans = [Span(s["source_start"], s["source_end"], s["start"], s["end"], s["source_text"], s["text"], s["kind_mask"], s["resolved_value"]) for s in out["spans"]]
        return Result(out["text"], out["resolved_text"], out["score"], spans)

    def normalize(self, text: str, context: Context | None = None) -> str:
        return self.normalize_structured(text, context).text

    def normalize_resolved(self, text: str, context: Context | None = None) -> str:
        return self.normalize_structured(text, context).resolved_text

    def rows(self, texts: DataFrame, text: str = "text", context: Context | None = None) -> DataFrame:
        """The rows of texts with a column `result`; in batches and in streams."""
        return candidates.normalize(texts, text, self._effective(context), self.scorer)
