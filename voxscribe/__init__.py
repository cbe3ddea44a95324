"""A PySpark engine that rewrites spoken-form English transcripts in written form, and evaluates the result."""

import importlib

__version__ = "0.1.0"
#: Public name → where it is. Each is imported when it is first asked for, so a worker that needs one part doesn't load the others.
_PLACES = {
    "Candidate": ("functions.decode", "Candidate"),
    "Context": ("functions.temporal", "Context"),
    "Gold": ("functions.decode", "Gold"),
    "KINDS": ("functions.realize", "KINDS"),
    "Normalizer": ("normalizer", "Normalizer"),
    "ORDERS": ("functions.temporal", "ORDERS"),
    "Result": ("normalizer", "Result"),
    "Span": ("functions.temporal", "Span"),
    "build_candidate_graph": ("functions.decode", "build_candidates"),
    "build_candidates": ("functions.decode", "build_candidates"),
    "build_gold_graph": ("functions.decode", "gold_graph"),
    "candidates": ("functions.realize", "candidates"),
    "gold_graph": ("functions.decode", "gold_graph"),
    "normalize_sentence": ("functions.baseline", "normalize_sentence"),
    "reachable": ("functions.decode", "reachable"),
    "realize": ("functions.realize", "realize"),
    "realize_options": ("functions.realize", "realize_options"),
    "representations_equivalent": ("functions.compare", "equivalent"),
    "target_is_reachable": ("functions.decode", "reachable"),
    "tn_normalize": ("functions.baseline", "verbalize"),
    "verbalize": ("functions.baseline", "verbalize"),
}
__all__ = [*_PLACES, "build_info"]


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, attribute = _PLACES[name]
    return getattr(importlib.import_module(f"{__name__}.{module}"), attribute)


def build_info() -> dict[str, str]:
    """Versions that a result depends on, and the kinds in the order of their bits."""
    import platform

    import numpy
    import pyarrow
    import pyspark

    from voxscribe.functions.realize import KINDS

    return {"version": __version__, "python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__, "kinds": ",".join(KINDS)}
