"""
Scoring of predictions against expected texts and their metrics, as relational aggregation.

Rows: id, text, expected_text, group, domain, difficulty, categories, collision, collision_pair_id, spans (array of structs with
start, category, replacement and the kind's name in span_kind), and prediction.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxscribe.functions import compare
from voxscribe.shipping import ship

#: Categories compared without regard to case and spacing.
COMPACT = {"EMAIL", "URL", "VERSION", "FILENAME", "IDENTIFIER", "CODE", "ACRONYM"}
QUOTES = str.maketrans("‘’“”", "''\"\"")


def row_kind(spans: Column) -> Column:
    """KEEP without spans, MULTI with several, else the category."""
    return F.when(F.size(spans) == 0, F.lit("KEEP")).when(F.size(spans) > 1, F.lit("MULTI")).otherwise(spans[0]["category"])


def compact(text: str) -> str:
    return re.sub(r"\s+", "", text.translate(QUOTES).casefold())


def variants(value: str) -> list[str]:
    """As it is, without space before marks, and without any space; each once."""
    return list(dict.fromkeys([value, re.sub(r"\s+([^\w\s])\s*", r"\1", value), re.sub(r"\s+", "", value)]))


def contexts(expected: str, replacements: list[str]) -> list[str] | None:
    """The texts before, between and after the replacements, found one after another; null if one isn't there."""
    out, at = [], 0
    for r in replacements:
        i = expected.find(r, at)
        if i < 0:
            return None
        out.append(expected[at:i])
        at = i + len(r)
    return [*out, expected[at:]]


def entities(prediction: str, around: list[str]) -> list[str] | None:
    """What a prediction has in the places of the entities, by its context's words; null if the context isn't there."""
    words = [re.findall(r"\w+|[^\w\s]", c.translate(QUOTES).casefold()) for c in around]
    marks = [(m[0].translate(QUOTES).casefold(), *m.span()) for m in re.finditer(r"\w+|[^\w\s]", prediction)]

    def walk(k: int, at: int) -> list[tuple[int, int]] | None:
        need = words[k]
        last = k == len(words) - 1
        starts = [at] if k == 0 else range(at + 1, len(marks) - len(need) + 1)
        for s in starts:
            if [m[0] for m in marks[s : s + len(need)]] != need or (last and s + len(need) != len(marks)):
                continue
            if last:
                return [(at, s)]
            rest = walk(k + 1, s + len(need))
            if rest is not None:
                return [(at, s), *rest]
        return None

    if len(words) == 1:
        return [] if [m[0] for m in marks] == words[0] else None
    found = walk(0, 0)
    return None if found is None else [prediction[marks[a][1] : marks[b - 1][2]] for a, b in found[1:]]


def same_entity(category: str, kind: str | None, want: str, got: str) -> bool:
    if category == "PERCENT":
        number = lambda t: re.sub(r"\s*(?:%|percent)$", "", t.strip().casefold())
        return compare.equivalent("DECIMAL", number(want), number(got))
    if category in COMPACT:
        return compact(want) == compact(got)
    if kind is None or kind not in compare.KINDS:
        return want == got
    for v in variants(got):
        try:
            if compare.equivalent(kind, want, v):
                return True
        except (ValueError, OverflowError):
            continue
    return False


def score_row(text: str, expected: str, prediction: str, spans: list[dict]) -> dict:
    """Exactness, entities found, whether the decision to edit was right, and the kind of error."""
    replacements = [s["replacement"] for s in sorted(spans, key=lambda s: s["start"])]
    around = contexts(expected, replacements)
    got = entities(prediction, around) if around is not None and replacements else []
    right = sum(same_entity(s["category"], s["span_kind"], s["replacement"], g) for s, g in zip(sorted(spans, key=lambda s: s["start"]), got or []))
    exact = prediction == expected
    edited, wanted = prediction != text, bool(spans)
    decision = edited == wanted
    every = right == len(spans) if spans else exact
    error = None if exact or (spans and every) else "false_normalization" if edited and not wanted else "missed_edit" if wanted and not edited else "wrong_rewrite"
    return {"strict_exact": exact, "entities_correct": right, "entities_total": len(spans), "entity_correct": every, "decision_correct": decision, "error_type": error, "predicted_entities": got or []}


#: Kinds that have a comparator; all others are compared as they stand.
COMPARED = set(compare.KINDS)


def semantic_kind(kind: Column) -> Column:
    """A span's kind where its values are compared by meaning, else null."""
    return F.when(kind.isin(*sorted(COMPARED)), kind)


SCORED = "struct<strict_exact:boolean,entities_correct:int,entities_total:int,entity_correct:boolean,decision_correct:boolean,error_type:string,predicted_entities:array<string>>"


ARROW_SCORED = pa.struct([("strict_exact", pa.bool_()), ("entities_correct", pa.int32()), ("entities_total", pa.int32()), ("entity_correct", pa.bool_()), ("decision_correct", pa.bool_()), ("error_type", pa.string()), ("predicted_entities", pa.list_(pa.string()))])


def failed_row(spans: list[dict]) -> dict:
    """The score of a row whose prediction failed."""
    return {"strict_exact": False, "entities_correct": 0, "entities_total": len(spans), "entity_correct": False, "decision_correct": False, "error_type": "backend_error", "predicted_entities": None}


def scored(rows: DataFrame) -> DataFrame:
    """The rows with their kind and the fields of score_row; a column error marks predictions that failed."""
    ship(rows.sparkSession)

    @F.arrow_udf(SCORED)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, wanted, predictions, spans, errors in batches:
            rows = zip(*(x.to_pylist() for x in (texts, wanted, predictions, spans, errors)))
            yield pa.array([score_row(t, w, p, s or []) if e is None else failed_row(s or []) for t, w, p, s, e in rows], ARROW_SCORED)

    error = F.col("error").cast("string") if "error" in rows.columns else F.lit(None).cast("string")
    out = rows.withColumn("kind", row_kind(F.col("spans"))).withColumn("_s", run("text", "expected_text", "prediction", "spans", error))
    return out.select("*", "_s.*").drop("_s")


def predicted(rows: DataFrame, backend: Callable[[], Callable[[str], str]], warm: tuple[str, ...] = ("warm up at five thirty", "call nine one one"), rounds: int = 5) -> DataFrame:
    """
    The rows with prediction, latency_ms and error. backend makes a worker's function from text to text; it is warmed up before
    the first row, and a row where it raises has an empty prediction and the error, for the others to go on.
    """
    ship(rows.sparkSession)

    @F.arrow_udf("struct<prediction:string,latency_ms:double,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        normalize = backend()
        for text in warm * rounds:
            normalize(text)
        for b in batches:
            out = []
            for text in b.to_pylist():
                began, said, error = time.perf_counter_ns(), "", None
                try:
                    said = normalize(text)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append({"prediction": said, "latency_ms": (time.perf_counter_ns() - began) / 1e6, "error": error})
            yield pa.array(out, pa.struct([("prediction", pa.string()), ("latency_ms", pa.float64()), ("error", pa.string())]))

    return rows.withColumn("_p", run("text")).select(*rows.columns, "_p.*")


def metric_columns() -> list[Column]:
    n = F.count("*")
    share = lambda c: F.try_divide(F.sum(F.col(c).cast("int")), n)
    return [
        n.alias("rows"),
        share("strict_exact").alias("strict_exact"),
        F.sum("entities_correct").alias("entities_correct"),
        F.sum("entities_total").alias("entities_total"),
        F.try_divide(F.sum("entities_correct"), F.sum("entities_total")).alias("entity_accuracy"),
        share("decision_correct").alias("decision_accuracy"),
    ]


def sliced(rows: DataFrame) -> DataFrame:
    """Metrics overall and by kind, group, domain and difficulty in one pass of grouping sets, and by category (a row counts once a span)."""
    keys = ["kind", "group", "domain", "difficulty"]
    sets = rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(*metric_columns(), F.grouping_id().alias("_set"))
    names = {15: "overall", 7: "kind", 11: "group", 13: "domain", 14: "difficulty"}
    name = F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), F.col("_set").cast("int"))
    value = F.coalesce(*[F.when(F.col("_set") == k, F.col(names[k])) for k in names if names[k] != "overall"])
    out = sets.select(name.alias("slice"), value.alias("value"), "rows", "strict_exact", "entities_correct", "entities_total", "entity_accuracy", "decision_accuracy")
    by = rows.withColumn("category", F.explode("spans.category")).groupBy("category").agg(*metric_columns())
    return out.unionByName(by.withColumnRenamed("category", "value").withColumn("slice", F.lit("category")))


def subsets(rows: DataFrame) -> DataFrame:
    """Metrics of the rows of several spans, of voice agents, of negatives and of no span, and of each collision family; in one pass, a row counting in each subset that has it."""
    named = {"multi_entity": F.size("spans") > 1, "voice_agent": F.col("group") == "voice_agent", "standalone_negative_keep": F.col("group") == "negative", "all_no_span_keep": F.size("spans") == 0}
    flags = [F.when(where, F.struct(F.lit("subset").alias("slice"), F.lit(name).alias("value"))) for name, where in named.items()]
    family = F.when(F.col("collision") != "", F.struct(F.lit("collision_family").alias("slice"), F.col("collision").alias("value")))
    return rows.withColumn("_in", F.explode(F.array_compact(F.array(*flags, family)))).select("*", "_in.*").groupBy("slice", "value").agg(*metric_columns())


def audit(left: DataFrame, right: DataFrame, key: str = "id", column: str = "prediction") -> DataFrame:
    """
    One row that tells whether two runs predict the same: rows, identical_rows, mismatches, rows that only one side has, and a digest of each side that depends on
    every key and prediction but not on their order. Keys must not repeat; mismatches() lists the rows.
    """
    digest = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(key), F.col(c)).cast("decimal(38,0)"))).alias(f"{c}_digest")
    both = left.select(key, F.col(column).alias("left")).join(right.select(key, F.col(column).alias("right")), key, "full")
    same = F.col("left").isNotNull() & (F.col("left") == F.col("right"))
    n = lambda where: F.coalesce(F.sum(where.cast("long")), F.lit(0)).alias
    return both.agg(F.count("*").alias("rows"), n(same)("identical_rows"), n(F.col("left") != F.col("right"))("mismatches"), n(F.col("left").isNull() != F.col("right").isNull())("one_sided"), digest("left"), digest("right"))


def mismatches(left: DataFrame, right: DataFrame, key: str = "id", column: str = "prediction") -> DataFrame:
    """key, left and right of every row where two runs differ, or that one of them lacks."""
    both = left.select(key, F.col(column).alias("left")).join(right.select(key, F.col(column).alias("right")), key, "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def collision_pairs(rows: DataFrame, pair: str = "collision_pair_id", family: str = "collision") -> DataFrame:
    """By family: pairs, and pairs whose rows are all exact or all right in meaning."""
    pairs = rows.where(F.col(pair).isNotNull()).groupBy(family, pair).agg(F.bool_and("strict_exact").alias("exact"), F.bool_and("entity_correct").alias("same"))
    return pairs.groupBy(family).agg(F.count("*").alias("pairs"), F.avg(F.col("exact").cast("int")).alias("strict"), F.avg(F.col("same").cast("int")).alias("semantic"))


def latency(rows: DataFrame, ms: str, *by: str) -> DataFrame:
    """Count, total, mean, population deviation, extremes, linear percentiles and rows a second of a column of milliseconds."""
    q = lambda p: F.percentile(ms, F.lit(p)).alias(f"p{int(p * 100)}")
    return rows.groupBy(*by).agg(
        F.count(ms).alias("n"),
        F.sum(ms).alias("total"),
        F.avg(ms).alias("mean"),
        F.stddev_pop(ms).alias("deviation"),
        F.min(ms).alias("least"),
        *map(q, (0.5, 0.9, 0.95, 0.99)),
        F.max(ms).alias("most"),
        F.try_divide(F.count(ms), F.sum(ms) / 1000).alias("rows_per_second"),
    )


def macro_accuracy(rows: DataFrame, category: str, correct: str) -> DataFrame:
    """The mean over categories of the share that is correct."""
    return rows.groupBy(category).agg(F.avg(F.col(correct).cast("int")).alias("share")).agg(F.avg("share").alias("macro_accuracy"))


def report(metrics: DataFrame) -> str:
    """Markdown of sliced(): a few dozen rows."""
    head = ["slice", "value", "rows", "strict_exact", "entity_accuracy", "decision_accuracy"]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in metrics.select(*head).orderBy("slice", "value").collect():
        lines.append("| " + " | ".join("" if v is None else f"{v:.2%}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"
