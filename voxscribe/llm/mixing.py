"""
Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sizes are counted in words. The mix holds `share` times all words; sources in code-point order (null last) weigh 5, 2, 1,
repeating, and a target that would pass `most` times its source's size stops there, its excess going to the others by weight.
The mix is made of equal blocks of `block_words` words. Highest quotients target / (2k - 1) give each source a whole number
of blocks; each source's blocks are apportioned to its shards by their words in the same way, and each shard's to its cells
(about `cell_docs` documents each), so the integer quotas add up exactly at every level and no step ranks more than the
square root of a source's cells. In a cell the documents stand in a seeded order as one stream of words, cut into blocks;
every block is taken quota // blocks times and the rest goes once more to blocks chosen by a seeded even spacing, which
is a closed form: nothing is expanded to blocks or words.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, last in order; null ids are hashed
as the empty text; repeated rows each count and take their part; an empty table gives an empty result; if no document
has a word, every target and taken is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxscribe.llm.common import columns, id_text, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame, seed: str = "mix", carry: bool = False) -> DataFrame:
    """doc_id, source, size and the seeded digest that orders and deals out the documents; carry: the whole row as well, as `row`."""
    return docs.select(
        *[F.struct(*columns(docs)).alias("row")] * carry,
        F.col("doc_id").cast("long"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), id_text())).alias("digest"),
    )


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, cell_docs: int = 256) -> DataFrame:
    """A row per source: no (from 0 in code-point order), source_size, docs, target, and how many shards and cells a shard its documents are dealt to."""
    everything = Window.partitionBy(F.lit(0))  # one row a source
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "no")
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    t = t.withColumn("no", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("no") % len(weights) + 1))
    t = t.withColumn("top", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    t = t.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    stopped = F.sum("top").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("top")
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - stopped) / onward)
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    cells = F.ceil(F.col("docs") / cell_docs)
    shards = F.ceil(F.sqrt(cells))
    return t.select(
        "source",
        "no",
        "source_size",
        F.coalesce(F.least("top", F.col("weight") * F.col("level")), F.col("top")).alias("target"),
        "total",
        shards.cast("long").alias("shards"),
        F.ceil(cells / shards).cast("long").alias("cells"),
    )


def apportion(children: DataFrame, parent: list[str], child: str, weight: str, house: str) -> DataFrame:
    """
    Adds `quota`: the seats of a parent's `house` that each child gets by Sainte-Laguë's highest quotients, ties to the smaller child.

    Rounding house ± half the number of children to each child's share brackets its seats; only quotients between the
    brackets (two or three a child on average) are ranked. A parent without weight gives no seats.
    """
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    w, n = F.col(weight).cast("double"), F.col(house)
    c = children.withColumn("_sum", F.sum(w).over(of)).withColumn("_n", F.count("*").over(of))

    def bracket(sign: int) -> Column:
        x = F.greatest(F.lit(0.0), n + sign * (F.col("_n") / 2 + 1))
        return F.when(F.col("_sum") > 0, F.floor(w * x / F.col("_sum") + 0.5)).otherwise(0).cast("long")

    c = c.withColumn("_low", bracket(-1)).withColumn("_high", bracket(1))
    c = c.withColumn("_open", n - F.sum("_low").over(of))
    seats = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))
    c = c.withColumn("_seat", F.explode_outer(seats))
    ranked = of.orderBy(F.when(F.col("_seat").isNotNull(), w / (2 * F.col("_seat") - 1)).desc_nulls_last(), child, "_seat")
    c = c.withColumn("_won", (F.col("_seat").isNotNull() & (F.row_number().over(ranked) <= F.col("_open"))).cast("long"))
    keys = [x for x in children.columns]
    return c.groupBy(*keys).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def _part(digest: Column, at: int, parts: Column) -> Column:
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % parts


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, block_words: int = 16, cell_docs: int = 256, seed: str = "mix", carry: bool = False) -> DataFrame:
    """
    doc_id, size, source_size, target and taken for every row of docs (doc_id, text, source), and the place of its words in the mix:
    `start` (words of its cell before it), `blocks` (of the cell), `times` (that every block is taken), `extra` (blocks taken once more) and `turn` (their offset). carry: the whole row comes along as `row`.
    """
    rows = written(sized(docs, seed), "sizes")
    goals = written(targets(rows, share, most, weights, cell_docs), "targets")
    houses = apportion(goals.withColumn("house", F.round(F.col("total") / block_words).cast("long")), [], "no", "target", "house")
    houses = written(houses.select("no", "quota"), "quotas")
    known = goals.select(F.col("source").alias("_source"), "no", "source_size", "target", "shards", "cells")

    def place(rows: DataFrame) -> DataFrame:
        dealt = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
        return dealt.withColumn("shard", _part(F.col("digest"), 1, F.col("shards"))).withColumn("cell", _part(F.col("digest"), 9, F.col("cells")))

    cells = written(place(rows).groupBy("no", "shard", "cell").agg(F.sum("size").alias("words")), "cells")
    shards = cells.groupBy("no", "shard").agg(F.sum("words").alias("shard_words")).join(houses.withColumnRenamed("quota", "house"), "no")
    shards = apportion(shards, ["no"], "shard", "shard_words", "house").select("no", "shard", F.col("quota").alias("house"))
    quotas = apportion(cells.join(shards, ["no", "shard"]), ["no", "shard"], "cell", "words", "house")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long")
    quotas = quotas.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.lit(int(most)) * F.col("blocks")))
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "no", "shard", "cell")), 1, 8), 16, 10).cast("long") % F.col("blocks")
    quotas = written(quotas.select("no", "shard", "cell", "blocks", F.expr("quota div blocks").alias("times"), (F.col("quota") % F.col("blocks")).alias("extra"), turn.alias("turn")), "cell-quotas")
    stream = Window.partitionBy("no", "shard", "cell").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = place(sized(docs, seed, True) if carry else rows).join(quotas, ["no", "shard", "cell"]).withColumn("start", F.sum("size").over(stream) - F.col("size"))
    b = block_words
    out = out.withColumn("taken", F.expr(f"({_taken(f'(start + size)', b)}) - ({_taken('start', b)})"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "digest", "start", "blocks", "times", "extra", "turn", *["row"] * carry)


def _chosen(block: str) -> str:
    """SQL: how many of a cell's first `block` blocks are taken once more."""
    return f"(({block} + turn) * extra div blocks - turn * extra div blocks)"


def _taken(word: str, block_words: int) -> str:
    """SQL: how many words the mix takes of a cell's first `word` words."""
    whole = f"({word} div {block_words})"
    return f"times * {word} + {block_words} * {_chosen(whole)} + ({word} % {block_words}) * ({_chosen(f'({whole} + 1)')} - {_chosen(whole)})"


def mixed_documents(docs: DataFrame, block_words: int = 16, **options) -> DataFrame:
    """
    The mix itself: for each document a row for every time that some of its words are taken. A row that takes all its words
    keeps its text as it is, another has the taken words joined by one space; n_chars is counted anew, other columns stay.
    """
    rows = mix(docs, block_words=block_words, **options, carry=True).where("taken > 0")
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(1), (F.col("times") + (F.col("extra") > 0).cast("int")).cast("int"))))
    at = f"((start + i) div {block_words})"
    words = F.expr(rf"filter(regexp_extract_all(row.text, '[^\\x20\\x09-\\x0D]+', 0), (w, i) -> {_chosen(f'({at} + 1)')} > {_chosen(at)})")
    rows = rows.withColumn("words", F.when(F.col("round") > F.col("times"), words)).where("words is null or size(words) > 0")
    text = F.when(F.col("words").isNull() | (F.size("words") == F.col("size")), F.col("row.text")).otherwise(F.array_join("words", " "))
    new = {"text": text} | {"n_chars": F.length(text).cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return rows.select(*[new[c].alias(c) if c in new else kept for c, kept in zip(docs.columns, columns(docs, "row"))])


def _apportion_sql(name: str, rows: str, parent: str, child: str, weight: str, house: str) -> str:
    """Common table expressions with the same seats: every quotient between the brackets is ranked."""
    of = f"PARTITION BY {parent}" if parent else ""
    bracket = lambda sign: f"CASE WHEN _sum > 0 THEN floor({weight}::DOUBLE * greatest(0.0, {house} {sign} (_n / 2 + 1)) / _sum + 0.5) ELSE 0 END::BIGINT"
    return f"""
        {name}_a AS (SELECT *, sum({weight}::DOUBLE) OVER ({of}) AS _sum, count(*) OVER ({of}) AS _n FROM {rows}),
        {name}_b AS (SELECT *, {bracket("-")} AS _low, {bracket("+")} AS _high FROM {name}_a),
        {name}_c AS (SELECT *, {house} - sum(_low) OVER ({of}) AS _open FROM {name}_b),
        {name}_d AS (SELECT *, unnest(CASE WHEN _high > _low THEN range(_low + 1, _high + 1) ELSE [NULL::BIGINT] END) AS _seat FROM {name}_c),
        {name}_e AS (SELECT *, row_number() OVER ({of} ORDER BY {weight}::DOUBLE / (2 * _seat - 1) DESC NULLS LAST, {child}, _seat) AS _rank FROM {name}_d),
        {name} AS (SELECT * EXCLUDE (_sum, _n, _low, _high, _open, _seat, _rank), first(_low) + count(*) FILTER (WHERE _seat IS NOT NULL AND _rank <= _open) AS quota FROM {name}_e GROUP BY ALL)"""


def oracle_sql(block_words: int = 16, cell_docs: int = 256, seed: str = "mix") -> str:
    """DuckDB SQL with the rows of mix(documents)."""
    part = lambda at, parts: f"('0x' || substr(digest, {at}, 8))::BIGINT % {parts}"
    chosen = lambda block: f"((({block}) + turn) * extra // blocks - turn * extra // blocks)"

    def taken(word: str) -> str:
        whole = f"(({word}) // {block_words})"
        return f"(times * ({word}) + {block_words} * {chosen(whole)} + (({word}) % {block_words}) * ({chosen(f'{whole} + 1')} - {chosen(whole)}))"

    return f"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
        t0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM s GROUP BY source),
        t1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM t0),
        t2 AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, 2 * source_size::DOUBLE AS top, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM t1),
        t3 AS (SELECT *, (total - (sum(top) OVER (ORDER BY top / weight, no ROWS UNBOUNDED PRECEDING) - top)) / sum(weight) OVER (ORDER BY top / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t2),
        t4 AS (SELECT *, max(CASE WHEN level <= top / weight THEN level END) OVER () AS mu FROM t3),
        t5 AS (SELECT source, no, source_size, coalesce(least(top, weight * mu), top) AS target, round(total / {block_words})::BIGINT AS house, ceil(docs / {float(cell_docs)}) AS c FROM t4),
        goals AS (SELECT *, ceil(sqrt(c))::BIGINT AS shards, ceil(c / ceil(sqrt(c)))::BIGINT AS cells FROM t5),
        {_apportion_sql("houses", "goals", "", "no", "target", "house")},
        placed AS (SELECT s.*, no, source_size, target, {part(1, "shards")} AS shard, {part(9, "cells")} AS cell FROM s JOIN goals ON s.source IS NOT DISTINCT FROM goals.source),
        words AS (SELECT no, shard, cell, sum(size)::BIGINT AS words FROM placed GROUP BY ALL),
        shard_words AS (SELECT no, shard, sum(words)::BIGINT AS words, any_value(quota) AS house FROM words JOIN (SELECT no, quota FROM houses) USING (no) GROUP BY no, shard),
        {_apportion_sql("shard_quotas", "shard_words", "no", "shard", "words", "house")},
        cell_words AS (SELECT words.*, quota AS house FROM words JOIN (SELECT no, shard, quota FROM shard_quotas) USING (no, shard)),
        {_apportion_sql("cell_quotas", "cell_words", "no, shard", "cell", "words", "house")},
        q0 AS (SELECT no, shard, cell, quota, greatest(1, ceil(words / {float(block_words)}))::BIGINT AS blocks, md5('{seed}:' || no || ':' || shard || ':' || cell) AS digest FROM cell_quotas),
        q1 AS (SELECT *, least(quota, 2 * blocks)::BIGINT AS q, {part(1, "blocks")} AS turn FROM q0),
        q AS (SELECT no, shard, cell, blocks, turn, q // blocks AS times, q % blocks AS extra FROM q1),
        p AS (SELECT placed.*, blocks, turn, times, extra, (sum(size) OVER (PARTITION BY no, shard, cell ORDER BY placed.digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start FROM placed JOIN q USING (no, shard, cell))
        SELECT doc_id, size, source_size, target, ({taken("start + size")} - {taken("start")})::BIGINT AS taken FROM p
    """
