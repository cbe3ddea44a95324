"""Every query of the engine by name, with the SQL that gives the same rows. The tables hold no spoken numbers, so inputs are spelled from columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxscribe import operators
from voxscribe.functions import baseline, columns, spell
from voxscribe.plans import candidates, evaluate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a small file came as fewer splits; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
MONEY = f"'$' || ({CENTS} // 100) || CASE WHEN {CENTS} % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0'), '0') END"
DAY = "lower(monthname(o_orderdate)) || ' ' || day(o_orderdate) || ' ' || year(o_orderdate)"


def _spoken_money(c: str) -> Column:
    cents = _cents(c)
    return F.concat(spell.cardinal(F.expr(f"cast(round({c} * 100) as bigint) div 100")), F.lit(" dollars"), F.when(cents % 100 > 0, F.concat(F.lit(" and "), spell.below_hundred(cents % 100), F.lit(" cents"))).otherwise(""))


@_query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits FROM orders")
def digits_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    return t.select("o_orderkey", columns.realize("DIGIT_SEQUENCE", spell.digits(F.col("o_orderkey").cast("string"))).alias("digits"))


@_query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS cardinal FROM lineitem")
def cardinal_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", columns.realize("CARDINAL", spell.cardinal(F.col("l_quantity").cast("long"))).alias("cardinal"))


@_query("SELECT o_orderkey, CAST(o_orderkey * 1000003 AS VARCHAR) AS cardinal FROM orders")
def large_cardinal_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    return t.select("o_orderkey", columns.realize("CARDINAL", spell.cardinal(F.col("o_orderkey") * 1000003)).alias("cardinal"))


@_query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 100 IN (11, 12, 13) THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM part")
def ordinal_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    return t.select("p_partkey", columns.realize("ORDINAL", spell.ordinal(F.col("p_size"))).alias("ordinal"))


@_query("WITH t AS (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS BIGINT) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, (c // 100) || CASE WHEN c % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '0') END AS number FROM t")
def decimal_roundtrip(spark, sf_dir):
    t, c = _table(spark, sf_dir, "lineitem"), _cents("l_discount")
    spoken = F.concat(spell.cardinal(F.floor(c / 100)), F.lit(" point "), spell.digits(F.lpad((c % 100).cast("string"), 2, "0")))
    return t.select("l_orderkey", "l_linenumber", columns.realize("DECIMAL", spoken).alias("number"))


@_query(f"SELECT o_orderkey, {MONEY} AS amount FROM orders")
def money_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    return t.select("o_orderkey", columns.realize("MONEY", _spoken_money("o_totalprice")).alias("amount"))


@_query("SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events")
def time_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    return t.select("event_id", columns.realize("TIME", spell.clock(F.col("ts"))).alias("clock"))


@_query(f"SELECT o_orderkey, {DAY} AS day FROM orders")
def date_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    return t.select("o_orderkey", columns.realize("DATE", spell.date(F.col("o_orderdate"))).alias("day"))


@_query("WITH t AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS d FROM customer) SELECT c_custkey, d[1:3] || '-' || d[4:6] || '-' || d[7:10] AS phone FROM t")
def phone_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    return t.select("c_custkey", columns.realize("PHONE", spell.digits(F.lpad(F.col("c_custkey").cast("string"), 10, "9"))).alias("phone"))


@_query("SELECT p_partkey, p_size || ' km/h' AS speed, p_size || '%' AS share FROM part")
def measure_roundtrip(spark, sf_dir):
    t, n = _table(spark, sf_dir, "part"), spell.cardinal(F.col("p_size"))
    return t.select("p_partkey", columns.realize("MEASUREMENT", F.concat(n, F.lit(" kilometers per hour"))).alias("speed"), columns.realize("MEASUREMENT", F.concat(n, F.lit(" percent"))).alias("share"))


@_query("SELECT p_partkey, 'v' || p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 100) AS version, 'B' || p_size || 'C' AS code FROM part")
def identifier_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    size, key = spell.cardinal(F.col("p_size")), lambda m: spell.cardinal(F.col("p_partkey") % m)
    return t.select("p_partkey", columns.realize("WORD", F.concat_ws(" ", F.lit("v"), size, F.lit("dot"), key(10), F.lit("dot"), key(100))).alias("version"), columns.realize("WORD", F.concat_ws(" ", F.lit("B"), size, F.lit("C"))).alias("code"))


@_query("SELECT c_custkey, 'customer' || c_custkey || '@example.com' AS address FROM customer")
def email_roundtrip(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    return t.select("c_custkey", columns.realize("ELECTRONIC", F.concat_ws(" ", F.lit("customer"), spell.digits(F.col("c_custkey").cast("string")), F.lit("at example dot com"))).alias("address"))


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN '?' ELSE ';' END AS mark, CASE o_orderstatus WHEN 'F' THEN 'dr. f' WHEN 'O' THEN '7-eleven o' ELSE 'e.g. p' END AS short FROM orders")
def symbols_and_abbreviations(spark, sf_dir):
    t, s = _table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    mark = F.when(s == "F", "comma").when(s == "O", "Question   Mark").otherwise("semi colon")
    phrase = F.concat(F.when(s == "F", "doctor ").when(s == "O", "seven eleven ").otherwise("for example "), F.lower(s))
    return t.select("o_orderkey", columns.realize("PUNCTUATION", mark).alias("mark"), columns.realize("WHITELIST", phrase).alias("short"))


@_query("SELECT o_orderkey, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS replacement, 35 AS kind_mask FROM orders")
def kind_masks(spark, sf_dir):
    """Two digits read one by one are DIGIT_SEQUENCE, CARDINAL and DECIMAL with one replacement."""
    t = _table(spark, sf_dir, "orders").withColumn("n", (F.col("o_orderkey") % 90 + 10).cast("string"))
    read = t.select("o_orderkey", "n", F.inline(columns.realize_candidates(spell.digits(F.col("n")))))
    return read.where("replacement = n").select("o_orderkey", "replacement", "kind_mask")


@_query("SELECT conv_id, turn, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')) AS n_tokens FROM conversations")
def token_counts(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(r"((?U)\w+|[^\w\s])"), F.lit(1))).cast("long").alias("n_tokens"))


@_query("WITH t AS (SELECT conv_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')) AS n FROM conversations) SELECT conv_id, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS n_spans FROM t GROUP BY conv_id")
def span_counts(spark, sf_dir):
    t = token_counts(spark, sf_dir)
    return t.groupBy("conv_id").agg(F.sum(F.expr("n_tokens * (n_tokens + 1) div 2")).alias("n_spans"))


def _orders_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "orders")
    text = F.concat(F.lit("order number "), spell.digits(F.col("o_orderkey").cast("string")), F.lit(" was placed on "), spell.date(F.col("o_orderdate")), F.lit(" for "), _spoken_money("o_totalprice"))
    return _spread(t.select("o_orderkey", text.alias("text")))


@_query(f"SELECT o_orderkey, 'order number ' || o_orderkey || ' was placed on ' || {DAY} || ' for ' || {MONEY} AS normalized FROM orders")
def normalize_orders(spark, sf_dir):
    """The whole pipeline: candidates, scores, best path, rendering."""
    return candidates.normalized(_orders_spoken(spark, sf_dir)).select("o_orderkey", "normalized")


#: "code" and two digits: the first, the second and both together read as numbers; both together as 73 and as the time 07:03.
PAIR = "o_orderkey % 9 + 1"


@_query(
    f"""WITH t AS (SELECT o_orderkey, CAST({PAIR} AS VARCHAR) AS a, CAST(o_orderkey % 7 + 1 AS VARCHAR) AS b FROM orders)
    SELECT o_orderkey, 1 AS token_start, 2 AS token_end, 5 AS char_start, a AS replacement, 35 AS kind_mask FROM t
    UNION ALL SELECT o_orderkey, 2, 3, 6 + CAST(CASE a WHEN '3' THEN 5 WHEN '7' THEN 5 WHEN '8' THEN 5 WHEN '4' THEN 4 WHEN '5' THEN 4 WHEN '9' THEN 4 ELSE 3 END AS INTEGER), b, 35 FROM t
    UNION ALL SELECT o_orderkey, 1, 3, 5, a || b, 35 FROM t UNION ALL SELECT o_orderkey, 1, 3, 5, '0' || a || ':0' || b, 4 FROM t"""
)
def candidate_graph(spark, sf_dir):
    """The relational plan over all orders: every candidate of a two-digit code, with its place and kinds."""
    two = spell.digits(F.concat(F.expr(PAIR).cast("string"), F.expr("o_orderkey % 7 + 1").cast("string")))
    t = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("code "), two).alias("text"))
    return candidates.candidates(t, "o_orderkey").select("o_orderkey", "token_start", "token_end", "char_start", "replacement", "kind_mask")


@_query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey")
def whole_candidates(spark, sf_dir):
    """The relational plan: exactly one candidate takes the whole spoken number and writes it digit by digit."""
    t = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("code "), spell.digits(F.col("o_orderkey").cast("string"))).alias("text"))
    found = candidates.candidates(t, "o_orderkey")
    whole = found.where((F.col("replacement") == F.col("o_orderkey").cast("string")) & (F.col("token_start") == 1) & (F.getbit("kind_mask", F.lit(0)) == 1))
    return whole.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@_query("SELECT conv_id, turn, text AS normalized FROM conversations")
def normalize_conversations(spark, sf_dir):
    """Prose without spoken forms stays as it is."""
    return candidates.normalized(_spread(_table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "normalized")


WORDS = "CASE event_id % 7 WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN 2 THEN 'the day before yesterday' WHEN 3 THEN 'in two weeks' WHEN 4 THEN 'five days ago' WHEN 5 THEN 'a week from now' ELSE 'next monday' END"


@_query("SELECT event_id, CAST(CAST(CAST(ts AS DATE) + CAST(CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -2 WHEN 3 THEN 14 WHEN 4 THEN -5 WHEN 5 THEN 7 ELSE 8 - isodow(ts) END AS INTEGER) AS DATE) AS VARCHAR) AS day FROM events")
def relative_days(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    return t.select("event_id", columns.relative_day(F.expr(WORDS), F.col("ts")).cast("string").alias("day"))


@_query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dmy,
    CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END AS mdy,
    CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') END AS unordered FROM orders"""
)
def numeric_dates(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    text, year = F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(2026)
    return t.select("o_orderkey", columns.numeric_date(text, F.lit("DMY"), year).alias("dmy"), columns.numeric_date(text, F.lit("MDY"), year).alias("mdy"), columns.numeric_date(text, F.lit(None).cast("string"), year).alias("unordered"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS full_date, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE '2026-' || strftime(o_orderdate, '%m-%d') END AS this_year FROM orders")
def named_dates(spark, sf_dir):
    t, year = _table(spark, sf_dir, "orders"), F.lit(2026)
    return t.select("o_orderkey", columns.named_date(F.date_format("o_orderdate", "EEEE, MMMM d, yyyy"), year).alias("full_date"), columns.named_date(F.date_format("o_orderdate", "MMM d"), year).alias("this_year"))


#: For each comparator two written forms of the same number of cents, of the day or of the key, and one that differs in a share of the rows; the expected answer in SQL.
SAME = "o_orderkey % 3 > 0"


@_query(
    f"""WITH t AS (SELECT o_orderkey, {CENTS} AS c, day(o_orderdate) AS d, month(o_orderdate) AS m, {SAME} AS same FROM orders)
    SELECT o_orderkey, same AS money, same AS day, same AS number, same OR d = m AS swapped_day, same AS ordinal, same AS digits, same AS decimal, same AS phone, same AS measure, same AS clock, same AND c % 100 = 0 AS whole FROM t"""
)
def equivalences(spark, sf_dir):
    """All nine comparators; a third of the rows compare with another value."""
    t, cents, key = _table(spark, sf_dir, "orders"), _cents("o_totalprice"), F.col("o_orderkey")
    other = F.when(F.expr(SAME), 0).otherwise(1)
    amount = F.format_number(cents / 100, 2)
    plain = lambda c: F.replace(F.format_number(c / 100, 2), F.lit(","), F.lit(""))
    day, month = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    ending = lambda n: F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    ten = lambda n: F.lpad(n.cast("string"), 10, "2")
    grouped = lambda d: F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    bracketed = lambda d: F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit(" "), F.substring(d, 7, 4))
    clock = lambda mark: F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(mark), F.lpad((key % 59).cast("string"), 2, "0"))
    later = F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit("."), F.lpad((key % 59 + other).cast("string"), 2, "0"))
    same = columns.representations_equivalent
    return t.select(
        "o_orderkey",
        same("MONEY", F.concat(F.lit("$"), plain(cents + other)), F.concat(F.lit("USD "), amount)).alias("money"),
        same("DATE", F.date_format("o_orderdate", "d MMMM yyyy"), F.date_format(F.date_add("o_orderdate", other), "yyyy-MM-dd")).alias("day"),
        same("CARDINAL", key.cast("string"), F.format_number(key + other, 0)).alias("number"),
        same("DATE", F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.expr(SAME), F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.concat_ws("-", F.year("o_orderdate"), day, month))).alias("swapped_day"),
        same("ORDINAL", F.concat(day + other, ending(day + other)), spell.ordinal(day)).alias("ordinal"),
        same("DIGIT_SEQUENCE", F.concat((key + 100 + other).cast("string")), F.concat(F.substring((key + 100).cast("string"), 1, 2), F.lit("-"), F.substring((key + 100).cast("string"), 3, 20))).alias("digits"),
        same("DECIMAL", F.concat(plain(cents + other)), F.concat(plain(cents), F.lit("0"))).alias("decimal"),
        same("PHONE", bracketed(ten(key + other)), grouped(ten(key))).alias("phone"),
        same("MEASUREMENT", F.concat(key + other, F.lit(" km/h")), F.concat(key, F.lit(" kilometers per hour"))).alias("measure"),
        same("TIME", clock(":"), later).alias("clock"),
        same("MONEY", F.concat(F.lit("$"), F.expr("cast(round(o_totalprice * 100) as bigint) div 100").cast("string")), F.concat(F.lit("$"), plain(cents + other))).alias("whole"),
    )


@_query(
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(min(value), 6) AS least, round(max(value), 6) AS most,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"""
)
def latency_metrics(spark, sf_dir):
    out = evaluate.latency(_table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "least", "most", "p50", "p90", "p95", "p99")])


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """
    Evaluation rows made of the orders: the key in words, read as a number; every fifth has no entity, every seventh has two. Predictions leave the text as it is where the key
    is divisible by 4, put another number where it is divisible by 6, and are right elsewhere; those of keys divisible by 11 failed.
    """
    k = F.col("o_orderkey")
    t = _table(spark, sf_dir, "orders").withColumn("spoken", spell.cardinal(k))
    spoken, written = F.col("spoken"), k.cast("string")
    plain, two = k % 5 == 0, (k % 7 == 0) & (k % 5 != 0)
    text = F.when(plain, F.lit("nothing to write here")).when(two, F.concat(F.lit("from "), spoken, F.lit(" to "), spoken)).otherwise(F.concat(F.lit("pick "), spoken))
    line = lambda n: F.when(plain, F.lit("nothing to write here")).when(two, F.concat(F.lit("from "), n, F.lit(" to "), n)).otherwise(F.concat(F.lit("pick "), n))
    span = lambda at: F.struct(F.lit(at).alias("start"), F.lit("CARDINAL").alias("category"), written.alias("replacement"), F.lit("CARDINAL").alias("span_kind"))
    wrong = line((k + 1).cast("string"))
    return t.select(
        k.alias("id"),
        text.alias("text"),
        line(written).alias("expected_text"),
        F.when(plain, "negative").when(k % 3 == 0, "voice_agent").otherwise("normal").alias("group"),
        F.col("o_orderpriority").alias("domain"),
        F.col("o_orderstatus").alias("difficulty"),
        F.when(k % 8 == 0, F.col("o_orderstatus")).alias("collision"),
        F.when(plain, F.array().cast("array<struct<start:int,category:string,replacement:string,span_kind:string>>")).when(two, F.array(span(5), span(99))).otherwise(F.array(span(5))).alias("spans"),
        F.when(k % 4 == 0, text).when(k % 6 == 0, wrong).otherwise(line(written)).alias("prediction"),
        F.when(k % 11 == 0, "ValueError: no").alias("error"),
    )


#: The same rows as numbers: entities n, those right c, exact and decided; what evaluate.scored has to find.
GRADED = """g AS (SELECT o_orderkey AS k, o_orderpriority AS domain, o_orderstatus AS difficulty, CASE WHEN k % 8 = 0 THEN o_orderstatus END AS collision,
        CASE WHEN k % 5 = 0 THEN 'negative' WHEN k % 3 = 0 THEN 'voice_agent' ELSE 'normal' END AS grp, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END AS n, k % 11 <> 0 AS up,
        CASE WHEN k % 5 = 0 THEN true WHEN k % 4 = 0 THEN false ELSE k % 6 <> 0 END AS fits, k % 5 = 0 OR k % 4 <> 0 AS edits FROM orders),
    r AS (SELECT *, up AND fits AS exact, CASE WHEN up AND fits THEN n ELSE 0 END AS c, up AND edits AS decided, CASE n WHEN 0 THEN 'KEEP' WHEN 1 THEN 'CARDINAL' ELSE 'MULTI' END AS kind FROM g)"""
RATES = "count(*) AS rows, round(avg(CASE WHEN exact THEN 1 ELSE 0 END), 9) AS strict_exact, CAST(sum(c) AS BIGINT) AS entities_correct, CAST(sum(n) AS BIGINT) AS entities_total, round(sum(c) / nullif(sum(n), 0), 9) AS entity_accuracy, round(avg(CASE WHEN decided THEN 1 ELSE 0 END), 9) AS decision_accuracy"
METRICS = ("rows", "strict_exact", "entities_correct", "entities_total", "entity_accuracy", "decision_accuracy")


def _rounded(metrics: DataFrame) -> DataFrame:
    rates = {"strict_exact", "entity_accuracy", "decision_accuracy"}
    return metrics.select("slice", "value", *[F.round(c, 9).alias(c) if c in rates else F.col(c).cast("long").alias(c) for c in METRICS])


@_query(
    f"""WITH {GRADED.replace("k % ", "o_orderkey % ")}, by_all AS (SELECT CASE grouping(kind, grp, domain, difficulty) WHEN 15 THEN 'overall' WHEN 7 THEN 'kind' WHEN 11 THEN 'group' WHEN 13 THEN 'domain' ELSE 'difficulty' END AS slice,
        coalesce(kind, grp, domain, difficulty) AS value, {RATES} FROM r GROUP BY GROUPING SETS ((), (kind), (grp), (domain), (difficulty)))
    SELECT * FROM by_all UNION ALL SELECT 'category', 'CARDINAL', {RATES} FROM (SELECT r.* FROM r, range(2) AS e(i) WHERE i < n)"""
)
def sliced_metrics(spark, sf_dir):
    """Predictions scored row by row, then sliced."""
    return _rounded(evaluate.sliced(evaluate.scored(_evaluation(spark, sf_dir))))


@_query(
    f"""WITH {GRADED.replace("k % ", "o_orderkey % ")}, s AS (
        SELECT 'subset' AS slice, 'multi_entity' AS value, r.* FROM r WHERE n > 1 UNION ALL SELECT 'subset', 'voice_agent', r.* FROM r WHERE grp = 'voice_agent'
        UNION ALL SELECT 'subset', 'standalone_negative_keep', r.* FROM r WHERE grp = 'negative' UNION ALL SELECT 'subset', 'all_no_span_keep', r.* FROM r WHERE n = 0
        UNION ALL SELECT 'collision_family', collision, r.* FROM r WHERE collision IS NOT NULL)
    SELECT slice, value, {RATES} FROM s GROUP BY slice, value"""
)
def subset_metrics(spark, sf_dir):
    return _rounded(evaluate.subsets(evaluate.scored(_evaluation(spark, sf_dir))))


@_query(
    f"""WITH {GRADED.replace("k % ", "o_orderkey % ")} SELECT k AS id, kind, exact AS strict_exact, CAST(c AS INTEGER) AS entities_correct, CAST(n AS INTEGER) AS entities_total, exact AS entity_correct, decided AS decision_correct,
    CASE WHEN NOT up THEN 'backend_error' WHEN exact THEN NULL WHEN NOT edits THEN 'missed_edit' ELSE 'wrong_rewrite' END AS error_type FROM r"""
)
def scored_rows(spark, sf_dir):
    out = evaluate.scored(_evaluation(spark, sf_dir))
    return out.select("id", "kind", "strict_exact", "entities_correct", "entities_total", "entity_correct", "decision_correct", "error_type")


@_query("SELECT count(*) AS rows, CAST(sum(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS identical_rows, CAST(sum(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, 0::BIGINT AS one_sided FROM orders WHERE o_orderkey % 5 <> 0")
def prediction_audit(spark, sf_dir):
    """Two runs over the same rows: those that the predictions change against the expected texts."""
    rows = _evaluation(spark, sf_dir).where("id % 5 <> 0")
    return evaluate.audit(rows, rows.select("id", F.col("expected_text").alias("prediction"))).select("rows", "identical_rows", "mismatches", "one_sided")


@_query("SELECT o_orderkey, 'pick -' || o_orderkey AS prediction, CAST(NULL AS VARCHAR) AS error FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def backend_run(spark, sf_dir):
    """The rule-based backend over evaluation rows of one negative number, warmed up, timed and with errors kept."""
    rows = _evaluation(spark, sf_dir).where("id % 5 <> 0 AND id % 7 <> 0").drop("prediction", "error")
    rows = rows.withColumn("text", F.replace("text", F.lit("pick "), F.lit("pick minus ")))
    out = evaluate.predicted(rows, lambda: baseline.normalize_sentence)
    return out.where("latency_ms >= 0").select(F.col("id").alias("o_orderkey"), "prediction", "error")


@_query("SELECT o_orderkey, list_transform(range(13), lambda i: CAST((o_orderkey >> i) & 1 AS FLOAT)) AS flags FROM orders WHERE o_orderkey < 8192")
def kind_multihot(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").where("o_orderkey < 8192")
    return t.select("o_orderkey", columns.kind_flags("o_orderkey").alias("flags"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 20 THEN CAST(l_linenumber // 4 AS INTEGER) END AS first, CASE WHEN l_quantity <= 20 THEN CAST((l_linenumber + CAST(l_quantity AS BIGINT) - 1) // 4 + 1 AS INTEGER) END AS end_token FROM lineitem WHERE l_quantity > 0")
def encoder_alignment(spark, sf_dir):
    """Characters l_linenumber to l_linenumber + l_quantity under tokens of four characters; a span of over twenty runs past the last token."""
    t = _table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    size = F.when(F.col("l_quantity") <= 20, F.lit(8)).otherwise(F.expr("int((l_linenumber + l_quantity - 1) / 4)"))
    offsets = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("end")))
    found = columns.aligned_tokens(offsets, F.col("l_linenumber"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int"))
    return t.select("l_orderkey", "l_linenumber", found["first"].alias("first"), found["end"].alias("end_token"))


@_query("SELECT p_partkey, CASE WHEN p_size BETWEEN 20 AND 99 AND p_size % 10 > 0 AND p_partkey % 9 > 0 THEN [CAST(p_partkey % 9 + p_size AS VARCHAR), CAST(p_partkey % 9 AS VARCHAR) || p_size] END AS options FROM part WHERE p_size BETWEEN 20 AND 99 AND p_size % 10 > 0 AND p_partkey % 9 > 0")
def cardinal_options(spark, sf_dir):
    """A digit before a number of two words has two readings: their sum and both written one after another."""
    t = _table(spark, sf_dir, "part").where("p_size BETWEEN 20 AND 99 AND p_size % 10 > 0 AND p_partkey % 9 > 0")
    spoken = F.concat_ws(" ", spell.cardinal(F.col("p_partkey") % 9), spell.cardinal(F.col("p_size")))
    return t.select("p_partkey", columns.realize_options("CARDINAL", spoken).alias("options"))


@_query(
    """WITH p AS (SELECT event_type AS collision, user_id, bool_and(value > 10) AS s, bool_and(value > 5) AS m FROM events GROUP BY 1, 2)
    SELECT collision, count(*) AS pairs, round(avg(CASE WHEN s THEN 1 ELSE 0 END), 9) AS strict, round(avg(CASE WHEN m THEN 1 ELSE 0 END), 9) AS semantic FROM p GROUP BY 1"""
)
def collision_pairs(spark, sf_dir):
    t = _table(spark, sf_dir, "events").select(F.col("event_type").alias("collision"), F.col("user_id").alias("collision_pair_id"), (F.col("value") > 10).alias("strict_exact"), (F.col("value") > 5).alias("entity_correct"))
    out = evaluate.collision_pairs(t)
    return out.select("collision", "pairs", F.round("strict", 9).alias("strict"), F.round("semantic", 9).alias("semantic"))


@_query("SELECT round(avg(share), 9) AS macro_accuracy FROM (SELECT quality, avg(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS share FROM labels GROUP BY quality)")
def macro_accuracy(spark, sf_dir):
    t = _table(spark, sf_dir, "labels").select("quality", (F.col("toxic") == 0).alias("right"))
    return evaluate.macro_accuracy(t, "quality", "right").select(F.round("macro_accuracy", 9).alias("macro_accuracy"))


EDGES = "SELECT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS a, CAST(least(10, l_linenumber + 1 + l_partkey % 3) AS BIGINT) AS b, CAST(l_quantity AS BIGINT) - 20 AS s FROM lineitem"


@_query(
    f"""WITH RECURSIVE e AS ({EDGES}), g AS (SELECT l_orderkey, list({{'a': a, 'b': b, 's': s}}) AS edges FROM e GROUP BY l_orderkey),
    p AS (SELECT l_orderkey, edges, 0 AS pos, [0::BIGINT] AS best FROM g
    UNION ALL SELECT l_orderkey, edges, pos + 1, list_append(best, list_max(list_append(list_transform(list_filter(edges, lambda e: e.b = pos + 1), lambda e: best[e.a + 1] + e.s), best[pos + 1]))) FROM p WHERE pos < 10)
    SELECT l_orderkey, best[11] AS score FROM p WHERE pos = 10"""
)
def best_paths(spark, sf_dir):
    """Best total over intervals of each order, as a native fold."""
    t = _table(spark, sf_dir, "lineitem")
    edge = F.struct((F.col("l_linenumber") - 1).alias("start"), F.least(F.lit(10), F.col("l_linenumber") + 1 + F.col("l_partkey") % 3).alias("end"), (F.col("l_quantity").cast("long") - 20).alias("score"))
    return t.groupBy("l_orderkey").agg(F.collect_list(edge).alias("edges")).select("l_orderkey", operators.best_score(10, F.col("edges")).alias("score"))


@_query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 20 AS BIGINT) AS a, CAST(l_partkey % 20 + l_quantity AS BIGINT) AS b FROM lineitem)
    SELECT x.l_orderkey, count(*) AS n FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.a < y.b AND y.a < x.b GROUP BY 1"""
)
def overlap_join(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 20).alias("a"), (F.col("l_partkey") % 20 + F.col("l_quantity")).cast("long").alias("b"))
    return operators.overlaps(t, t, ["l_orderkey"], "a", "b").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 8 AS bucket FROM documents")
def length_buckets(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return operators.length_buckets(t, "n_chars", "doc_id", "source").select("doc_id", "bucket")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_orders(spark, sf_dir)
