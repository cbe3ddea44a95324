"""Plans: relational and fused candidates agree, queries match their SQL, evaluation, sources, streams, command line."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from voxscribe import __main__ as cli
from voxscribe import operators, sources, streaming
from voxscribe.functions import columns, decode, spell
from voxscribe.plans import candidates, evaluate, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TEXTS = ["the room code is one oh five", "Pay twenty dollars, école at four thirty!", "VIII kings per hour doctor dao", None, "", "  ", "no numbers", "a b c dash one 😀 two"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_match_their_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in registry.ORACLE_SQL:
        rel = con.sql(registry.ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted(got, key=str) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)


def test_relational_and_fused_candidates_agree(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = sorted(tuple(r[c] for c in ("id", "token_start", "token_end", "char_start", "char_end", "text", "replacement", "kind_mask")) for r in candidates.candidates(df, "id").collect())
    assert got == sorted((i, *c) for i, t in enumerate(TEXTS) if t for c in decode.build_candidates(t))


def test_long_texts_have_long_spans(spark):
    url = "h t t p s colon slash slash w w w dot " + " ".join("voxscribeexample") + " dot " + " ".join("org") + " slash a b c"
    long = ["then " * 40 + url, "then " * 40 + " ".join(["one two three four"] * 9)]
    assert all(len(decode.tokens(t)) > 64 for t in long)
    got = [candidates.normalize_text(t)["text"] for t in long]
    assert got == ["then " * 40 + "https://www.voxscribeexample.org/abc", "then " * 40 + "1234" * 9]
    df = spark.createDataFrame(list(enumerate(long)), "id int, text string")
    spans = {(r["id"], r["token_start"], r["token_end"]) for r in candidates.spans(df, "id").collect()}
    assert (0, 40, 40 + len(url.split())) in spans and (1, 40, 76) in spans


def test_normalized_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r["id"]: r for r in candidates.normalize(df).collect()}
    assert len(got) == len(TEXTS) and got[3]["result"] is None
    assert got[0]["result"]["text"] == "the room code is 105" and got[5]["result"]["text"] == "  "
    for r in got.values():
        for s in (r["result"] or {"spans": []})["spans"]:
            assert r["text"][s["source_start"] : s["source_end"]] == s["source_text"] and r["result"]["text"][s["start"] : s["end"]] == s["text"]


def test_filter_reaches_the_scan(spark):
    df = registry._table(spark, SF, "orders").where("o_orderkey > 100").select("o_orderkey", columns.realize("CARDINAL", F.lit("two")).alias("x")).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan and "Python" not in plan


def test_kind_names_and_sql_functions(spark):
    assert spark.range(1).select(columns.kind_names(F.lit(35)).alias("k")).first()["k"] == ["DIGIT_SEQUENCE", "CARDINAL", "DECIMAL"]
    columns.register(spark)
    r = spark.sql("SELECT realize_time('quarter to one') AS t, equivalent_money('$5', 'USD 5') AS m, realize_word(NULL) AS n").first()
    assert (r["t"], r["m"], r["n"]) == ("12:45", True, None)


def test_native_best_path_agrees(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [(a, rng.randint(a + 1, 8), rng.randint(-5, 9)) for a in (rng.randrange(8) for _ in range(rng.randint(0, 6)))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, edges array<struct<start:int,end:int,score:bigint>>")
    got = {r["id"]: r["s"] for r in df.select("id", operators.best_score(8, F.col("edges")).alias("s")).collect()}
    assert got == {i: decode.best_path(8, [e[:2] for e in es], [float(e[2]) for e in es])[1] for i, es in rows}


ROWS = [
    {"id": "1", "text": "at four thirty", "expected_text": "at 04:30", "group": "normal", "domain": "a", "difficulty": "easy", "categories": ["TIME"], "collision": "x", "collision_pair_id": "p", "spans": [{"start": 3, "category": "TIME", "replacement": "04:30", "span_kind": "TIME"}]},
    {"id": "2", "text": "pay five dollars to joe", "expected_text": "pay $5 to joe", "group": "normal", "domain": "b", "difficulty": "hard", "categories": ["MONEY"], "collision": "x", "collision_pair_id": "p", "spans": [{"start": 4, "category": "MONEY", "replacement": "$5", "span_kind": "MONEY"}]},
    {"id": "3", "text": "say one thing", "expected_text": "say one thing", "group": "negative", "domain": "a", "difficulty": "easy", "categories": ["KEEP"], "collision": None, "collision_pair_id": None, "spans": []},
    {"id": "4", "text": "five and six", "expected_text": "5 and 6", "group": "multi", "domain": "b", "difficulty": "easy", "categories": ["CARDINAL"], "collision": None, "collision_pair_id": None, "spans": [{"start": 0, "category": "CARDINAL", "replacement": "5", "span_kind": "CARDINAL"}, {"start": 9, "category": "CARDINAL", "replacement": "6", "span_kind": "CARDINAL"}]},
]
PREDICTED = {"1": "at 4:30", "2": "pay five dollars to joe", "3": "say 1 thing", "4": "5 and 7"}


def test_evaluation(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    rows = sources.read_evaluation(spark, str(path), rows=4)
    records = spark.createDataFrame(list(PREDICTED.items()), "id string, prediction string")
    out = evaluate.scored(sources.paired(rows, records))
    got = {r["id"]: (r["kind"], r["strict_exact"], r["entities_correct"], r["entity_correct"], r["error_type"]) for r in out.collect()}
    assert got == {"1": ("TIME", False, 1, True, None), "2": ("MONEY", False, 0, False, "missed_edit"), "3": ("KEEP", False, 0, False, "false_normalization"), "4": ("MULTI", False, 1, False, "wrong_rewrite")}
    sliced = {(r["slice"], r["value"]): r for r in evaluate.sliced(out).collect()}
    assert sliced["overall", None]["rows"] == 4 and sliced["overall", None]["entities_correct"] == 2 and sliced["overall", None]["entity_accuracy"] == 0.5
    assert sliced["category", "CARDINAL"]["rows"] == 2 and sliced["domain", "a"]["rows"] == 2
    pairs = evaluate.collision_pairs(out).collect()
    assert [(r["collision"], r["pairs"], r["strict"], r["semantic"]) for r in pairs] == [("x", 1, 0.0, 0.0)]
    assert evaluate.report(evaluate.sliced(out)).count("\n") == len(sliced) + 2
    sources.write_records(out.select("id", "prediction"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_bad_evaluation_rows_raise(spark, tmp_path):
    for name, lines in (("twice", [ROWS[0], ROWS[0]]), ("lacking", [{**ROWS[0], "domain": None}])):
        path = tmp_path / name
        path.write_text("".join(json.dumps(r) + "\n" for r in lines))
        with pytest.raises(ValueError):
            sources.read_evaluation(spark, str(path))
    with pytest.raises(ValueError):
        sources.paired(spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("2", "x")], "id string, prediction string"))


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("room one oh five\nno change\n")
    q = streaming.normalize_stream(streaming.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("written").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["text"]: r["normalized"] for r in spark.table("written").collect()} == {"room one oh five": "room 105", "no change": "no change"}


def test_command_line(capsys, monkeypatch):
    assert cli.main(["meet at four thirty"]) == 0
    assert capsys.readouterr().out == "meet at 04:30\n"
    monkeypatch.setattr("sys.stdin", iter(["one oh five dollars\n", "x\n"]))
    monkeypatch.setattr("sys.stdin", type("Lines", (), {"isatty": lambda s: False, "__iter__": lambda s: iter(["room one oh five\n", "x\n"])})())
    assert cli.main([]) == 0
    assert capsys.readouterr().out == "room 105\nx\n"
    assert cli.main(["--reference", "2026-09-19", "--resolved", "see you tomorrow"]) == 0
    assert capsys.readouterr().out == "see you 2026-09-20\n"


def test_entry_without_the_corpus_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/voxscribe", tmp_path / "voxscribe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.split()[2] == "False" and int(out.stdout.split()[0]) >= 25


def test_cardinals_of_any_long_are_spelled(spark):
    numbers = [0, 7, 999, 10**12, 9_000_027_000_000, 10**15 + 1, 2**53 + 1, 2**63 - 1, -(2**63), -40, None]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    rows = df.select("n", spell.cardinal(F.col("n")).alias("spoken"), columns.realize("CARDINAL", spell.cardinal(F.col("n"))).alias("written")).collect()
    assert [r["written"] for r in rows] == [None if n is None else str(n) for n in numbers]
    assert rows[3]["spoken"] == "one trillion" and rows[-1]["spoken"] is None
