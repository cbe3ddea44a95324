"""The pipeline's stages on the smallest tables against what each stage's operator says of its own input."""

import corpus_pipeline
import duckdb
import pytest

from voxscribe.llm import near_copies, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at, texts = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at[name] = texts.cache()
        texts = stage(spark, texts, SF)
        if name != "packing":
            assert texts.columns == docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    clean = toxicity.classify(docs, labels).where("not rejected")
    assert ids(at["quality"]) == ids(clean)
    good = quality.classify(at["quality"], labels).where("predicted = 1")
    assert ids(at["near-duplicates"]) == ids(good)
    before = sorted((r["doc_id"], r["text"]) for r in at["near-duplicates"].collect())
    sets = [near_copies.shingles(t, 5) for _, t in before]
    like = lambda i, j: near_copies.jaccard(sets[i], sets[j]) >= 0.8
    root = list(range(len(before)))
    for i in range(len(before)):  # every pair
        for j in range(i):
            if like(i, j) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert ids(at["mixing"]) == sorted({before[r][0] for r in root})
    tokens = sum(len(packing.token_ids(r["text"], queries.vocabulary_files()["tokenizer"])) + 1 for r in at["packing"].collect())
    pieces = texts.collect()
    assert sum(r["length"] for r in pieces) == tokens
    assert max(r["offset"] + r["length"] for r in pieces) <= 2048


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_odd_columns_and_ids_pass_all_stages(spark):
    """Columns with dots and clashing names, null and repeated ids: no stage crashes or loses a text that has no copy."""
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six"), (5, "red green blue white black grey"), (5, "salt pepper sugar flour yeast water"), (3, "red green blue white black grey")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row int, id int, voxscribe_row int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near-duplicates":
            assert sorted(r["text"] for r in out.collect()) == sorted({t for _, t in rows})
        else:
            out.collect()
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_rerun_of_whole_pipeline_agrees(spark):
    digest = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, SF)) == digest(corpus_pipeline.run(spark, SF))
