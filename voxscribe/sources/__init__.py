"""Sources and sinks: transcripts as lines or JSON, evaluation rows, prediction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION = "id string, text string, expected_text string, `group` string, domain string, difficulty string, categories array<string>, collision string, collision_pair_id string, spans array<struct<start:int,category:string,replacement:string,span_kind:string>>"
REQUIRED = ("id", "text", "expected_text", "group", "domain", "difficulty", "spans")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts, one a line, as `text`."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_evaluation(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Evaluation rows from JSON lines with a fixed schema; malformed lines, missing fields, repeated ids or another number of rows raise."""
    df = spark.read.schema(EVALUATION).option("mode", "FAILFAST").json(path)
    lacking = sum((F.col(c).isNull().cast("int") for c in REQUIRED), F.lit(0))
    facts = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum(lacking).alias("lacking")).first()
    if facts["lacking"]:
        raise ValueError(f"{facts['lacking']} required fields are missing")
    if facts["n"] != facts["ids"]:
        raise ValueError("ids repeat")
    if rows is not None and facts["n"] != rows:
        raise ValueError(f"{facts['n']} rows, not {rows}")
    return df


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prediction records as JSON lines; written whole or not at all."""
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def paired(rows: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Evaluation rows with their prediction records, one to one; raises if either side lacks a row."""
    facts = rows.select(key).join(records.select(key).withColumn("_r", F.lit(1)), key, "full").agg(F.count("*").alias("n"), F.count("_r").alias("r")).first()
    if not facts["n"] == facts["r"] == rows.count():
        raise ValueError("rows and records don't match one to one")
    return rows.join(records, key)


def frozen(spark: SparkSession, files: dict[str, str]) -> dict[str, str]:
    """files: path → SHA-256. The digests of the files as they are, read by Spark; raises if one is missing or differs, so nothing is measured on other data."""
    found = {}
    for path, want in files.items():
        rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest")).take(2)
        if len(rows) != 1:
            raise ValueError(f"{path} is not one file")
        found[path] = rows[0]["digest"]
        if found[path] != want.lower():
            raise ValueError(f"{path} has the SHA-256 {found[path]}, not {want}")
    return found
