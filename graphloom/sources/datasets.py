"""Question sets: JSON arrays in, one schema out; run records back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_SETS = {"math500": "MATH500", "gpqa": "GPQA", "aime": "AIME", "amc": "AMC", "livecode": "LiveCodeBench"}
SCHEMA = "Question string, Answer string, `Correct Choice` string, A string, B string, C string, D string, Level string, Subject string, Type string"


def dataset_path(root: str, name: str, split: str = "test") -> str:
    return f"{root}/{SPLIT_SETS[name]}/{split}.json" if name in SPLIT_SETS else f"{root}/QA_Datasets/{name}.json"


def read_questions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """q_id, question, answer, choices and the other fields of a JSON array; `most` takes the first so many."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    # One file is one record of the reader, so positions within it are its order.
    rows = rows.select(
        F.monotonically_increasing_id().alias("q_id"),
        F.col("Question").alias("question"),
        F.coalesce("Answer", "Correct Choice").alias("answer"),
        F.array_compact(F.array("A", "B", "C", "D")).alias("choices"),
        F.col("Level").alias("level"), F.col("Subject").alias("subject"), F.col("Type").alias("type"),
    )
    return rows if most is None else rows.orderBy("q_id").limit(most)


def nested_answers(raw: DataFrame) -> DataFrame:
    """question, answer of rows whose answer is a struct with a value."""
    return raw.select("question", F.col("answer.value").alias("answer"))


def write_records(rows: DataFrame, path: str) -> None:
    """rows(prompt, raw_output, extracted_info, kg_enhanced) as lines of JSON."""
    rows.select("prompt", "raw_output", "extracted_info", "kg_enhanced").write.mode("overwrite").json(path)
