"""Writing generated examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_examples(examples: DataFrame, path: str, format: str = "parquet") -> None:
    """Long form, a folder per file; overwrites."""
    examples.write.mode("overwrite").partitionBy("file").format(format).save(path)


def nested_documents(examples: DataFrame, per_document: int = 1000) -> DataFrame:
    """Tasks of instruction files: file, part, task_kind, positive and negative example lists in order of their ids.

    A part holds the examples of ``per_document`` consecutive ids of a file and task, so its size
    is bounded; ``document`` is its JSON form with the keys of an instruction file.
    """
    part = F.floor(F.col("example_id") / per_document).cast("long")
    item = F.struct(F.col("example_id").alias("i"), F.struct(F.col("input").alias("Input"), F.col("output").alias("Output"), F.col("explanation").alias("Explanation")).alias("e"))
    lists = {p: F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, item))), lambda x: x["e"]) for p in ("positive", "negative")}
    docs = examples.groupBy(F.coalesce("file", F.lit("")).alias("file"), part.alias("part"), "task_kind").agg(lists["positive"].alias("positives"), lists["negative"].alias("negatives"))
    body = F.struct(F.struct(F.col("task_kind").alias("Categories")).alias("Instruction information"), F.col("positives").alias("Positive Example"), F.col("negatives").alias("Negative Example"))
    return docs.withColumn("document", F.to_json(body))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document a line, a folder per file; overwrites."""
    documents.select("file", F.col("document").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def file_documents(examples: DataFrame, definitions: DataFrame, per_document: int = 1000) -> DataFrame:
    """``(file, part, document)``: instruction files as JSON, an array with one task a kind, each with its category, definition and lists.

    ``definitions``: file, task_kind, definition, one row each; a task without one has an empty text.  Tasks stand in order of their kind.
    """
    tasks = nested_documents(examples, per_document).join(definitions.select(F.coalesce("file", F.lit("")).alias("file"), "task_kind", "definition"), ["file", "task_kind"], "left")
    task = F.struct(F.struct(F.col("task_kind").alias("Categories")).alias("Instruction information"), F.coalesce("definition", F.lit("")).alias("Definition"), F.col("positives").alias("Positive Example"), F.col("negatives").alias("Negative Example"))
    both = F.transform(F.array_sort(F.collect_list(F.struct(F.col("task_kind").alias("k"), task.alias("t")))), lambda x: x["t"])
    return tasks.groupBy("file", "part").agg(F.to_json(both, {"ignoreNullFields": "false", "pretty": "true"}).alias("document"))


def write_instruction_files(documents: DataFrame, path: str) -> None:
    """One pretty-printed JSON document a file, in a folder per ``file`` and ``part``; overwrites.

    For exchange with tools that read whole files; ``write_examples`` is the form for large corpora.
    """
    documents.select("file", "part", F.col("document").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("file", "part").text(path)
