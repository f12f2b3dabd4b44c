"""Instruction files, fragments, logs and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom import schemas
from seedloom.operators.keyed import content_hash, one_per_id


def read_tasks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per task of pretty-printed instruction files: ``file`` and the task's columns.

    ``file`` is the folder's ``file=`` where there is one (``sinks.write_instruction_files``), else the name without ``.json``.
    """
    rows = spark.read.schema(schemas.INSTRUCTION_TASK).option("multiLine", True).json(paths)
    if "file" in rows.columns:
        return rows.withColumn("file", F.coalesce(F.col("file").cast("string"), F.lit("")))
    return rows.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"(_generated)?\.json$", ""))


def task_seeds(tasks: DataFrame, polarity: str = "Positive Example") -> DataFrame:
    """Examples of tasks: file, task_kind, seed_ord (place in its list), input, output, explanation."""
    kind = F.col("`Instruction information`.Categories").alias("task_kind")
    rows = tasks.select("file", kind, F.posexplode(f"`{polarity}`").alias("seed_ord", "e"))
    return rows.where("e is not null").select("file", "task_kind", "seed_ord", F.col("e.Input").alias("input"), F.col("e.Output").alias("output"), F.col("e.Explanation").alias("explanation"))


def example_seeds(examples: DataFrame, task_kind: str) -> DataFrame:
    """Positive rows of an examples table as seeds, one per example_id (the earliest), which is their seed_ord."""
    rows = examples.where((F.col("polarity") == "positive") & (F.col("task_kind") == task_kind) & F.col("example_id").isNotNull())
    columns = {c: F.col(c) for c in ("file", "input", "output", "explanation")}
    one = one_per_id(rows, "example_id", F.col("loaded_at"), content_hash(*columns.values()), columns)
    return one.select(F.coalesce("file", F.lit("")).alias("file"), F.lit(task_kind).alias("task_kind"), F.col("example_id").alias("seed_ord"), "input", "output", "explanation")


def fragments(text: Column) -> Column:
    """Example objects of a text that holds them one after the other, with or without a last comma or brackets; null if they do not read."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*\[", ""), r"(,\s*)?(\]\s*)?$", "")
    return F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<struct<Input:string,Output:string,Explanation:string>>")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Rows of input, output, explanation, with their place, from a file of fragments."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(fragments(F.col("value"))).alias("seed_ord", "e")).select("seed_ord", F.col("e.Input").alias("input"), F.col("e.Output").alias("output"), F.col("e.Explanation").alias("explanation"))


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """The log of a training run as ``log_history``."""
    return spark.read.schema(schemas.TRAINER_STATE).option("multiLine", True).json(path)


def write_config(configs: DataFrame, path: str) -> None:
    """Configurations (``config``, a map) as one JSON object a line; overwrites."""
    configs.select(F.to_json("config").alias("value")).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Saved configurations, one row a file, with their keys and values as text; values that are no text keep their JSON form."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", "map<string,string>").alias("config"))
