"""Examples that arrive as a stream: each one once, as a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seedloom.operators import prompts


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prompt_stream(examples: DataFrame, late: str = "7 days") -> DataFrame:
    """Prompts of streamed examples; an example sent again within ``late`` of its loading time adds nothing."""
    fresh = examples.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["example_id"])
    return prompts.corpus(fresh).select("example_id", "file", "task_kind", "polarity", "prompt", "loaded_at")


def arrivals(examples: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Examples by file, polarity and window of their loading time, final once the watermark has passed."""
    return examples.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window), "file", "polarity").agg(F.count("*").alias("n"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To parquet, exactly once; ends when all that is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
