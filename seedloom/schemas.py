"""Explicit schemas; none is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

EXAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("Input", "Output", "Explanation")])

#: A task of an instruction file; empty example lists must not be inferred as text.
INSTRUCTION_TASK = T.StructType(
    [
        T.StructField("Instruction information", T.StructType([T.StructField("Categories", T.StringType())])),
        T.StructField("Definition", T.StringType()),
        T.StructField("Positive Example", T.ArrayType(EXAMPLE)),
        T.StructField("Negative Example", T.ArrayType(EXAMPLE)),
    ]
)

LOG_ENTRY = T.StructType([T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType())])
TRAINER_STATE = T.StructType([T.StructField("log_history", T.ArrayType(LOG_ENTRY))])
CRAWL_ITEM = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

MULTIPLE_CHOICE = "Multiple Selection"
QUESTION_ANSWER = "Question answering"
LETTERS = ("A", "B", "C", "D")
UNDEFINED = "undefined"

#: Columns that place a generated example: where it comes from and in which branch.
LINEAGE = ("file", "task_kind", "polarity", "branch", "seed_ord", "variant", "shuffle", "neg_slot")
