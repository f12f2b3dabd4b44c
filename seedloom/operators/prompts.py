"""Training prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.schemas import MULTIPLE_CHOICE, UNDEFINED

# The wording of both templates.
_POSITIVE = ("\nThe answer to the question is:\n", "\nThe reason for the answer is: ")
_NEGATIVE = ("\nThe answer to the question is definitely not the following:\n", "\nThe reason for it's not the answer is: ")


def prompt(polarity: Column) -> Column:
    """The text of an example; a missing explanation reads ``undefined``."""
    why = F.coalesce("explanation", F.lit(UNDEFINED))
    forms = [F.concat("input", F.lit(a), "output", F.lit(b), why) for a, b in (_POSITIVE, _NEGATIVE)]
    return F.when(polarity == "positive", forms[0]).otherwise(forms[1])


def corpus(examples: DataFrame) -> DataFrame:
    """Examples with their prompt and its place in the corpus: by file, task, polarity, then their own order.

    Rows without an input or an output have no prompt.
    """
    place = {
        "task_ord": F.when(F.col("task_kind") == MULTIPLE_CHOICE, 0).otherwise(1),
        "polarity_ord": F.when(F.col("polarity") == "positive", 0).otherwise(1),
        "prompt": prompt(F.col("polarity")),
    }
    return examples.where("input is not null and output is not null").withColumns(place)
