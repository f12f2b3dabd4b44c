"""Questions packed with their fact as ``Fact: ... Question: ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.functions.text import nth, pieces, strip


def parse(df: DataFrame) -> DataFrame:
    """Adds head, fact, question and reason to rows with ``input`` and ``output``.

    Head is what stands before the first ``Question:`` with its blanks, question what stands
    between it and the next; the fact is the stripped head without its first six characters.
    """
    parts = pieces("input", "Question:")
    question = nth(parts, 1)
    reason = F.when(F.col("input").isNull(), "no input").when(F.col("output").isNull(), "no output").when(question.isNull(), "no Question:")
    return df.withColumns({"head": nth(parts, 0), "question": question, "fact": F.substring(strip(nth(parts, 0)), 7, 2**31 - 1), "reason": reason})
