"""Options by their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seedloom.schemas import LETTERS


def top_letters(scores: Column, k: int = 3, letters: Sequence[str] = LETTERS) -> Column:
    """The k best letters, joined by blanks: highest score first, NaN before all, ties by the later letter.

    Null for null scores; missing or null scores come last; scores beyond the letters are left out.
    """
    names = F.array(*[F.lit(x) for x in letters])
    paired = F.transform(names, lambda x, i: F.struct(F.get(scores, i).alias("s"), x.alias("l")))
    best = F.slice(F.sort_array(paired, asc=False), 1, k)
    return F.when(scores.isNotNull(), F.array_join(F.transform(best, lambda p: p["l"]), " "))


def gather(logits: Column, token_ids: Sequence[int]) -> Column:
    """The scores of given token ids out of a full vector, as floats."""
    return F.array(*[F.get(logits, F.lit(i)).cast("float") for i in token_ids])
