"""Shared steps: words, one row per id, joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.session import input_splits

#: A group counts as hot above this many rows, or above the share of all rows below.
HOT_ROWS = 50_000


def words(text: Column | str) -> Column:
    """The words of a text, lower case, joined by single blanks; '' where it has none, null for null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def positive_rows(examples: DataFrame) -> DataFrame:
    return examples.where("polarity = 'positive' and example_id is not null")


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, safe for keys that hold a large share of ``rows``.

    ``keyed[n_col]`` is the number of rows of a key.  Keys above the limit are
    hot: there are at most ``total / limit`` of them, no more than four times
    the shuffle partitions, so that part is broadcast; all others are joined by a shuffle.
    """
    limit = max(HOT_ROWS, total // (4 * input_splits(rows.sparkSession)))
    if total <= limit:
        return rows.join(keyed.drop(n_col), key)
    hot = keyed.where(F.col(n_col) > limit).drop(n_col)
    cold = keyed.where(F.col(n_col) <= limit).drop(n_col)
    out = hot.columns
    named = hot.withColumnsRenamed({c: f"_hot_{c}" for c in out})
    marked = rows.join(F.broadcast(named), rows[key] == named[f"_hot_{key}"], "left")
    of_hot = marked.where(f"_hot_{key} is not null").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in out if c != key])
    of_cold = marked.where(f"_hot_{key} is null").select(*rows.columns).join(cold, key)
    return of_hot.select(key, *[c for c in of_hot.columns if c != key]).unionByName(of_cold)
