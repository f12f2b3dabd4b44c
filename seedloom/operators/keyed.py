"""Choices that depend on a key and a seed only: equal on every run, partitioning and engine."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.session import cut


def key_hash(seed: int, *parts: Column | int | str) -> Column:
    """Hex md5 of the parts joined by colons; null parts are left out."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def permute(options: Column, seed: int, *parts: Column | int | str) -> Column:
    """The options in an order drawn by key; a narrow expression without an exchange."""
    keyed = F.transform(options, lambda x, i: F.struct(key_hash(seed, *parts, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def draw(options: Column, n: int, seed: int, *parts: Column | int | str) -> Column:
    """n of the options without replacement."""
    return F.slice(permute(options, seed, *parts), 1, n)


def content_hash(*content: Column) -> Column:
    """The md5 of all that a row says; nulls count as values."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in content]))


def one_per_id(rows: DataFrame, id_col: str, version: Column | None, said: Column, values: dict[str, Column]) -> DataFrame:
    """One row per id with ``values``: of rows that share an id the earliest version counts (null first), then the smallest ``said``, their ``content_hash``.

    The one rule for repeated ids.  Nulls in the content count as values, so nothing may be filtered by content before;
    ``values`` may be derived from it.  Rows without an id must be gone.  Rows are aggregated before they move.
    """
    version = F.lit(None).cast("timestamp") if version is None else version
    best = F.min(F.struct(version.alias("_v"), said.alias("_c"), *[c.alias(n) for n, c in values.items()])).alias("_x")
    return rows.groupBy(id_col).agg(best).select(id_col, *[F.col(f"_x.`{n}`").alias(n) for n in values])


def exact_holdout(df: DataFrame, key: list[str], fraction: float, seed: int = 0, group: list[str] | None = None) -> DataFrame:
    """Adds ``split``: test for ceil(fraction * rows) rows, train for all others.

    Rows are ranked by the hash of their key.  There is no sort of all rows: the hashes are written once, and counts by four
    more hex digits (at most 65,536 counts at a time) lead to the digits at which the test rows end; the hash
    of the last test row is then found among the few rows that share those, and one scan compares each row with it.
    Rows with equal keys stay together, so the size is exact for keys without repetition; with ``group`` whole groups stay together.
    """
    hashed = df.withColumn("_h", key_hash(seed, *[F.col(c) for c in (group or key)]))
    keys = cut(hashed.select("_h"), "holdout")
    prefix, left, inside = "", -1, 0
    while len(prefix) < 32:
        among = keys.where(F.col("_h").startswith(prefix)) if prefix else keys
        counts = sorted((r["p"], r["n"]) for r in among.groupBy(F.substring("_h", len(prefix) + 1, 4).alias("p")).agg(F.count("*").alias("n")).collect())
        if not prefix:
            left = math.ceil(round(fraction * sum(n for _, n in counts), 9))
            if left <= 0:
                return df.withColumn("split", F.lit("train"))
        for p, inside in counts:
            if left <= inside:
                prefix += p
                break
            left -= inside
        if left == inside or inside <= 1000:
            break
    if left < inside and len(prefix) < 32:
        prefix = keys.where(F.col("_h").startswith(prefix)).orderBy("_h").limit(left).agg(F.max("_h")).first()[0]
    return hashed.withColumn("split", F.when(F.substring("_h", 1, len(prefix)) <= prefix, "test").otherwise("train")).drop("_h")


def numbered(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """A gap-free row number from 0 in the given order, without one task that sees all rows.

    Rows are range-partitioned, counted by partition and numbered inside each;
    the offsets are one number per partition.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    spread = cut(spread, "numbered")
    counts = {r["_part"]: r["n"] for r in spread.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    start, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, start))
        start += counts[part]
    offset = reduce(lambda acc, x: F.when(F.col("_part") == x[0], F.lit(x[1]).cast("long")).otherwise(acc), offsets, F.lit(0).cast("long")) if len(offsets) < 64 else F.element_at(F.create_map(*[F.lit(v) for pair in offsets for v in pair]), F.col("_part")).cast("long")
    inside = Window.partitionBy("_part").orderBy(*order)
    return spread.withColumn(name, offset + F.row_number().over(inside) - 1).drop("_part")
