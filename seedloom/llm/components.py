"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import join_counted
from seedloom.session import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """``(u, root)`` for every linked node but the roots; a root is the smallest node of its component.

    ``links`` has whole-number columns ``a`` and ``b``; loops and repeated links
    do no harm.  Every round is written to the shared folder; a node with many
    links is joined as ``join_counted`` does.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both, low, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, "u", "n", 2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select("u", F.col("v").alias("root"))
