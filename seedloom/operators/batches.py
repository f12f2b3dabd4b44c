"""Heads, batches and seed-writing prompts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.sources.seeds import fragments


def batched_head(df: DataFrame, order: list[str], rows: int, size: int) -> DataFrame:
    """The first rows in order, with ``batch`` from 0: full batches, then what is left."""
    head = df.orderBy(*order).limit(rows)
    return head.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


# The sections of a seed-writing prompt, in which {website}, {examples} and {wanted} are filled in.
TEMPLATE = """### Context ###
All the generations should be based on the idea of summarizing basic information about the following web page:
{website}
### Example ###
[
{examples}
]
### Objective ###
Generate {wanted} question and answering pair as the previous example question and answer pair to summarize and answer question regarding previous webpage.
### Output ###
Output should be a json with the following fields:
Input: Question generated
Output: Answer generated
Explanation: Reason why this answer is generated for the question"""


def seed_prompts(seeds: DataFrame, sites: DataFrame, examples: int = 2, wanted: int = 10, template: str = TEMPLATE) -> DataFrame:
    """``(file, prompt)``: a request for new seeds about each site, shown the first seeds of its file as JSON objects.

    Files without a seed show none; ``sites`` has one row per file.  Each place of the template is filled in once.
    """
    order = Window.partitionBy("file").orderBy("seed_ord")
    first = seeds.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= examples)
    shown = F.to_json(F.struct(F.col("input").alias("Input"), F.col("output").alias("Output"), F.coalesce("explanation", F.lit("undefined")).alias("Explanation")))
    lists = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", shown.alias("t")))), lambda x: x["t"]), ",\n").alias("shown"))
    given = {"{website}": F.col("website"), "{examples}": F.coalesce("shown", F.lit("")), "{wanted}": F.lit(str(wanted))}
    parts = [given.get(p, F.lit(p)) for p in re.split(r"(\{website\}|\{examples\}|\{wanted\})", template) if p]
    return sites.join(lists, "file", "left").select("file", F.concat(*parts).alias("prompt"))


def written_seeds(answers: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Seeds read back from answers to such prompts: the kept columns, seed_ord, input, output, explanation.

    An answer may hold its objects in a list or one after the other; one that does not read has no seed.
    """
    rows = answers.select(*keep, F.posexplode(fragments(F.col(text_col))).alias("seed_ord", "e"))
    return rows.where("e is not null").select(*keep, "seed_ord", F.col("e.Input").alias("input"), F.col("e.Output").alias("output"), F.col("e.Explanation").alias("explanation"))
