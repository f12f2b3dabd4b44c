"""Text providers: paraphrases, false answers and explanations that a model or a rule writes.

A provider fills one column of a frame.  A rule is a column expression.  A model is called in
Arrow batches: each call becomes a row of a request table, keyed by a hash of everything that tells it from others,
and the answers are written to the shared folder before anything reads them, so a
call is made once whatever the plan does later, and a retry asks for the same keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.operators.keyed import key_hash
from seedloom.session import cut

#: What a provider can be asked for.
OPS = ("paraphrase", "paraphrase_sentence", "paraphrase_explanation", "false_output")


class Provider(Protocol):
    def fill(self, df: DataFrame, name: str, op: str, draw: Column, *args: Column, key: tuple[str, ...] = ()) -> DataFrame: ...


class RuleProvider:
    """Marks its text with the operation and the number of the draw; stands in for a model in tests and SQL."""

    def fill(self, df: DataFrame, name: str, op: str, draw: Column, *args: Column, key: tuple[str, ...] = ()) -> DataFrame:
        return df.withColumn(name, stub(op, draw, args[-1]))


# The marks of the rule's answers.
_MARKS = {"paraphrase": "p", "paraphrase_sentence": "s", "paraphrase_explanation": "x", "false_output": "not "}


def stub(op: str, draw: Column, text: Column) -> Column:
    return F.concat(F.lit(_MARKS[op]), draw.cast("string"), F.lit(": "), text)


def stub_batch(requests: pd.DataFrame) -> list[str | None]:
    """The rule as a batch function."""
    return [None if t is None else f"{_MARKS[o]}{d}: {t}" for o, d, t in zip(requests["op"], requests["draw"], requests["text"], strict=True)]


class BatchProvider:
    """Calls ``make()`` once per task and its result once per batch: a frame of op, draw, site, record, text to a list of texts.

    ``record`` is the whole record as JSON for operations that need it, else null; ``site`` is the address that the
    row's file is about: its ``website`` column, null for rows without one.
    """

    def __init__(self, make: Callable[[], Callable[[pd.DataFrame], list[str | None]]], seed: int = 0) -> None:
        self.make, self.seed = make, seed

    def asked(self, df: DataFrame, op: str, draw: Column, *args: Column, key: tuple[str, ...] = ()) -> DataFrame:
        """The rows with what they ask for, and ``req_id``, the hash of all that tells a request from others."""
        record = F.to_json(args[0], {"ignoreNullFields": "false"}) if len(args) > 1 else F.lit(None).cast("string")
        site = F.col("website") if "website" in df.columns else F.lit(None).cast("string")
        rows = df.withColumns({"_req_draw": draw.cast("int"), "_req_text": args[-1], "_req_record": record, "_req_site": site})
        none = F.lit("\u0002")
        return rows.withColumn("req_id", key_hash(self.seed, F.lit(op), *[F.coalesce(F.col(k).cast("string"), none) for k in key], F.col("_req_draw"), F.coalesce("_req_site", none), F.coalesce("_req_text", none)))

    def requests(self, asked: DataFrame, op: str) -> DataFrame:
        """The request table: req_id, op, draw, site, record, text."""
        names = {"draw": "_req_draw", "site": "_req_site", "record": "_req_record", "text": "_req_text"}
        return asked.select("req_id", F.lit(op).alias("op"), *[F.col(c).alias(n) for n, c in names.items()]).dropDuplicates(["req_id"])

    def fill(self, df: DataFrame, name: str, op: str, draw: Column, *args: Column, key: tuple[str, ...] = ()) -> DataFrame:
        make = self.make

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for batch in batches:
                yield pd.DataFrame({"req_id": batch["req_id"], "response": call(batch)})

        asked = self.asked(df, op, draw, *args, key=key)
        answers = cut(self.requests(asked, op).mapInPandas(answer, "req_id string, response string"), f"answers-{op}")
        return asked.join(answers, "req_id", "left").withColumnRenamed("response", name).drop("req_id", "_req_draw", "_req_text", "_req_record", "_req_site")
