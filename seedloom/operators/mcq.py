"""Multiple-choice questions packed as ``question (A)x (B)y (C)z (D)w``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.text import letter, letter_index, nth, pieces, relabel, strip
from seedloom.operators.keyed import draw, permute
from seedloom.schemas import LETTERS


def parse(df: DataFrame) -> DataFrame:
    """Adds head, options, answer_idx, labels_ok and reason to rows with ``input`` and ``output``.

    ``reason`` is null for a valid row: the head is what stands before the first ``(A)``, the tail what stands before
    the next one; the tail is cut at `` (`` and four parts count, further ones are dropped.
    Labels are not checked; ``labels_ok`` tells whether they read B, C, D.
    """
    parts = pieces("input", "(A)")
    tail = nth(parts, 1)
    cuts = pieces(tail, " (")
    rest = [strip(F.substring(nth(cuts, k), 3, 2**31 - 1)) for k in (1, 2, 3)]
    enough = F.size(cuts) >= 4
    labels = F.concat(*[F.substring(nth(cuts, k), 1, 2) for k in (1, 2, 3)]) == "B)C)D)"
    reason = (
        F.when(F.col("input").isNull(), "no input")
        .when(F.col("output").isNull(), "no output")
        .when(tail.isNull(), "no (A)")
        .when(~enough, "fewer than four options")
        .when(letter_index(F.col("output")).isNull(), "answer outside A-D")
    )
    return df.withColumns(
        {
            "head": nth(parts, 0),
            "tail": tail,
            "options": F.when(enough, F.array(strip(nth(cuts, 0)), *rest)),
            "answer_idx": letter_index(F.col("output")),
            "labels_ok": F.when(enough, labels),
            "reason": reason,
        }
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null")


def must_parse(parsed: DataFrame) -> DataFrame:
    """Valid rows; the first reject fails the job, as a strict run wants."""
    checked = parsed.withColumn("_ok", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("not parsed: "), "reason"))).otherwise(F.lit(True)))
    return checked.where("_ok").drop("reason", "_ok")


def shuffled(df: DataFrame, seed: int, *key: Column | int | str) -> DataFrame:
    """Options drawn into a new order by key, relabelled; ``output`` follows the text of the answer.

    Needs head, options and answer_idx. Equal option texts resolve to the first.
    """
    answer = F.element_at("options", F.col("answer_idx") + 1)
    moved = df.withColumns({"_answer": answer, "options": permute(F.col("options"), seed, *key)})
    at = F.array_position("options", F.col("_answer")) - 1
    return moved.withColumns({"input": F.concat("head", relabel(F.col("options"))), "output": letter(at), "answer_idx": at.cast("int")}).drop("_answer")


def wrong_letters(output: Column, seed: int, *key: Column | int | str) -> Column:
    """Two different letters of A to D that are not the output; any two if the output is none of them."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return draw(F.array_except(letters, F.array(output)), 2, seed, *key)
