"""Scores of generated text."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.functions.text import python_tokens

_SCORES = "rouge1 double, rouge2 double, rougeL double, rougeLsum double"


def _lcs_rows(a: list[str], b: list[str]) -> list[int]:
    """For each beginning of ``b`` the places of ``a`` at which its longest common subsequence with it grows, as bits."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    rows = [0]
    for y in b:
        both = rows[-1] | where.get(y, 0)
        rows.append(both & ~(both - (rows[-1] << 1 | 1)))
    return rows


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return _lcs_rows(a, b)[-1].bit_count()


def _lcs_positions(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``: from the ends, equal tokens first, then the side that loses nothing."""
    rows = _lcs_rows(a, b)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif rows[j] >> (i - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def _f(hit: int, predicted: int, wanted: int) -> float:
    return 2 * hit / (predicted + wanted) if hit else 0.0


def rouge_n(prediction: list[str], reference: list[str], n: int) -> float:
    got, want = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (prediction, reference))
    return _f(sum((got & want).values()), got.total(), want.total())


def rouge_l_sum(prediction: str | None, reference: str | None) -> float:
    """By lines: the union of each reference line's common subsequences with all predicted lines."""
    got, want = ([python_tokens(x) for x in (t or "").split("\n") if x] for t in (prediction, reference))
    predicted, wanted = sum(map(len, got)), sum(map(len, want))
    if not predicted or not wanted:
        return 0.0
    left_got, left_want, hits = Counter(t for x in got for t in x), Counter(t for x in want for t in x), 0
    for line in want:
        union: set[int] = set()
        for other in got:
            union |= _lcs_positions(line, other)
        for i in sorted(union):
            t = line[i]
            if left_got[t] > 0 and left_want[t] > 0:
                hits += 1
                left_got[t] -= 1
                left_want[t] -= 1
    return _f(hits, predicted, wanted)


def rouge(df: DataFrame, id_col: str, prediction: str, reference: str) -> DataFrame:
    """F-measures per pair: rouge1, rouge2, rougeL, rougeLsum.  A null text is an empty one and scores 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, r in zip(batch["p"], batch["r"], strict=True):
                a, b = python_tokens(p), python_tokens(r)
                rows.append((rouge_n(a, b, 1), rouge_n(a, b, 2), _f(lcs_length(a, b), len(a), len(b)), rouge_l_sum(p, r)))
            scores = pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL", "rougeLsum"])
            yield pd.concat([batch[["id"]].reset_index(drop=True), scores], axis=1)

    rows = df.select(F.col(id_col).alias("id"), F.col(prediction).alias("p"), F.col(reference).alias("r"))
    return rows.mapInPandas(score, f"id {kind}, {_SCORES}").withColumnRenamed("id", id_col)


def bleu(df: DataFrame, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """One row: corpus ``bleu`` of n-grams up to ``order`` with its brevity penalty, and the ``pairs`` counted.

    Null texts are empty ones.  0 where an order has no match, null for an empty table.
    """
    names = [f"{kind}{n}" for n in range(1, order + 1) for kind in ("hit", "all")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, r in zip(batch["p"], batch["r"], strict=True):
                a, b = python_tokens(p), python_tokens(r)
                row = [len(a), len(b)]
                for n in range(1, order + 1):
                    got, want = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
                    row += [(got & want).total(), got.total()]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["given", "wanted", *names])

    counts = df.select(F.col(prediction).alias("p"), F.col(reference).alias("r")).mapInPandas(count, ", ".join(f"{c} long" for c in ("given", "wanted", *names)))
    total = counts.agg(*[F.sum(c).alias(c) for c in ("given", "wanted", *names)], F.count("*").alias("pairs"))
    logs = [F.log(F.col(f"hit{n}") / F.col(f"all{n}")) for n in range(1, order + 1)]
    none = F.least(*[F.col(f"hit{n}") for n in range(1, order + 1)]) == 0 if order > 1 else F.col("hit1") == 0
    penalty = F.least(F.lit(0.0), 1 - F.col("wanted") / F.col("given"))
    score = F.when(F.col("pairs") == 0, None).when(none, 0.0).otherwise(F.exp(penalty + sum(logs[1:], logs[0]) / order))
    return total.select(score.alias("bleu"), "pairs")


@lru_cache(1 << 16)
def hashed_embedding(token: str) -> np.ndarray:
    """32 whole numbers from the token's runs of two and three characters; stands in for a model.

    Each run adds or takes away 1 at the place that its md5 names: the first hex digit, plus 16 if the second is 8 or more; it adds if the third is.
    """
    v = np.zeros(32)
    padded = f"^{token}$"
    for k in (2, 3):
        for i in range(len(padded) - k + 1):
            h = [int(x, 16) for x in hashlib.md5(padded[i : i + k].encode()).hexdigest()[:3]]
            v[h[0] + 16 * (h[1] >= 8)] += 1 if h[2] >= 8 else -1
    v.flags.writeable = False
    return v


def embed_tokens(text: str | None) -> np.ndarray:
    """A unit vector for each token; one of length zero stays."""
    v = np.array([hashed_embedding(t) for t in python_tokens(text)])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if len(v) else v


def bertscore(df: DataFrame, id_col: str, prediction: str, reference: str, embed: Callable[[str | None], np.ndarray] = embed_tokens) -> DataFrame:
    """Precision, recall and f1 by greedy cosine matching of token vectors; 0 where a side has no token."""
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, r in zip(batch["p"], batch["r"], strict=True):
                a, b = embed(p), embed(r)
                if not len(a) or not len(b):
                    rows.append((0.0, 0.0, 0.0))
                    continue
                alike = a @ b.T
                precision, recall = float(alike.max(axis=1).mean()), float(alike.max(axis=0).mean())
                rows.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0))
            scores = pd.DataFrame(rows, columns=["precision", "recall", "f1"])
            yield pd.concat([batch[["id"]].reset_index(drop=True), scores], axis=1)

    rows = df.select(F.col(id_col).alias("id"), F.col(prediction).alias("p"), F.col(reference).alias("r"))
    return rows.mapInPandas(score, f"id {kind}, precision double, recall double, f1 double").withColumnRenamed("id", id_col)


def loss_series(logs: DataFrame, *keys: str) -> DataFrame:
    """One row per logged step; entries without a loss have a null one, null entries none."""
    return logs.select(*keys, F.explode("log_history").alias("e")).where("e is not null").select(*keys, "e.step", "e.loss")

