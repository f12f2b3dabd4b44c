"""Token vectors fitted on texts by random indexing: each token is the sum of the fixed signs of the tokens that stand near it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.text import python_tokens, tokens
from seedloom.session import cut

#: Tokens that get a vector, at most: the most frequent ones.  Bounds what is broadcast.
VOCABULARY = 50_000
SIZE, WINDOW, SIGNS = 64, 3, 4
#: A token that is more than one in so many of all is no neighbour; there can be no more than so many.
COMMON = 100


def _signs(token: Column, size: int) -> Column:
    """Places and signs of a token as a neighbour, three hex digits of its md5 each: two name the place, the third the sign."""
    h = F.md5(token)
    at = lambda k: F.pmod(F.conv(F.substring(h, 3 * k + 1, 2), 16, 10).cast("int"), F.lit(size))
    return F.array(*[F.struct(at(k).alias("dim"), F.when(F.substring(h, 3 * k + 3, 1) >= "8", 1).otherwise(-1).alias("sign")) for k in range(SIGNS)])


def fit_token_vectors(texts: DataFrame, text_col: str, vocabulary: int = VOCABULARY, size: int = SIZE, window: int = WINDOW) -> DataFrame:
    """``(token, n, vector)``: how often a token occurs in all texts, and whole numbers that add up its neighbours' signs.

    Neighbours are up to ``window`` tokens before and after, in a text without its common tokens.  Null and empty texts add nothing; a token
    without neighbours has a vector of zeros.  Ties in frequency go to the smaller token.
    """
    said = texts.select(tokens(text_col).alias("t")).where(F.size("t") > 0)
    counts = cut(said.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = [r["token"] for r in counts.where(F.col("n") * COMMON > total).select("token").collect()]
    known = counts.orderBy(F.desc("n"), "token").limit(vocabulary)
    kept = said.select(F.filter("t", lambda x: ~x.isin(common) if common else F.lit(True)).alias("t")).where(F.size("t") > 1)
    near = F.transform("t", lambda x, i: F.struct(x.alias("token"), F.concat(F.slice("t", F.greatest(i + 1 - window, F.lit(1)), F.least(i, F.lit(window))), F.slice("t", i + 2, F.lit(window))).alias("near")))
    pairs = kept.select(F.explode(near).alias("x")).select("x.token", F.explode("x.near").alias("other")).join(F.broadcast(known.select("token")), "token", "left_semi")
    sums = pairs.select("token", F.inline(_signs(F.col("other"), size))).groupBy("token", "dim").agg(F.sum("sign").alias("v"))
    held = sums.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)).cast("float"))
    return known.join(held, "token", "left").select("token", "n", vector.alias("vector"))


def token_model(vectors: DataFrame) -> tuple[Callable[[str | None], np.ndarray], Callable[[str], np.ndarray]]:
    """Models for ``metrics.bertscore`` (a unit vector for each token of a text) and ``retrieval.embed`` (their sum), from fitted vectors.

    A token without a vector has one of zeros.
    """
    rows = vectors.select("token", "vector").toPandas()
    size = len(rows["vector"].iloc[0]) if len(rows) else 1
    table = np.array([*map(np.asarray, rows["vector"]), np.zeros(size)], np.float64)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
    at = {t: i for i, t in enumerate(rows["token"])}
    held = vectors.sparkSession.sparkContext.broadcast((at, table))

    def each(text: str | None) -> np.ndarray:
        known, v = held.value
        return v[[known.get(t, -1) for t in python_tokens(text)]]

    return each, lambda text: each(text).sum(axis=0) if text else np.zeros(size)
