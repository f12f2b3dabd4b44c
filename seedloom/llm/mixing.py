"""Mixing sources to target shares of tokens by balanced sampling (the cube method).

For each mix the total is asked for, or the largest at which every source that is there can give its
share with no document used more often than allowed.  A source that cannot give its share of the total asked for gives all it may.  A source needs
``r = share * total / its tokens`` uses of each document: all documents get
``floor(r)`` uses and each gets one more with probability ``r - floor(r)``.

Which ones is a balanced sample: the flight moves the vector of probabilities along
directions that leave the number of documents and the number of tokens as they are
(the null space of both constraints over a few undecided documents) until they
are 0 or 1.  Blocks of a bounded size do this side by side, then what is left undecided, at
most a few documents a block, flies again, until one block a source is left.
There the last few documents land, and trades of a chosen document for one that is not, or one more or less where that comes nearer, bring the
tokens to the aim.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.tokens import PATTERN, TOKENIZER, token_sizes
from seedloom.session import cut, input_splits

#: Documents of a block on average.
BLOCK = 8192
#: Documents of a block that stay undecided for the next round, besides those that the flight leaves.
KEPT = 128
_TINY = 1e-9


def _null_vector(a: np.ndarray) -> np.ndarray | None:
    """A direction that changes neither constraint, over as many columns as needed."""
    _, s, vt = np.linalg.svd(a)
    rank = int((s > 1e-9 * max(s[0], 1e-300)).sum()) if len(s) else 0
    return vt[-1] if rank < a.shape[1] else None


def fly(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for at most two, with the same totals of documents and tokens."""
    p = p.copy()
    scale = max(float(tokens.mean()), 1.0) if len(tokens) else 1.0
    waiting = [int(i) for i in rng.permutation(len(p)) if _TINY < p[i] < 1 - _TINY]
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 2:
            break
        x = tokens[held] / scale
        if len(held) == 3:
            u = np.array([x[1] - x[2], x[2] - x[0], x[0] - x[1]])
            if not np.abs(u).max() > 1e-12:
                u = np.array([1.0, -1.0, 0.0])
        else:
            u = _null_vector(np.stack([np.ones(len(held)), x]))
            if u is None:
                break
        now = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > _TINY, (1 - now) / u, np.where(u < -_TINY, -now / u, np.inf)).min()
            down = np.where(u > _TINY, now / u, np.where(u < -_TINY, (now - 1) / u, np.inf)).min()
        # each way with the chance that keeps every probability on average
        step = up if rng.random() < down / (up + down) else -down
        now = now + step * u
        p[held] = np.where(now < _TINY, 0.0, np.where(now > 1 - _TINY, 1.0, now))
        held = [i for i in held if _TINY < p[i] < 1 - _TINY]
    return p


def land(p: np.ndarray, tokens: np.ndarray, aim: float) -> np.ndarray:
    """The undecided few set to 0 or 1, then trades of a chosen document for another until the tokens meet the aim or nothing comes nearer."""
    p = p.copy()
    open_ = np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    if len(open_):
        fixed, number = aim - float(p[p >= 1 - _TINY] @ tokens[p >= 1 - _TINY]), float(p[open_].sum())
        best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda z: (abs(sum(z) - number) >= 1, abs(float(np.dot(z, tokens[open_])) - fixed), z))
        p[open_] = best
    while True:
        over = float(p @ tokens) - aim
        if abs(over) < 1:
            break
        ins, outs = np.flatnonzero(p > 0.5), np.flatnonzero(p < 0.5)
        left = [(abs(over), 0, -1, -1)]
        # one in or out changes the number of documents, so it must come nearer than any trade
        left += [(float(miss.min()), 2, *((int(of[miss.argmin()]), -1) if sign < 0 else (-1, int(of[miss.argmin()])))) for of, sign in ((ins, -1), (outs, 1)) if len(of) for miss in [np.abs(over + sign * tokens[of])]]
        if len(ins) and len(outs):
            outs = outs[np.argsort(tokens[outs], kind="stable")]
            want = tokens[ins] - over
            at = np.clip(np.searchsorted(tokens[outs], want), 1, max(1, len(outs) - 1))
            near = np.where(np.abs(tokens[outs][at - 1] - want) <= np.abs(tokens[outs][np.minimum(at, len(outs) - 1)] - want), at - 1, np.minimum(at, len(outs) - 1))
            miss = np.abs(tokens[outs][near] - want)
            k = int(miss.argmin())
            left.append((float(miss[k]), 1, int(ins[k]), int(outs[near[k]])))
        _, kind, gone, come = min(left)
        if not kind:
            break
        if gone >= 0:
            p[gone] = 0.0
        if come >= 0:
            p[come] = 1.0
    return p


def _flight(seed: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        tokens, p = frame["tokens"].to_numpy(np.float64), frame["p"].to_numpy(np.float64)
        rng = np.random.default_rng([seed, len(frame), int(tokens.sum()) & 0x7FFFFFFF])
        if last:
            return frame.assign(p=land(fly(p, tokens, rng), tokens, float(p @ tokens)))
        # some ordinary documents stay undecided, so that the landing has a choice
        go = np.ones(len(p), bool)
        go[rng.choice(len(p), min(KEPT, len(p)), replace=False)] = False
        out = p.copy()
        out[go] = fly(p[go], tokens[go], rng)
        return frame.assign(p=out)

    return run


def targets_of(sizes: DataFrame, targets: DataFrame, aim: int | None = None) -> DataFrame:
    """Per mix and source: ``target_share``, ``max_repeats``, tokens and documents there, the mix's ``total`` and ``rate``.

    A target row counts with a name, a source, a share above 0 and at least one repeat;
    of repeated rows the largest share.  The total is ``aim`` tokens; without one the largest that every source can
    take part in, which ignores sources without a token.
    """
    wanted = targets.where("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0")
    wanted = wanted.groupBy("mix_name", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("mix_name", "source", "x.*")
    there = sizes.groupBy("source").agg(F.sum("tokens").alias("there"), F.count("*").alias("documents"))
    rows = wanted.join(there.where("there > 0"), "source", "left")
    total = rows.where("there is not null").groupBy("mix_name").agg(F.min(F.col("max_repeats") * F.col("there") / F.col("target_share")).alias("total"))
    rows = rows.join(total, "mix_name", "left") if aim is None else rows.withColumn("total", F.lit(float(aim)))
    return rows.withColumn("rate", F.least(F.col("total") * F.col("target_share") / F.col("there"), F.col("max_repeats").cast("double")))


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, seed: int = 7, block: int = BLOCK, aim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents ``(mix_name, source, id, tokens, uses)`` and the shares of each source.

    Shares: mix_name, source, target_share, max_repeats, documents (chosen), uses, tokens, actual_share. A source
    that is missing or has no token has a share of 0; the others keep their
    proportions.  With ``aim``, the tokens each mix should have, a source that is too small is used as often as allowed and
    reported with the lower share that it has; the others keep their tokens.  Without it the scarcest source bounds the total.  Null texts, null sources and texts without a token are never chosen.
    """
    sized = token_sizes(docs.withColumnRenamed(source_col, "source") if source_col != "source" else docs, id_col, text_col, ("source",), tokenizer, pattern)
    sizes = cut(sized.where("tokens > 0 and source is not null"), "sizes")
    kind = sizes.schema["id"].dataType.simpleString()
    rates = cut(targets_of(sizes, targets, aim), "rates")
    # one row per mix and source, so few that every task can hold them
    used = rates.where("rate is not null").select("mix_name", "source", "rate", F.col("documents").alias("n"))
    rows = sizes.join(F.broadcast(used), "source").withColumn("base", F.floor(F.col("rate") + 1e-12)).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    rows = cut(rows.select("mix_name", "source", "id", "tokens", "base", "p", "n"), "wanted")
    open_ = rows.where(f"p > {_TINY}").select("mix_name", "source", "id", "tokens", "p", "n")
    schema = f"mix_name string, source string, id {kind}, tokens long, p double, n long, block long"
    decided, r = [], 0
    sizes_of = [x["count"] for x in open_.groupBy("mix_name", "source").count().collect()]
    while sizes_of:
        last = max(sizes_of) <= block
        blocks = F.greatest(F.round(F.col("n") / block).cast("long"), F.lit(1)) if not last else F.lit(1).cast("long")
        spread = open_.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed + r)), blocks)).repartition(max(input_splits(docs.sparkSession), sum(sizes_of) // (4 * block)), "mix_name", "source", "block")
        flown = spread.groupBy("mix_name", "source", "block").applyInPandas(_flight(seed + r, last), schema)
        flown = cut(flown.drop("block"), "flight")
        decided.append(flown.where("p = 1").select("mix_name", "id"))
        if last:
            break
        left = flown.where("p > 0 and p < 1")
        per = left.groupBy("mix_name", "source").agg(F.count("*").alias("n"))
        open_ = left.drop("n").join(F.broadcast(per), ["mix_name", "source"]).select("mix_name", "source", "id", "tokens", "p", "n")
        sizes_of, r = [x["n"] for x in per.collect()], r + 1
    chosen = rows.select("mix_name", "source", "id", "tokens", F.col("base").cast("long").alias("base"))
    if decided:
        more = decided[0]
        for part in decided[1:]:
            more = more.unionByName(part)
        chosen = chosen.join(more.withColumn("extra", F.lit(1).cast("long")), ["mix_name", "id"], "left")
    else:
        chosen = chosen.withColumn("extra", F.lit(0).cast("long"))
    chosen = chosen.withColumn("uses", F.col("base") + F.coalesce("extra", F.lit(0))).where("uses > 0").select("mix_name", "source", F.col("id").alias(id_col), "tokens", "uses")
    chosen = cut(chosen, "chosen")
    got = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    shares = rates.select("mix_name", "source", "target_share", "max_repeats").join(got, ["mix_name", "source"], "left").na.fill(0, ["documents", "uses", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    shares = shares.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
    return chosen, shares


def check(chosen: DataFrame, shares: DataFrame, docs: DataFrame, id_col: str, source_col: str, tolerance: float) -> DataFrame:
    """What must hold, per mix and source: how many documents are used too often (``over``), are there ``twice`` or are ``foreign`` to the source, and
    whether its share is within ``tolerance`` of its target among the sources that have any (``met``)."""
    limits = shares.select("mix_name", "source", "max_repeats")
    own = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_set(source_col).alias("_sources"))
    rows = chosen.join(own, id_col, "left").join(F.broadcast(limits), ["mix_name", "source"], "left")
    foreign = ~F.coalesce(F.array_contains("_sources", F.col("source")), F.lit(False))
    per = rows.groupBy("mix_name", "source").agg(F.count_if(F.col("uses") > F.coalesce("max_repeats", F.lit(0))).alias("over"), (F.count("*") - F.count_distinct(id_col)).alias("twice"), F.count_if(foreign).alias("foreign"))
    there = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy("mix_name"))
    aims = shares.withColumn("met", F.abs(F.col("actual_share") - F.when(F.col("tokens") > 0, F.col("target_share") / there).otherwise(0.0)) <= tolerance)
    return aims.join(per, ["mix_name", "source"], "left").select("mix_name", "source", "met", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("over", "twice", "foreign")])
