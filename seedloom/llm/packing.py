"""Placing texts into containers of a fixed capacity, improved by swaps.

Texts larger than a container are cut into full containers and a rest.  All other
items are spread by a hash over blocks of a bounded number of items and containers, and each block starts from
best fit by falling size.  Then items move and trade places between underfull
containers (one against none, one or two, two against none, one or two), each time
so that the sum of squared fills grows, until nothing grows it or there are as few containers as there can be; containers that
run empty go.  Containers still less full than ``GOOD`` are opened again and their items are
packed together with those of other blocks, round after round, until one block is left or a round gains next to nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.tokens import PATTERN, TOKENIZER, token_sizes
from seedloom.session import cut, input_splits

#: Items and containers of a block on average, at most.
BLOCK, BINS = 16_384, 512
#: A container at least so full is final before the last round.
GOOD = 0.999
#: A round that leaves more than this share of its tokens open is the last.
GAIN = 0.9


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers: largest items first, each where least room is left."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([int(item)])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(int(item))
            insort(room, (left - size, b))
    return bins


def _options(items: list[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a container can give up, one way for each size: nothing, an item or a pair, as sizes and the two items (-1 for none)."""
    item = np.array(items, np.int64)
    size = sizes[item]
    _, at, copies = np.unique(size, return_index=True, return_counts=True)
    one, more = item[at], at[copies > 1]
    rows, cols = np.tril_indices(len(one), -1)
    i, j = one[rows], one[cols]
    # two items of one size are a pair too
    twin = np.array([item[np.flatnonzero(size == size[k])[1]] for k in more], np.int64)
    first = np.concatenate([[-1], one, i, item[more]])
    second = np.concatenate([np.full(len(one) + 1, -1), j, twin])
    total = np.where(first >= 0, sizes[first], 0) + np.where(second >= 0, sizes[second], 0)
    total, at = np.unique(total, return_index=True)
    return total, first[at], second[at]


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer containers: the tokens must fit, and no two items above half a container share one."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()), int(len(sizes) > 0))


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Swaps between underfull containers while the sum of squared fills grows and there are more than the fewest containers."""
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    options: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    least, clock = fewest(sizes, capacity), 0
    # when a container last changed, and up to when it has been compared with all others in vain
    changed, seen = np.zeros(len(bins), np.int64), np.full(len(bins), -1, np.int64)

    def of(b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if b not in options:
            options[b] = _options(bins[b], sizes)
        return options[b]

    def best_swap(a: int, others: np.ndarray) -> tuple[int, int, int] | None:
        give = of(a)[0]
        size = np.concatenate([of(b)[0] for b in others])
        lengths = [len(of(b)[0]) for b in others]
        held = np.repeat(fill[others], lengths)
        # against what b gives up, the most that fits is always best
        g = np.searchsorted(give, size + capacity - held, side="right") - 1
        d = give[g] - size
        gain = np.where(d > 0, d * (held - fill[a] + d), 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            return None
        nth = int(np.searchsorted(np.cumsum(lengths), k, side="right"))
        return int(g[k]), int(others[nth]), k - sum(lengths[:nth])

    while True:
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        if len(under) < 2 or np.count_nonzero([len(b) for b in bins]) <= least:
            break
        for a in under[np.argsort(fill[under], kind="stable")]:
            others = under[(under != a) & ((changed[under] > seen[a]) | (changed[a] > seen[a]))]
            swap = best_swap(int(a), others) if len(others) else None
            if swap is not None:
                break
            seen[a] = clock
        else:
            break
        g, b, p = swap
        out = {int(x[g]) for x in of(int(a))[1:]}
        back = {int(x[p]) for x in of(b)[1:]}
        bins[a], bins[b] = [i for i in bins[a] if i not in out] + [i for i in back if i >= 0], [i for i in bins[b] if i not in back] + [i for i in out if i >= 0]
        if not fill[a] - sizes[[i for i in out if i >= 0]].sum() and not any(i >= 0 for i in back):
            bins[b] += bins[a]  # what is left has no size
            bins[a] = []
        for x in (a, b):
            fill[x] = sizes[bins[x]].sum()
            options.pop(int(x), None)
        clock += 1
        changed[a] = changed[b] = clock
    return [b for b in bins if b]


def pack_block(frame: pd.DataFrame) -> pd.DataFrame:
    capacity = int(frame["capacity"].iloc[0])
    sizes = frame["tokens"].to_numpy(np.int64)
    number, filled = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
    for k, items in enumerate(improve(best_fit(sizes, capacity), sizes, capacity)):
        number[items], filled[items] = k, sizes[items].sum()
    return frame.assign(bin=number, filled=filled)


def pack(docs: DataFrame, id_col: str, text_col: str, specs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, block: int = BLOCK) -> DataFrame:
    """One row per document or piece and specification.

    Columns: spec_name, id, piece (from 0; piece k starts at token k * capacity), tokens,
    container, filled, unused.  Null texts have no row; an empty text is an item of size 0.
    Specifications without a positive capacity or a name have no rows; of repeated ones the largest capacity counts.
    """
    sized = cut(token_sizes(docs, id_col, text_col, (), tokenizer, pattern), "sizes")
    wanted = specs.where("spec_name is not null and capacity_tokens > 0").groupBy("spec_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    chosen = wanted.agg(F.collect_list(F.struct("spec_name", "capacity")).alias("specs"))
    items = sized.join(F.broadcast(chosen), F.lit(True)).select("id", "tokens", F.inline("specs"))
    pieces = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    cuts = items.select("spec_name", "capacity", "id", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cuts = cuts.withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")))
    name = F.col("spec_name")
    done = [cuts.where("tokens = capacity").select("spec_name", "id", "piece", "tokens", "capacity", F.concat_ws("-", name, F.lit("full"), F.col("id"), F.col("piece")).alias("container"), F.col("tokens").alias("filled"))]
    rest = cut(cuts.where("tokens < capacity"), "items")
    kind = rest.schema["id"].dataType.simpleString()
    r, before = 0, None
    while True:
        counts = rest.groupBy("spec_name").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("capacity").alias("c")).collect()
        if not counts:
            break
        blocks_of = {x["spec_name"]: max(1, round(x["n"] / block), round(x["t"] / (x["c"] * BINS))) for x in counts}
        left = sum(x["t"] for x in counts)
        last = max(blocks_of.values()) == 1 or before is not None and left > GAIN * before
        blocks = F.lit(1)
        for spec, n in blocks_of.items():
            blocks = F.when(name == spec, F.lit(n)).otherwise(blocks)
        spread = rest.select("spec_name", "capacity", "id", "piece", "tokens").withColumn("block", F.pmod(F.xxhash64("id", "piece", F.lit(r)), blocks))
        tasks = max(input_splits(docs.sparkSession), sum(blocks_of.values()) // 4)
        packed = spread.repartition(tasks, "spec_name", "block").groupBy("spec_name", "block").applyInPandas(pack_block, f"spec_name string, capacity long, id {kind}, piece int, tokens long, block long, bin long, filled long")
        packed = cut(packed, "packed")
        good = packed if last else packed.where(F.col("filled") >= F.col("capacity") * GOOD)
        done.append(good.select("spec_name", "id", "piece", "tokens", "capacity", F.concat_ws("-", name, F.lit(r), F.col("block"), F.col("bin")).alias("container"), "filled"))
        if last:
            break
        rest, r, before = packed.where(F.col("filled") < F.col("capacity") * GOOD), r + 1, left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("spec_name", F.col("id").alias(id_col), "piece", "tokens", "container", "filled", (F.col("capacity") - F.col("filled")).alias("unused"))


def check(placed: DataFrame, id_col: str) -> DataFrame:
    """What must hold, per specification: ``documents`` placed, and how many are ``torn`` (a piece is missing or there twice, or one that fits is divided),
    containers ``over`` their capacity, and those whose ``filled`` is not what they hold."""
    size = F.max(F.col("filled") + F.col("unused"))
    per = placed.groupBy("spec_name", id_col).agg(F.count("*").alias("n"), F.count_distinct("piece").alias("d"), (F.max("piece") + 1).alias("m"), F.sum("tokens").alias("t"), size.alias("c"))
    torn = (F.col("n") != F.col("d")) | (F.col("n") != F.col("m")) | (F.col("n") != F.greatest(F.ceil(F.col("t") / F.col("c")), F.lit(1)))
    documents = per.groupBy("spec_name").agg(F.count("*").alias("documents"), F.count_if(torn).alias("torn"))
    held = placed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("t"), F.max("filled").alias("f"), size.alias("c"))
    containers = held.groupBy("spec_name").agg(F.count_if(F.col("t") > F.col("c")).alias("over"), F.count_if(F.col("t") != F.col("f")).alias("misfilled"))
    return documents.join(containers, "spec_name")


def room(placed: DataFrame) -> DataFrame:
    """Per specification: containers, tokens, unused room and its share, and the fewest containers there could be."""
    per = placed.groupBy("spec_name", "container").agg(F.max("filled").alias("filled"), F.max("unused").alias("unused"))
    total = per.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"), F.sum("unused").alias("unused"), F.max(F.col("filled") + F.col("unused")).alias("capacity"))
    return total.select("spec_name", "containers", "tokens", "unused", (F.col("unused") / (F.col("tokens") + F.col("unused"))).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity")).cast("long").alias("fewest"))
