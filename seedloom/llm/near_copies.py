"""Near-duplicate texts: a Gray-order hierarchical index inside lossless blocks.

Texts are compared by the distinct runs of ``WIDTH`` words they hold.

Fingerprint: each run flips one of 128 bits.  Two fingerprints differ in at most
as many bits as there are runs that only one text holds, so two texts of sizes
``m`` and ``n`` whose similarity reaches ``t`` differ in at most
``(m + n)(1 - t) / (1 + t)`` bits: pruning by differences loses no link.

Blocks: over all pairs such an index cannot prune near the top, as unrelated
groups share only a few leading bits.  So each text enters the blocks of its
``n - ceil(t n) + 1`` rarest runs; two texts whose similarity reaches ``t`` share such
a block, whatever the order of runs is.  Runs are counted exactly, over all texts; the order takes the
``LISTED`` most frequent ones by their counts, after all others by their hashes.

Index: in each block the fingerprints are sorted by Gray rank.  Up to ``FAN``
neighbours make a leaf and up to ``FAN`` nodes an upper node; a node holds the
mask and the pattern of the bits that all below it share and no node above
holds.  A search adds up the differences on the way down and drops a whole
group once they exceed what its sizes allow.  What is left is checked on the runs.

A block of more than ``DENSE`` texts is not searched at once: its texts are linked
inside overlapping stretches in Gray order, checked on the spot, and linked
texts are not compared again.  Then the block's largest class is compared with all else in it, and taken out,
class after class.  One minus the similarity is a metric: the distances of both sides to one text of the class
tell which of them can be links at all, so a class that is unlike another is hardly ever compared with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import join_counted, positive_rows, words
from seedloom.llm.components import components
from seedloom.operators.keyed import content_hash, one_per_id
from seedloom.session import cut, input_splits, spread

FAN = 8
DENSE = 512
#: Frequent runs that are listed with their counts, in 12 bytes each.
LISTED = 1 << 20
#: Distinct runs that a task counts before it hands their counts on, and pairs of entries that are searched at once.
HELD, PAIRS = 1 << 20, 1 << 20
#: Width of a ring of distances.
RING = 0.05
_BITS = 128
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- runs of words and fingerprints ---------------------------------------


class Runs:
    """Hashed distinct runs of words of a batch of texts."""

    def __init__(self, width: int) -> None:
        import xxhash

        self.width = width
        self.digest = xxhash.xxh3_64_intdigest
        self.known: dict[str, int] = {}

    def of(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Row number and hash of each distinct run, sorted by row, then hash."""
        known, digest = self.known, self.digest
        if len(known) > 500_000:
            known.clear()
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = text.split(" ") if text else []
            sizes[i] = len(parts)
            for w in parts:
                h = known.get(w)
                if h is None:
                    h = known[w] = digest(w)
                flat.append(h)
        word = np.array(flat, np.uint64)
        row = np.repeat(np.arange(len(texts)), sizes)
        k = self.width
        if len(word) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(word) - k + 1
        run = np.zeros(n, np.uint64)
        for j in range(k):
            run = (run ^ word[j : j + n]) * _M1
            run ^= run >> np.uint64(29)
        run = (run * _M2) ^ ((run * _M2) >> np.uint64(32))
        whole = row[:n] == row[k - 1 :]
        row, run = row[:n][whole], run[whole]
        order = np.lexsort((run, row))
        row, run = row[order], run[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
        return row[new], run[new]


def fingerprints(row: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have runs, the number of runs, and the two words of each fingerprint."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    bit = ((run * _M3) >> np.uint64(40)) % np.uint64(_BITS)
    one = np.uint64(1)
    first = np.where(bit < 64, one << (bit % np.uint64(64)), np.uint64(0))
    second = np.where(bit >= 64, one << (bit % np.uint64(64)), np.uint64(0))
    if not len(row):
        return row, row, first, second
    sizes = np.diff(np.r_[starts, len(row)])
    return row[starts], sizes, np.bitwise_xor.reduceat(first, starts), np.bitwise_xor.reduceat(second, starts)


def gray_rank(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each fingerprint in Gray-code order, as two words."""

    def fold(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        return x

    high = fold(first)
    odd = (np.bitwise_count(first) & 1).astype(bool)
    low = fold(second)
    return high, np.where(odd, ~low, low)


# --- the index --------------------------------------------------------------


class GrayIndex:
    """Hierarchies over many blocks at once; entries must be sorted by block, then Gray rank."""

    def __init__(self, block: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        self.sizes, self.bits = sizes, (first, second)
        self.levels: list[dict[str, np.ndarray]] = []
        n = len(block)
        blk, lo, hi = block, np.arange(n), np.arange(n) + 1
        small, large = sizes, sizes
        ones = [first, second]
        zeros = [~first, ~second]
        while True:
            begin = np.r_[True, blk[1:] != blk[:-1]]
            base = np.maximum.accumulate(np.where(begin, np.arange(len(blk)), 0))
            group = np.flatnonzero((np.arange(len(blk)) - base) % FAN == 0)
            end = np.r_[group[1:], len(blk)]
            ones = [np.bitwise_and.reduceat(x, group) for x in ones]
            zeros = [np.bitwise_and.reduceat(x, group) for x in zeros]
            small, large = np.minimum.reduceat(small, group), np.maximum.reduceat(large, group)
            blk, lo, hi = blk[group], lo[group], hi[end - 1]
            self.levels.append({"child": group, "child_end": end, "lo": lo, "hi": hi, "small": small, "large": large, "mask0": ones[0] | zeros[0], "mask1": ones[1] | zeros[1], "pat0": ones[0], "pat1": ones[1], "block": blk})
            if not (blk[1:] == blk[:-1]).any():
                break
        # the bits that an upper node shares are dropped from the nodes below it
        for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            above = np.repeat(np.arange(len(upper["lo"])), upper["child_end"] - upper["child"])
            lower["own0"] = lower["mask0"] & ~upper["mask0"][above]
            lower["own1"] = lower["mask1"] & ~upper["mask1"][above]
        self.levels[-1]["own0"], self.levels[-1]["own1"] = self.levels[-1]["mask0"], self.levels[-1]["mask1"]

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries ``i < j`` of a block, and their differing bits, that may reach the threshold."""
        slack = (1 - threshold) / (1 + threshold)
        f0, f1 = self.bits
        top = self.levels[-1]
        q = np.arange(len(f0))
        node = np.repeat(np.arange(len(top["lo"])), top["hi"] - top["lo"])
        differ = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[depth]
            differ = differ + np.bitwise_count((f0[q] ^ lv["pat0"][node]) & lv["own0"][node]) + np.bitwise_count((f1[q] ^ lv["pat1"][node]) & lv["own1"][node])
            size = self.sizes[q]
            keep = (lv["hi"][node] - 1 > q) & (differ <= (size + lv["large"][node]) * slack + 1e-9) & (lv["large"][node] >= size * threshold - 1e-9) & (lv["small"][node] * threshold <= size + 1e-9)
            q, node, differ = q[keep], node[keep], differ[keep]
            fan = lv["child_end"][node] - lv["child"][node]
            at = np.repeat(lv["child"][node], fan) + _count_up(fan)
            q, differ, node = np.repeat(q, fan), np.repeat(differ, fan), at
        j = node
        far = np.bitwise_count(f0[q] ^ f0[j]) + np.bitwise_count(f1[q] ^ f1[j])
        a, b = self.sizes[q], self.sizes[j]
        keep = (j > q) & (far <= (a + b) * slack + 1e-9) & (np.minimum(a, b) >= np.maximum(a, b) * threshold - 1e-9)
        return q[keep], j[keep], far[keep]


def _count_up(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after the other."""
    total = int(lengths.sum())
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - starts


# --- blocks ------------------------------------------------------------------


def _prefix(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1


@dataclass(frozen=True)
class Frequent:
    """The most frequent runs, sorted, and the texts that hold each; all runs not listed are held by fewer than ``least``."""

    run: np.ndarray
    texts: np.ndarray
    least: int

    def of(self, run: np.ndarray) -> np.ndarray:
        """Texts that hold each run; 0 for a run that is not listed."""
        if not len(self.run):
            return np.zeros(len(run), np.int64)
        at = np.minimum(np.searchsorted(self.run, run), len(self.run) - 1)
        return np.where(self.run[at] == run, self.texts[at], 0)


def frequent_runs(texts: DataFrame, width: int, listed: int = LISTED) -> Frequent:
    """Exact counts of all runs by key, of which at most ``listed`` leave the executors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width)
        held: list[np.ndarray] = []
        size = 0
        known, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, run = runs.of(batch["words"])
            held.append(run.view(np.int64))
            size += len(run)
            if size > HELD:
                known, n = _added(known, n, held)
                held, size = [], 0
                if len(known) > HELD:
                    yield pd.DataFrame({"run": known, "n": n})
                    known, n = known[:0], n[:0]
        known, n = _added(known, n, held)
        yield pd.DataFrame({"run": known, "n": n})

    counted = texts.select("words").mapInPandas(count, "run long, n long")
    shared = cut(counted.groupBy("run").agg(F.sum("n").alias("n")).where("n > 1"), "runs")
    few = F.least("n", F.lit(1 << 16)).alias("n")
    per = sorted(((r["n"], r["k"]) for r in shared.select(few).groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = (1 << 16) + 1, 0
    for n, k in per:
        if total + k > listed:
            break
        least, total = n, total + k
    if total == sum(k for _, k in per):
        least = 2

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"run": [batch["run"].to_numpy(np.int64).tobytes()], "n": [np.minimum(batch["n"].to_numpy(), 2**31 - 1).astype(np.int32).tobytes()]})

    blobs = shared.where(F.col("n") >= least).mapInPandas(pack, "run binary, n binary").collect()
    run = np.concatenate([np.frombuffer(r["run"], np.int64) for r in blobs] or [np.zeros(0, np.int64)])
    n = np.concatenate([np.frombuffer(r["n"], np.int32) for r in blobs] or [np.zeros(0, np.int32)])
    order = np.argsort(run)
    return Frequent(run[order], n[order], least)


def _added(known: np.ndarray, n: np.ndarray, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by run with one more for each of some runs."""
    new, more = np.unique(np.concatenate([*runs, known[:0]]), return_counts=True)
    both, at = np.unique(np.concatenate([known, new]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([n, more]), len(both)).astype(np.int64)


_MEMBER = "token long, tid long, size int, f0 long, f1 long, often long"


def memberships(texts: DataFrame, frequent: Frequent, width: int, threshold: float) -> DataFrame:
    """One row per text and block it enters, with size, fingerprint and the block's number of texts (0 if it is not listed)."""
    table = texts.sparkSession.sparkContext.broadcast(frequent)

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width)
        for batch in batches:
            row, run = runs.of(batch["words"])
            if not len(row):
                continue
            rows, sizes, first, second = fingerprints(row, run)
            often = table.value.of(run.view(np.int64))
            order = np.lexsort((run, often, row))
            at = np.repeat(np.arange(len(rows)), sizes)  # rows are sorted, so the order within a row moves no row
            place = _count_up(sizes)
            keep = place < _prefix(sizes, threshold)[at]
            token, often = run[order][keep], often[order][keep]
            at = at[keep]
            if table.value.least == 2:  # a run that is not listed is held by one text, which is no pair
                at, token, often = at[often > 1], token[often > 1], often[often > 1]
            yield pd.DataFrame({"token": token.view(np.int64), "tid": batch["tid"].to_numpy()[rows[at]], "size": sizes[at].astype(np.int32), "f0": first[at].view(np.int64), "f1": second[at].view(np.int64), "often": often})

    return texts.select("tid", "words").mapInPandas(enter, _MEMBER)


def _whole_blocks(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Batches cut at block borders; the input is sorted by the key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        k = batch[key].to_numpy()
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        if held and (held[-1][key].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held)
            held = []
        if len(change):
            cut_at = change[-1] + 1
            yield pd.concat([*held, batch.iloc[:cut_at]])
            held = [batch.iloc[cut_at:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held)


def _sorted_arrays(frame: pd.DataFrame, block: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, second = frame["f0"].to_numpy().view(np.uint64), frame["f1"].to_numpy().view(np.uint64)
    high, low = gray_rank(first, second)
    order = np.lexsort((low, high, block))
    return frame.iloc[order], block[order], frame["size"].to_numpy().astype(np.int64)[order], first[order], second[order]


def block_pairs(members: DataFrame, threshold: float, partitions: int, hot: int, dense_from: int = DENSE) -> DataFrame:
    """``(a, b, n)``: pairs of each block that may reach the threshold (n = 0); ``(token, null, n)`` for a dense block.

    Blocks that may hold more than ``hot`` texts are left to the dense path.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_blocks(batches, ["token"]):
            token = frame["token"].to_numpy()
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            lengths = np.diff(np.r_[starts, len(token)])
            dense = lengths > dense_from
            if dense.any():
                yield pd.DataFrame({"a": token[starts[dense]], "b": None, "n": lengths[dense]}).astype({"b": "Int64"})
            search_in = (lengths > 1) & ~dense
            keep = np.repeat(search_in, lengths)
            if not keep.any():
                continue
            frame, lengths = frame[keep], lengths[search_in]
            # whole blocks, so many at once that their pairs stay few
            lot = np.repeat(np.cumsum(lengths * lengths) // PAIRS, lengths)
            for part in np.split(np.arange(len(frame)), np.flatnonzero(lot[1:] != lot[:-1]) + 1):
                entries = frame.iloc[part]
                entries, block, sizes, first, second = _sorted_arrays(entries, entries["token"].to_numpy())
                i, j, _ = GrayIndex(block, sizes, first, second).pairs(threshold)
                tid = entries["tid"].to_numpy()
                a, b = np.minimum(tid[i], tid[j]), np.maximum(tid[i], tid[j])
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b, "n": 0}).drop_duplicates()

    moved = members.where(F.col("often") <= hot).drop("often").repartition(partitions, "token").sortWithinPartitions("token")
    return moved.mapInPandas(search, "a long, b long, n long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity reaches the threshold, by their runs."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width)
        for batch in batches:
            sets = []
            for side in ("low", "high"):
                row, run = runs.of(batch[side])
                cuts = np.searchsorted(row, np.arange(len(batch) + 1))
                sets.append([run[cuts[k] : cuts[k + 1]] for k in range(len(batch))])
            keep = [_reaches(x, y, threshold) for x, y in zip(*sets, strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("tid"))
    joined = ends.join(texts.select("tid", "words"), "tid")
    both = joined.groupBy("a", "b").agg(F.min_by("words", "tid").alias("low"), F.max_by("words", "tid").alias("high"))
    return both.mapInPandas(check, "a long, b long")


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9


# --- dense blocks --------------------------------------------------------------


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _linked(frame: pd.DataFrame, runs: Runs, threshold: float, one_sided: bool) -> list[tuple[int, int]]:
    """Links that join classes within one piece of a dense block, checked on the runs."""
    frame, block, sizes, first, second = _sorted_arrays(frame, np.zeros(len(frame), np.int64))
    i, j, far = GrayIndex(block, sizes, first, second).pairs(threshold)
    tid, asks = frame["tid"].to_numpy(), frame["asks"].to_numpy()
    known = {c: k for k, c in enumerate(dict.fromkeys(frame["comp"]))}
    union, comp = _Union(len(known)), np.array([known[c] for c in frame["comp"]])
    # one class left: nothing to join; pairs of one class, side or text never join any
    classes = len(known)
    keep = (comp[i] != comp[j]) & (tid[i] != tid[j])
    if one_sided:
        keep &= asks[i] != asks[j]
    i, j, far = i[keep], j[keep], far[keep]
    held: dict[int, np.ndarray] = {}
    row, run = runs.of(frame["words"])
    cuts = np.searchsorted(row, np.arange(len(frame) + 1))
    links = []
    for k in np.argsort(far, kind="stable"):
        a, b = int(i[k]), int(j[k])
        if classes == 1:
            break
        if union.root(comp[a]) == union.root(comp[b]):
            continue
        for x in (a, b):
            if x not in held:
                held[x] = run[cuts[x] : cuts[x + 1]]
        if _reaches(held[a], held[b], threshold):
            union.join(comp[a], comp[b])
            classes -= 1
            links.append((int(tid[a]), int(tid[b])))
    return links


def dense_links(members: DataFrame, texts: DataFrame, width: int, threshold: float, partitions: int, stretch: int = DENSE) -> DataFrame:
    """Links inside stretches of ``stretch`` neighbours in Gray order, which overlap by half."""

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width)
        held: pd.DataFrame | None = None

        def link(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_linked(frame, runs, threshold, False), columns=["a", "b"])

        for batch in batches:
            for _, part in batch.groupby("token", sort=False):
                if held is not None and held["token"].iloc[0] == part["token"].iloc[0]:
                    part = pd.concat([held, part])
                elif held is not None:
                    yield link(held)
                while len(part) > stretch:
                    yield link(part.iloc[:stretch])
                    part = part.iloc[stretch // 2 :]
                held = part
        if held is not None:
            yield link(held)

    ranked = members.join(texts.select("tid", "words"), "tid").select("token", "tid", "size", "f0", "f1", "words", F.col("tid").alias("comp"), F.lit(False).alias("asks"), *_rank_columns())
    moved = ranked.repartitionByRange(partitions, "token", "g0", "g1", "tid").sortWithinPartitions("token", "g0", "g1", "tid").drop("g0", "g1")
    return moved.mapInPandas(stretches, "a long, b long")


def _rank_columns() -> list[Column]:
    """Gray rank in the JVM, as two numbers that sort in its order."""

    def fold(x: Column) -> Column:
        for s in (1, 2, 4, 8, 16, 32):
            x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
        return x

    low = fold(F.col("f1"))
    odd = F.bit_count("f0") % 2 == 1
    least = F.lit(-(2**63)).cast("long")
    return [fold(F.col("f0")).bitwiseXOR(least).alias("g0"), F.when(odd, F.bitwise_not(low)).otherwise(low).bitwiseXOR(least).alias("g1")]


def distances(rows: DataFrame, width: int) -> DataFrame:
    """Adds ``ring``: the distance between ``words`` and ``pivot_words``, one minus their similarity, in steps of ``RING``; drops both texts."""
    kept = [f for f in rows.schema.fields if f.name not in ("words", "pivot_words")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width)
        for batch in batches:
            pivots = pd.unique(batch["pivot_words"])
            row, run = runs.of(pd.Series([*batch["words"], *pivots]))
            cuts = np.searchsorted(row, np.arange(len(batch) + len(pivots) + 1))
            of = {w: run[cuts[len(batch) + k] : cuts[len(batch) + k + 1]] for k, w in enumerate(pivots)}
            far = np.ones(len(batch))
            for k, w in enumerate(batch["pivot_words"]):
                x, y = run[cuts[k] : cuts[k + 1]], of[w]
                both = np.intersect1d(x, y, assume_unique=True).size
                far[k] = 1 - both / (len(x) + len(y) - both)
            yield batch[[f.name for f in kept]].assign(ring=np.floor(far / RING).astype(np.int32))

    return rows.mapInPandas(measure, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", ring int")


def rest_links(members: DataFrame, texts: DataFrame, comps: DataFrame, width: int, threshold: float, partitions: int, piece: int = DENSE) -> DataFrame:
    """Links between the classes of each dense block.

    Round after round the largest class of each block is compared with all else in it and, if it has more than ``piece`` texts, taken out;
    a block without so large a class is compared as a whole.  Only rows whose distances to one
    text of the class differ by no more than a link's can be linked: rows lie in rings of distance, each in pieces of
    about ``piece``, and each pair of pieces of rings that are near enough is one group.
    """
    own = members.join(comps.withColumnsRenamed({"u": "tid", "root": "_root"}), "tid", "left").withColumn("comp", F.coalesce("_root", "tid")).select("token", "tid", "size", "f0", "f1", "comp")
    own = cut(own, "dense")
    reach = math.ceil((1 - threshold) / RING + 1e-9)
    found: list[DataFrame] = []
    while True:
        per = own.groupBy("token", "comp").agg(F.count("*").alias("n"), F.min("tid").alias("pivot"))
        top = per.groupBy("token").agg(F.max(F.struct("n", (-F.col("comp")).alias("c"), "pivot")).alias("top"), F.sum("n").alias("m"), F.count("*").alias("classes")).where("classes > 1")
        top = top.select("token", "m", (-F.col("top.c")).alias("largest"), (F.col("top.n") > piece).alias("big"), F.col("top.pivot").alias("pivot"))
        top = cut(top.join(texts.select(F.col("tid").alias("pivot"), F.col("words").alias("pivot_words")), "pivot").drop("pivot"), "tops")
        total = top.agg(F.sum("m")).first()[0]
        if not total:
            break
        rows = join_counted(own, top, "token", "m", own.count()).join(texts.select("tid", "words"), "tid")
        rows = cut(distances(rows, width), "rings")
        found.append(_between(rows, texts, width, threshold, partitions, piece, reach, total))
        own = cut(rows.where("big and comp <> largest").select("token", "tid", "size", "f0", "f1", "comp"), "dense")
    out = texts.sparkSession.createDataFrame([], "a long, b long")
    for more in found:
        out = out.unionByName(more)
    return out


def _between(rows: DataFrame, texts: DataFrame, width: int, threshold: float, partitions: int, piece: int, reach: int, total: int) -> DataFrame:
    """Links of one round, between the rows of the largest class (all rows where it is small) and those outside it."""
    sides = F.when(F.col("comp") == F.col("largest"), F.array(F.lit(False))).when(F.col("big"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    rows = rows.withColumn("asks", F.explode(sides)).withColumn("key", F.concat_ws(":", "token", "ring", F.col("asks").cast("int")))
    per = cut(rows.groupBy("key", "token", "ring", "asks").agg(F.count("*").alias("n")), "rings-of")
    other = per.select("token", F.col("ring").alias("to"), (~F.col("asks")).alias("asks"), F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    near = per.join(other, ["token", "asks"]).where(F.abs(F.col("ring") - F.col("to")) <= reach)
    near = near.groupBy("key", "n").agg(F.collect_list(F.struct("to", "pieces")).alias("near"))
    mine = join_counted(rows, near.withColumn("own", F.ceil(F.col("n") / piece).cast("int")), "key", "n", 2 * total)
    mine = mine.withColumn("p", F.pmod(F.xxhash64("tid"), "own").cast("int"))
    spread_out = mine.select("token", "tid", "size", "f0", "f1", "comp", "asks", "ring", "p", F.explode("near").alias("x")).select("*", F.col("x.to").alias("to"), F.explode(F.sequence(F.lit(0), F.col("x.pieces") - 1)).alias("q")).drop("x")
    ends = {"ring_a": ("ring", "to"), "piece_a": ("p", "q"), "ring_b": ("to", "ring"), "piece_b": ("q", "p")}
    key = ["token", *ends]
    placed = spread_out.withColumns({n: F.when(F.col("asks"), F.col(b)).otherwise(F.col(a)) for n, (a, b) in ends.items()}).join(texts.select("tid", "words"), "tid")
    placed = placed.select(*key, "tid", "comp", "size", "f0", "f1", "words", "asks")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width)
        for frame in _whole_blocks(batches, key):
            for _, part in frame.groupby(key, sort=False):
                yield pd.DataFrame(_linked(part, runs, threshold, True), columns=["a", "b"])

    return placed.repartition(partitions, *key).sortWithinPartitions(*key).mapInPandas(compare, "a long, b long")


# --- the operator -----------------------------------------------------------------


def near_classes(df: DataFrame, id_col: str, text_col: str, version: str | None = None, width: int = 5, threshold: float = 0.8, dense_from: int = DENSE) -> DataFrame:
    """``(id, first_id)`` for each record of a group of two or more; first_id is the group's smallest id.

    Records with the same words are in one group; different texts are linked if
    the similarity of their distinct runs of ``width`` words reaches ``threshold``, and
    a group is all that links connect.  Null texts, texts without a word and null
    ids are in no group; a text shorter than a run is linked to none but its copies.
    Of rows that share an id one counts (``keyed.one_per_id``), whether it has a text or not.  Ids are whole numbers.
    A block of more than ``dense_from`` texts takes the dense path; the result is the same.
    """
    source = spread(df.where(F.col(id_col).isNotNull()).select(*dict.fromkeys([id_col, text_col, *([version] if version else [])])))
    when = F.col(version) if version else F.lit(None).cast("timestamp")
    worded = source.select(F.col(id_col).cast("long").alias("id"), when.alias("version"), content_hash(F.col(text_col)).alias("said"), words(F.col(text_col)).alias("words")).withColumn("key", F.unhex(F.md5("words")))
    rows = one_per_id(worded, "id", F.col("version"), F.col("said"), {"key": F.col("key")})
    rows = cut(rows.where(F.col("key") != F.unhex(F.md5(F.lit("")))), "rows")
    total = rows.count()
    held = rows.groupBy("key").agg(F.min("id").alias("tid"), F.count("*").alias("n"))
    texts = cut(worded.where("key is not null").groupBy("key").agg(F.first("words").alias("words")).join(held, "key"), "texts")

    frequent = frequent_runs(texts, width)
    partitions = max(input_splits(df.sparkSession), total // 100_000)
    hot = max(50_000, total // partitions)
    members = memberships(texts, frequent, width, threshold)
    found = cut(block_pairs(members, threshold, partitions, hot, dense_from), "pairs")
    links = verified(found.where("b is not null").select("a", "b").distinct(), texts, width, threshold)
    dense = found.where("b is null").select(F.col("a").alias("token")).distinct()
    if int(frequent.texts.max(initial=0)) > hot or not dense.isEmpty():
        many = cut(members.where(F.col("often") <= hot).join(dense, "token", "left_semi").unionByName(members.where(F.col("often") > hot)), "dense-members")
        links = cut(links.unionByName(dense_links(many, texts, width, threshold, partitions, dense_from)), "links")
        rest = rest_links(many, texts, components(links), width, threshold, partitions, dense_from)
        links = links.unionByName(rest)
    roots = components(links)
    classes = texts.select("key", "tid", "n").join(roots, F.col("tid") == F.col("u"), "left")
    classes = classes.select("key", "n", F.coalesce("root", "tid").alias("first_id"), F.col("root").isNotNull().alias("linked"))
    # the group's first member is in it only if another text or a copy is; it is told apart below
    joined = join_counted(rows, classes.where("linked or n > 1").select("key", "n", "first_id"), "key", "n", total)
    return joined.select("id", "first_id")


def near_copies(df: DataFrame, id_col: str, text_col: str, version: str | None = None, width: int = 5, threshold: float = 0.8, dense_from: int = DENSE) -> DataFrame:
    """One row per record that is not the first of its group: ``first_id``, ``member_id``; see ``near_classes``."""
    found = near_classes(df, id_col, text_col, version, width, threshold, dense_from)
    return found.where("id <> first_id").select("first_id", F.col("id").alias("member_id"))


def near_examples(examples: DataFrame) -> DataFrame:
    return near_copies(positive_rows(examples), "example_id", "input", "loaded_at", width=3, threshold=0.55)
