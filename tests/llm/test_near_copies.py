import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seedloom.llm import near_copies as nc
from seedloom.llm.components import components


def brute(rows, width, threshold):
    words = {}
    for i, t in rows:
        if i is not None and t is not None:
            w = tuple(re.findall(r"[^\W_]+", t.lower()))
            if w:
                words[i] = w
    up = {i: i for i in words}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: {w[k : k + width] for k in range(len(w) - width + 1)} for i, w in words.items()}
    ids = sorted(words)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if words[a] == words[b] or both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((root(i), i) for i in ids if root(i) != i)


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.insert(k, f"n{rng.randrange(99)}"), lambda: w.pop(k), lambda: w.__setitem__(k, f"n{rng.randrange(99)}")])()
    return " ".join(w)


def corpus(seed, families, copies, shared=6, edits=4):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"s{k}" for k in range(shared)] + [f"w{f}x{k}" for k in range(rng.randrange(8, 30))]
        for _ in range(rng.randrange(1, copies)):
            rows.append((len(rows), edited(rng, base, rng.randrange(edits))))
    return rows


@pytest.mark.parametrize(("width", "threshold", "dense"), [(3, 0.55, 512), (3, 0.55, 4), (5, 0.8, 512), (2, 0.3, 8)])
def test_groups_equal_brute_force(spark, width, threshold, dense):
    rows = corpus(width, 60, 8)
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    got = nc.near_copies(df, "id", "t", None, width, threshold, dense)
    assert sorted(map(tuple, got.collect())) == brute(rows, width, threshold)


def test_one_family_of_a_third_of_all_rows(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    rows = [(i, edited(rng, base, 5)) for i in range(300)]
    rows += [(300 + i, edited(rng, [f"z{i // 3}q{k}" for k in range(20)] + base[:6], 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string")
    want = brute(rows, 3, 0.55)
    for dense in (16, 100_000):
        assert sorted(map(tuple, nc.near_copies(df, "id", "t", None, 3, 0.55, dense).collect())) == want


@pytest.mark.parametrize("listed", [0, 3, 40])
def test_groups_do_not_depend_on_the_list_of_runs(spark, monkeypatch, listed):
    rows = corpus(8, 40, 8)
    monkeypatch.setattr(nc, "frequent_runs", lambda texts, width, real=nc.frequent_runs: real(texts, width, listed))
    got = nc.near_copies(spark.createDataFrame(rows, "id long, t string"), "id", "t", None, 3, 0.55, 16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 0.55)


def test_runs_are_counted_exactly(spark):
    rows = [(i, f"a b c d{i % 3} e{i % 7}") for i in range(50)]
    texts = spark.createDataFrame(rows, "tid long, words string").repartition(6)
    got = nc.frequent_runs(texts, 3)
    _, run = nc.Runs(3).of(pd.Series([t for _, t in rows]))
    one, n = np.unique(run.view(np.int64), return_counts=True)
    assert got.least == 2 and dict(zip(got.run, got.texts, strict=True)) == {a: b for a, b in zip(one, n, strict=True) if b > 1}
    few = nc.frequent_runs(texts, 3, 5)
    assert len(few.run) <= 5 and all(b < few.least for a, b in zip(one, n, strict=True) if a not in few.run)


def test_unlike_classes_in_one_block(spark):
    """Several large classes, and texts between them, that share one rare run."""
    rng = random.Random(3)
    rows = []
    for f in range(4):
        base = [f"w{f}x{k}" for k in range(14)]
        for _ in range(90):
            rows.append((len(rows), edited(rng, base, 2) + " one rare run"))
    rows += [(len(rows) + i, " ".join(f"w{i % 4}x{k}" for k in range(7)) + " " + " ".join(f"w{(i + 1) % 4}x{k}" for k in range(7)) + f" one rare run n{i}") for i in range(40)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute(rows, 3, 0.55)
    for dense in (20, 60):
        assert sorted(map(tuple, nc.near_copies(spark.createDataFrame(rows, "id long, t string"), "id", "t", None, 3, 0.55, dense).collect())) == want


def test_the_earliest_delivery_counts(spark):
    rows = [(1, None, 1), (1, "one two three", 2), (2, "one two three", 1), (3, "one two three!", 1)]
    assert [tuple(r) for r in nc.near_copies(spark.createDataFrame(rows, "id long, t string, at int"), "id", "t", "at", 3, 0.55).collect()] == [(2, 3)]


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one two"), (7, "one"), (8, long), (9, long + " end"), (None, "one two"), (5, "One, two!"), (10, "a b c"), (11, "a b c d")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "id long, t string, tid long, root long")
    got = sorted(map(tuple, nc.near_copies(df, "id", "t", None, 3, 0.55).collect()))
    assert got == [(4, 5), (4, 6), (8, 9)]
    assert nc.near_copies(df.limit(0), "id", "t").count() == 0
    assert sorted(nc.near_copies(df, "id", "t").columns) == ["first_id", "member_id"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=25), min_size=2, max_size=40), st.sampled_from([0.3, 0.55, 0.8]))
def test_index_loses_no_link(sets, threshold):
    """Every pair that reaches the threshold is a candidate of the index, in any of two blocks."""
    run = np.concatenate([np.array(sorted(hash((x, "r")) & (2**63 - 1) for x in s), np.uint64) for s in sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, sizes, first, second = nc.fingerprints(row, run)
    block = np.arange(len(sets)) % 2
    high, low = nc.gray_rank(first, second)
    order = np.lexsort((low, high, block))
    i, j, _ = nc.GrayIndex(block[order], sizes[order].astype(np.int64), first[order], second[order]).pairs(threshold)
    found = {frozenset((order[a], order[b])) for a, b in zip(i, j, strict=True)}
    assert all(block[a] == block[b] for a, b in map(tuple, found))
    for a in range(len(sets)):
        for b in range(a):
            if block[a] == block[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                assert frozenset((a, b)) in found


def test_gray_rank_is_an_order_of_neighbours():
    """Fingerprints in rank order are the Gray code: each differs from the next in one bit."""
    codes = np.arange(256, dtype=np.uint64)
    high, low = nc.gray_rank(np.zeros(256, np.uint64), codes)
    ordered = codes[np.lexsort((low, high))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_components(spark):
    links = [(k + 1, k) for k in range(50)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 51)}, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
