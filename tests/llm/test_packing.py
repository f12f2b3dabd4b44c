import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.llm import packing
from seedloom.llm.tokens import token_sizes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=60))
def test_search_keeps_items_and_never_gets_worse(values):
    sizes = np.array(values, np.int64)
    start = packing.best_fit(sizes, 100)
    before = sorted(i for b in start for i in b)
    got = packing.improve([list(b) for b in start], sizes, 100)
    assert sorted(i for b in got for i in b) == before == list(range(len(values)))
    assert all(sizes[b].sum() <= 100 for b in got) and len(got) <= len(start)
    squares = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert squares(got) >= squares(start)


def test_swaps_fill_what_best_fit_leaves():
    sizes = np.array([60, 50, 30, 30, 30], np.int64)
    start = [[0, 2], [1, 3], [4]]
    got = packing.improve(start, sizes, 110)
    assert sorted(int(sizes[b].sum()) for b in got) == [90, 110]


def test_search_ends_at_the_fewest_or_where_nothing_grows():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 180, 400)
    got = packing.improve(packing.best_fit(sizes, 512), sizes, 512)
    assert packing.fewest(sizes, 512) <= len(got) <= packing.fewest(sizes, 512) + 1
    # a container of many items: pairs are listed by size, not one by one
    many = rng.integers(1, 9, 20_000)
    total, first, second = packing._options(list(range(20_000)), many)
    assert len(total) < 30 and all(t == (many[i] if i >= 0 else 0) + (many[j] if j >= 0 else 0) and (i != j or i < 0) for t, i, j in zip(total, first, second, strict=True))


def test_check_tells_what_is_wrong(spark):
    rows = [("s", 1, 0, 60, "a", 110, -10), ("s", 2, 0, 50, "a", 110, -10), ("s", 3, 1, 5, "b", 6, 94), ("s", 4, 0, 1, "c", 2, 98), ("s", 4, 0, 1, "c", 2, 98)]
    placed = spark.createDataFrame(rows, "spec_name string, doc_id long, piece int, tokens long, container string, filled long, unused long")
    assert packing.check(placed, "doc_id").first().asDict() == {"spec_name": "s", "documents": 4, "torn": 2, "over": 1, "misfilled": 1}


def data(spark, n=1200):
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.choice([rng.randrange(1, 60), rng.randrange(1, 300), 700]))) for i in range(n)] + [(n, None), (n + 1, ""), (None, "x"), (3, "word word word"), (n + 2, "long " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, tokens int, capacity int")
    specs = spark.createDataFrame([("small", 128), ("large", 1024), ("none", 0), (None, 5), ("void", None), ("small", 64)], "spec_name string, capacity_tokens int")
    return docs, specs


def test_placement(spark):
    docs, specs = data(spark)
    placed = packing.pack(docs, "doc_id", "text", specs, block=200).cache()
    assert {r["spec_name"] for r in placed.select("spec_name").distinct().collect()} == {"small", "large"}
    sizes = {r["id"]: r["tokens"] for r in token_sizes(docs, "doc_id", "text").collect()}
    got = placed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    capacity = {"small": 128, "large": 1024}
    assert len(got) == 2 * len(sizes)
    for r in got:
        assert r["t"] == sizes[r["doc_id"]] and r["n"] == max(1, -(-r["t"] // capacity[r["spec_name"]]))
    bins = placed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("t"), F.max("filled").alias("f"), F.max("unused").alias("u"), F.max("doc_id").alias("d")).collect()
    assert all(r["t"] == r["f"] and r["f"] + r["u"] == capacity[r["spec_name"]] for r in bins)
    total = packing.room(placed).collect()
    for r in total:
        # no container holds two items that are larger than half of it
        halves = placed.where((F.col("spec_name") == r["spec_name"]) & (F.col("tokens") * 2 > capacity[r["spec_name"]])).count()
        assert r["containers"] <= 1.03 * max(r["fewest"], halves) + 1


def test_same_result_however_rows_lie(spark):
    docs, specs = data(spark, 300)
    runs = [sorted(map(tuple, packing.pack(docs.repartition(n), "doc_id", "text", specs, block=100).select("spec_name", "doc_id", "piece", "tokens").collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_empty(spark):
    docs, specs = data(spark, 10)
    assert packing.pack(docs.limit(0), "doc_id", "text", specs).count() == 0
    assert packing.pack(docs, "doc_id", "text", specs.limit(0)).count() == 0
    nothing = docs.where("text is null or text = ''")
    got = packing.pack(nothing, "doc_id", "text", specs).collect()
    assert len(got) == 2 and all(r["tokens"] == 0 for r in got)
