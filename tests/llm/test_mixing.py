import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.llm import mixing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=80), st.floats(0.05, 0.95), st.integers(0, 9))
def test_flight_keeps_both_totals(tokens, share, seed):
    t, p = np.array(tokens, float), np.full(len(tokens), share)
    q = mixing.fly(p, t, np.random.default_rng(seed))
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ t - p @ t) < 1e-4 * max(1, p @ t)
    # two are left, or more of one size
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    landed = mixing.land(q, t, float(p @ t))
    assert set(landed) <= {0.0, 1.0}


def test_flight_is_unbiased():
    t = np.array([10.0, 20.0, 30.0, 40.0, 50.0, 60.0])
    p = np.full(6, 0.4)
    mean = np.mean([mixing.fly(p, t, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def data(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("big", 1500), ("mid", 400), ("tiny", 20)):
        rows += [(len(rows) + k, source, " ".join(["word"] * rng.randrange(5, 60))) for k in range(n)]
    rows += [(9000, None, "word"), (9001, "big", None), (9002, "big", ""), (None, "big", "word")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, source string, text string, tokens int, p int")
    targets = [("even", "big", 0.5, 4), ("even", "mid", 0.3, 4), ("even", "tiny", 0.2, 8), ("gap", "big", 0.5, 1), ("gap", "absent", 0.5, 3), ("odd", None, 0.5, 1), (None, "big", 1.0, 1), ("zero", "big", 0.0, 1)]
    return docs, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")


@pytest.mark.parametrize("block", [10_000, 300])
def test_shares(spark, block):
    docs, targets = data(spark)
    chosen, shares = mixing.mix(docs, "doc_id", "text", "source", targets, block=block)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert set(got) == {("even", "big"), ("even", "mid"), ("even", "tiny"), ("gap", "big"), ("gap", "absent")}
    for (name, _), r in got.items():
        if name == "even":
            assert abs(r["actual_share"] - r["target_share"]) < 0.005
    assert got["gap", "absent"]["tokens"] == 0 and got["gap", "big"]["actual_share"] == 1.0
    limits = chosen.join(targets, ["mix_name", "source"])
    assert limits.where("uses > max_repeats or uses < 1").count() == 0
    assert chosen.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0
    assert chosen.where("doc_id >= 9000").count() == 0
    sums = {(r["mix_name"], r["source"]): r["t"] for r in chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).collect()}
    assert all(sums.get(k, 0) == r["tokens"] for k, r in got.items())


def test_aim(spark):
    """A source that is too small for a total asked for gives what it may, and its lower share is reported."""
    docs, targets = data(spark)
    chosen, shares = mixing.mix(docs, "doc_id", "text", "source", targets.where("mix_name = 'even'"), aim=40_000)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["tokens"] - 20_000) < 60 and abs(got["mid"]["tokens"] - 12_000) < 60
    tiny = docs.where("source = 'tiny'").count()
    assert got["tiny"]["uses"] == 8 * tiny and got["tiny"]["actual_share"] < 0.2 - 0.01
    checked = mixing.check(chosen, shares, docs, "doc_id", "source", 0.001).collect()
    assert all(not (r["over"] or r["twice"] or r["foreign"]) for r in checked) and not all(r["met"] for r in checked)


def test_landing_may_change_the_number_of_documents():
    tokens = np.array([1000.0, 900.0, 10.0, 10.0, 10.0])
    assert mixing.land(np.array([1.0, 0.0, 0.0, 0.0, 0.0]), tokens, 920.0) @ tokens == 920


def test_same_choice_however_rows_lie(spark):
    docs, targets = data(spark)
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n), "doc_id", "text", "source", targets)[0].collect())) for n in (1, 6)]
    assert runs[0] == runs[1]


def test_empty(spark):
    docs, targets = data(spark)
    chosen, shares = mixing.mix(docs.limit(0), "doc_id", "text", "source", targets)
    assert chosen.count() == 0 and all(r["actual_share"] == 0 for r in shares.collect())
    chosen, shares = mixing.mix(docs, "doc_id", "text", "source", targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0
