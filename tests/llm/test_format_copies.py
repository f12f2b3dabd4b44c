import random
import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.llm import format_copies as fc
from seedloom.llm.common import join_counted

SCHEMA = "example_id long, polarity string, input string, output string, explanation string, loaded_at timestamp, low long"


def brute(rows):
    word = re.compile(r"[^\W_]+")

    def of(text, parts=False):
        if text is None:
            return None
        w = word.findall(text.lower())
        if parts and w and w[0] == "question" and "fact" in w:
            at = w.index("fact")
            w = w[at:] + w[:at]
        return tuple(w)

    groups = defaultdict(set)
    for i, polarity, a, b, c, *_ in rows:
        if i is not None and polarity == "positive":
            groups[of(a, True), of(b), of(c)].add(i)
    return groups


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    groups = brute(rows)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted(map(tuple, fc.example_copies(df).collect())) == want
    got = fc.collapse(fc.positive_rows(df), "example_id", ["input", "output", "explanation"], "input", "loaded_at")
    assert sorted(map(tuple, got.collect())) == sorted((min(g), len(g)) for g in groups.values())


def test_edge_cases(spark):
    long = "Word " * 60_000
    rows = [
        (1, "positive", "Fact: A b. Question: c?", "X y", None),
        (2, "positive", "question - c\n FACT a  B", "x, Y!", None),
        (3, "positive", "Fact: A b. Question: c?", "X y", ""),
        (4, "positive", None, None, None),
        (5, "positive", None, None, None),
        (6, "positive", "", "...", "--"),
        (7, "positive", " ", "", ""),
        (8, "positive", long, "a", "b"),
        (9, "positive", long.upper(), "A", "B."),
        (10, "negative", None, None, None),
        (None, "positive", None, None, None),
        (2, "positive", "question - c\n FACT a  B", "x, Y!", None),
        (11, "positive", "Été ünï", "ß", "Ω 1²"),
        (12, "positive", "été ÜNÏ", "ß", "ω 1²"),
    ]
    check(spark, [(*r, None, 0) for r in rows])
    assert fc.example_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_rows_and_a_hot_content(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        text = "Fact: the same record Question: who" if i % 3 == 0 else f"Fact: {rng.choice('abc')} {rng.randrange(400)} Question: who"
        if rng.random() < 0.5:
            text = text.upper().replace(" ", "  ")
        rows.append((i, "positive", text, "out", None, None, 0))
    monkeypatch.setattr(fc, "FITS", 40)
    check(spark, rows)


def test_hot_keys_are_broadcast(spark, monkeypatch):
    import seedloom.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    keyed = rows.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    got = join_counted(rows, keyed, "k", "n", 1000)
    assert sorted(got.columns) == ["id", "k", "low"]
    assert got.count() == 1000 and got.where("k = 'hot' and low = 0").count() == 334


@given(st.lists(st.binary(max_size=40) | st.sampled_from([b"", b"a" * 16, b"a" * 17, b"a" * 32, b"a" * 33]), max_size=40))
def test_trie_counts(keys):
    trie = fc.Trie()
    want = {}
    for i, k in enumerate(keys):
        trie.add(k, i, 1)
        low, n = want.get(k, (i, 0))
        want[k] = (low, n + 1)
    assert {k: (low, n) for k, low, n in trie.counts()} == want and trie.bytes == sum(len(k) + fc.NODE for k in want)


def test_buckets_fit_or_hold_one_content(spark, monkeypatch):
    monkeypatch.setattr(fc, "FITS", 10)
    rows = spark.createDataFrame([(f"shared prefix of all {i % 300:05d}".encode(),) for i in range(600)], "canon binary")
    sizes = rows.groupBy(fc.radix_bucket(rows, 64, 600).alias("b")).agg(F.count("*").alias("n"), F.countDistinct("canon").alias("d"))
    assert sizes.where("n > 10 and d > 1").count() == 0 and sizes.agg(F.sum("n")).first()[0] == 600
