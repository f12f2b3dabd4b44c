import hashlib
import time
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.functions.text import python_tokens
from seedloom.operators import metrics, vectors

PAIRS = [(1, "The cat sat on the mat", "the cat is on the mat"), (2, None, "a"), (3, "", ""), (4, "a b a b", "b a b a"), (5, "x.\ny z", "x y\nz"), (6, "Éa b", "b")]


def slow_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


words = st.lists(st.sampled_from("abcd"), max_size=12)


@given(words, words)
def test_lcs(a, b):
    assert metrics.lcs_length(a, b) == slow_lcs(a, b)
    at = sorted(metrics._lcs_positions(a, b))
    assert len(at) == slow_lcs(a, b) and slow_lcs([a[i] for i in at], b) == len(at)


def test_long_lines_of_rouge():
    rng = np.random.default_rng(0)
    a, b = (" ".join(f"w{k}" for k in rng.integers(0, 500, 5000)) for _ in range(2))
    began = time.perf_counter()
    assert 0 < metrics.rouge_l_sum(a, b) < 1 and metrics.rouge_l_sum(a, a) == 1
    assert time.perf_counter() - began < 10


def test_rouge(spark):
    df = spark.createDataFrame(PAIRS, "id long, p string, r string")
    got = {r["id"]: r for r in metrics.rouge(df, "id", "p", "r").collect()}
    assert abs(got[1]["rouge1"] - 10 / 12) < 1e-9 and abs(got[1]["rouge2"] - 6 / 10) < 1e-9 and abs(got[1]["rougeL"] - 10 / 12) < 1e-9
    assert got[2]["rouge1"] == got[3]["rougeL"] == got[3]["rougeLsum"] == 0
    assert abs(got[4]["rougeL"] - 6 / 8) < 1e-9
    assert got[5]["rougeLsum"] == 1.0
    # ids may be repeated
    assert metrics.rouge(df.union(df), "id", "p", "r").count() == 2 * len(PAIRS)
    assert metrics.rouge(df.limit(0), "id", "p", "r").count() == 0


def test_bertscore(spark):
    df = spark.createDataFrame(PAIRS, "id long, p string, r string")
    got = {r["id"]: r for r in metrics.bertscore(df, "id", "p", "r").collect()}
    a, b = ([v / np.linalg.norm(v) for v in map(metrics.hashed_embedding, python_tokens(x))] for x in PAIRS[0][1:])
    precision = np.mean([max(float(x @ y) for y in b) for x in a])
    recall = np.mean([max(float(x @ y) for x in a) for y in b])
    assert abs(got[1]["f1"] - 2 * precision * recall / (precision + recall)) < 1e-9
    assert got[2]["f1"] == got[3]["f1"] == 0
    assert metrics.bertscore(df.limit(0), "id", "p", "r").agg(F.avg("f1")).first()[0] is None


def test_bleu(spark):
    pairs = [("the cat sat on the mat today", "the cat sat on a mat today"), (None, "x"), ("a b c d e", "a b c d e")]
    df = spark.createDataFrame(pairs, "p string, r string")
    got = metrics.bleu(df, "p", "r").first()
    hits, totals = [6 + 5, 4 + 4, 2 + 3, 1 + 2], [7 + 5, 6 + 4, 5 + 3, 4 + 2]
    want = np.exp(np.mean(np.log(np.array(hits) / np.array(totals)))) * np.exp(1 - 13 / 12)
    assert abs(got["bleu"] - want) < 1e-12 and got["pairs"] == 3
    assert metrics.bleu(df.limit(0), "p", "r").first()["bleu"] is None
    assert metrics.bleu(df.where("p is null"), "p", "r").first()["bleu"] == 0


def test_fitted_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.permutation([f"{k}{n}" for n in range(80)])[:40])) for i, k in enumerate("abcabc" * 8)] + [(900, None), (901, ""), (902, "alone")]
    got = {r["token"]: np.array(r["vector"]) for r in vectors.fit_token_vectors(spark.createDataFrame(rows, "id long, t string").repartition(3), "t").collect()}
    counts = Counter(t for _, text in rows for t in python_tokens(text))
    want = {t: np.zeros(64) for t in counts}
    for _, text in rows:
        t = [x for x in python_tokens(text) if counts[x] * 100 <= counts.total()]
        for i, x in enumerate(t):
            v = want[x]
            for other in t[max(0, i - 3) : i] + t[i + 1 : i + 4]:
                h = hashlib.md5(other.encode()).hexdigest()
                for k in range(4):
                    v[int(h[3 * k : 3 * k + 2], 16) % 64] += 1 if h[3 * k + 2] >= "8" else -1
    assert got.keys() == want.keys() and all((got[t] == want[t]).all() for t in want)
    # tokens that keep the same company are more alike than others
    unit = {t: v / max(np.linalg.norm(v), 1e-9) for t, v in got.items()}
    alike = np.mean([unit["a1"] @ unit[f"a{n}"] for n in range(2, 20)])
    assert alike > np.mean([unit["a1"] @ unit[f"b{n}"] for n in range(2, 20)]) + 0.2
    each, whole = vectors.token_model(vectors.fit_token_vectors(spark.createDataFrame(rows, "id long, t string"), "t"))
    df = spark.createDataFrame([(1, "a1 a2", "a2 a1"), (2, "a1", "unheard"), (3, None, "a1")], "id long, p string, r string")
    scores = {r["id"]: r["f1"] for r in metrics.bertscore(df, "id", "p", "r", each).collect()}
    assert abs(scores[1] - 1) < 1e-9 and scores[2] == scores[3] == 0 and whole("a1 a2").shape == (64,)
    assert vectors.fit_token_vectors(spark.createDataFrame(rows, "id long, t string").limit(0), "t").count() == 0
