import json

import numpy as np
from pyspark.sql import functions as F

from seedloom.operators import retrieval
from seedloom.sources import crawl


def test_pages(spark):
    rows = [(1, "u", None, "2024-01-01"), (1, "u", "later", "2024-01-02"), (2, "v", "", "2024-01-01"), (None, "w", "x", "2024-01-01")]
    df = spark.createDataFrame(rows, "page_id long, url string, text string, at string").withColumn("crawled_at", F.to_timestamp("at")).withColumn("file", F.lit("f"))
    got = {r["page_id"]: (r["page_content"], r["metadata"]) for r in retrieval.page_documents(retrieval.latest_pages(df)).collect()}
    assert got == {1: ("later", {"source": "u"}), 2: ("", {"source": "v"})}


def test_fixed_chunks(spark):
    texts = ["a" * 10, "a" * 21, "", None, "𝔸" * 11]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.fixed_chunks("t", 10).alias("c"))
    for r in df.collect():
        t = r["t"] or ""
        assert r["c"] == [t[i : i + 10] for i in range(0, len(t), 10)]


def test_recursive_chunks(spark):
    text = "para one is here\n\n" + "word " * 30 + "\n\n" + "x" * 60 + "\nline"
    got = retrieval.recursive_chunks(text, 25)
    assert all(len(c) <= 25 and c == c.strip() and c for c in got)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert got[0] == "para one is here" and got[-1] == "line"
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, "y" * 50_000)], "id long, t string")
    rows = retrieval.chunks(df, "id", "t").collect()
    assert len(rows) == 51 and {r["id"] for r in rows} == {1, 4}


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = [[float(x) for x in rng.normal(size=8)] for _ in range(300)]
    vectors[10] = vectors[20]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    base = df.repartition(5)
    for block, cell in ((1000, 0), (8, 1 << 24), (8, 400)):
        got = retrieval.vector_topk(base, df.where("id % 10 = 0"), "id", "v", 4, block, cell=cell).collect()
        m = np.array(vectors, np.float32).astype(float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for q in range(0, 300, 10):
            s = np.round(m @ m[q], 9)
            want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:4]
            assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert retrieval.vector_topk(base, df.limit(0), "id", "v").count() == 0


def test_ties_go_to_the_smaller_key(spark):
    rows = [(i // 7, i % 7, [1.0, 0.0] if i % 2 else [2.0, 0.0]) for i in range(70)]
    base = spark.createDataFrame(rows, "page long, part int, v array<float>").repartition(6)
    asks = spark.createDataFrame([(n, [3.0, 0.0]) for n in range(5)], "page long, v array<float>")
    for block in (100, 2):
        got = retrieval.vector_topk(base, asks, "page", "v", 3, block, key=["page", "part"]).collect()
        for n in range(5):
            want = [(p, k) for p in range(10) if p != n for k in range(7)][:3]
            assert [(r["page"], r["part"]) for r in sorted((r for r in got if r["query_id"] == n), key=lambda r: r["rank"])] == want


def test_contexts(spark):
    rows = [(0, "red barges on the river"), (1, "red barges on the river today"), (2, "green fields"), (3, None), (100, "green fields far away")]
    df = spark.createDataFrame(rows, "page_id long, text string")
    got = {r["page_id"]: r for r in retrieval.contexts(df, F.col("page_id") % 100 == 0, k=1).collect()}
    assert got[0]["context"] == "red barges on the river today" and got[100]["context"] == "green fields"
    assert got[0]["prompt"].endswith("Question: red barges on the river\nAnswer:")


def test_contexts_of_a_long_page(spark):
    """All chunks of the page that asks are more like it than any other page's."""
    long = "\n\n".join(f"red barges on the river {n}" for n in range(20))
    df = spark.createDataFrame([(0, long), (1, "red barges"), (2, "green fields"), (3, "the river")], "page_id long, text string")
    for k in (1, 3):
        got = retrieval.contexts(df, F.col("page_id") == 0, k=k, width=30).collect()
        assert len(got) == 1 and len(got[0]["context"].split("\n\n")) == k and "river 1" not in got[0]["context"]


def test_crawl_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"url": f"u{n}{k}", "text": None if k else "t"}) + "\n" for k in range(2)))
    crawl.register(spark)
    got = spark.read.format("crawl").option("startUrls", json.dumps([str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl")])).load()
    assert sorted(map(tuple, got.collect()), key=str) == [("u10", "t"), ("u11", None), ("u20", "t"), ("u21", None)]
