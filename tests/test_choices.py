import math

from pyspark.sql import functions as F

from seedloom.operators import batches, ranking
from seedloom.operators.keyed import exact_holdout, key_hash, numbered


def test_holdout_is_exact_and_stable(spark):
    df = spark.range(9240).withColumnRenamed("id", "k")
    got = exact_holdout(df, ["k"], 0.2)
    test = {r["k"] for r in got.where("split = 'test'").collect()}
    assert len(test) == 1848 and got.count() == 9240
    assert {r["k"] for r in exact_holdout(df.repartition(13), ["k"], 0.2).where("split = 'test'").collect()} == test
    ranked = sorted(df.select("k", key_hash(0, F.col("k")).alias("h")).collect(), key=lambda r: r["h"])
    assert {r["k"] for r in ranked[:1848]} == test


def test_holdout_edges(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 3)
    assert exact_holdout(df.limit(0), ["id"], 0.2).count() == 0
    assert exact_holdout(df, ["id"], 0.0).where("split = 'test'").count() == 0
    assert exact_holdout(df, ["id"], 1.0).where("split = 'test'").count() == 10
    assert exact_holdout(df, ["id"], 0.25).where("split = 'test'").count() == math.ceil(2.5)
    groups = exact_holdout(df, ["id"], 0.2, group=["g"]).select("g", "split").distinct()
    assert groups.groupBy("g").count().where("count > 1").count() == 0
    same = spark.createDataFrame([(1,)] * 5, "id long")
    assert exact_holdout(same, ["id"], 0.2).where("split = 'test'").count() == 5


def test_numbers(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = numbered(df, ["k", "id"]).orderBy("k", "id").collect()
    assert [r["row_index"] for r in got] == list(range(1000))


def test_batches(spark):
    got = batches.batched_head(spark.range(100), ["id"], 10, 4)
    assert [r["n"] for r in got.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [4, 4, 2]


def test_top_letters(spark):
    nan = float("nan")
    rows = [([0.1, 0.4, 0.3, 0.2],), ([1.0, 1.0, 1.0, 1.0],), ([0.0, nan, 2.0, 1.0],), (None,), ([1.0, None, 2.0, 3.0],), ([5.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<float>").select(ranking.top_letters(F.col("s"))).collect()]
    assert got == ["B C D", "D C B", "B C D", None, "D C A", "A D C"]
    logits = spark.createDataFrame([([0.5, 1.5, 2.5],)], "l array<double>")
    assert logits.select(ranking.gather(F.col("l"), [2, 0])).first()[0] == [2.5, 0.5]
