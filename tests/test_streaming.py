from pyspark.sql import functions as F

from seedloom.streaming import prompts as stream

SCHEMA = "example_id long, file string, task_kind string, polarity string, input string, output string, explanation string, loaded_at timestamp"


def test_each_example_once(spark, tmp_path):
    rows = [(i % 50, "f", "m", "positive", f"i{i % 50}", "o", None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("loaded_at", F.timestamp_seconds(F.col("example_id") * 60 + 1_700_000_000))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    examples = stream.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    query = stream.write_stream(stream.prompt_stream(examples), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("example_id").distinct().count() == 50
    query = stream.write_stream(stream.arrivals(examples, "1 hour", "1 minute"), str(tmp_path / "n"), str(tmp_path / "state2"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "n"))
    # all rows lie in the hours before the last; each hour is out once, with all that was read before the watermark passed
    assert got.groupBy("window").count().where("count > 1").count() == 0


def test_arrivals_equal_a_batch(spark):
    rows = [(i, "f" if i % 3 else "g", "m", "positive" if i % 2 else "negative", "i", "o", None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("loaded_at", F.timestamp_seconds(F.col("example_id") * 600 + 1_700_000_000))
    got = {(r["window"]["start"], r["file"], r["polarity"]): r["n"] for r in stream.arrivals(df, "1 hour").collect()}
    want = {}
    for r in df.collect():
        key = (r["loaded_at"].replace(minute=0, second=0), r["file"], r["polarity"])
        want[key] = want.get(key, 0) + 1
    assert got == want
