import json

import pandas as pd
from pyspark.sql import functions as F

from seedloom import session
from seedloom.operators import keyed
from seedloom.operators.batches import seed_prompts, written_seeds
from seedloom.operators.providers import BatchProvider
from seedloom.sources import seeds, sinks

EXAMPLE = "example_id long, file string, task_kind string, polarity string, input string, output string, explanation string"


def test_instruction_files_round_trip(spark, tmp_path):
    rows = [(i, "f" if i % 2 else None, "Multiple Selection" if i % 3 else "Question answering", "positive" if i % 5 else "negative", f'in "{i}"\n', "é", None if i % 7 else "why") for i in range(60)]
    df = spark.createDataFrame(rows, EXAMPLE)
    definitions = spark.createDataFrame([("f", "Multiple Selection", "choose"), (None, "Question answering", "answer")], "file string, task_kind string, definition string")
    sinks.write_instruction_files(sinks.file_documents(df, definitions, 20), str(tmp_path / "out"))
    documents = [json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.txt")]
    assert len(documents) == 6 and all(isinstance(d, list) and len(d) == 2 for d in documents)
    tasks = seeds.read_tasks(spark, str(tmp_path / "out"))
    assert {(r["file"], r["Definition"]) for r in tasks.collect()} == {("f", "choose"), ("f", ""), ("", "answer"), ("", "")}
    back = sorted((r["file"], r["task_kind"], p, r["input"], r["explanation"] or "") for p in ("Positive Example", "Negative Example") for r in seeds.task_seeds(tasks, p).collect())
    assert back == sorted((r[1] or "", r[2], f"{r[3].title()} Example", r[4], r[6] or "") for r in rows)


def test_files_and_fragments(spark, tmp_path):
    task = {"Instruction information": {"Categories": "Question answering"}, "Definition": "d", "Positive Example": [{"Input": "i", "Output": "o", "Explanation": "e"}], "Negative Example": []}
    for name in ("one", "two_generated"):
        (tmp_path / f"{name}.json").write_text(json.dumps([task, task], indent=4))
    got = seeds.read_tasks(spark, [str(tmp_path / f"{n}.json") for n in ("one", "two_generated")])
    assert sorted(r["file"] for r in got.collect()) == ["one", "one", "two", "two"]
    assert seeds.task_seeds(got).count() == 4 and seeds.task_seeds(got, "Negative Example").count() == 0
    (tmp_path / "f.txt").write_text('{"Input": "a", "Output": "b"},\n{"Input": "c", "Output": "d", "Explanation": "e"},\n')
    rows = seeds.read_fragments(spark, str(tmp_path / "f.txt")).orderBy("seed_ord").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "b", None), (1, "c", "d", "e")]
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 0.5}, {"step": 2}]}, indent=2))
    assert seeds.read_trainer_state(spark, str(tmp_path / "state.json")).first()["log_history"][0]["loss"] == 0.5


def test_config_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"r": 64, "bias": "none", "targets": ["q", "v"], "path": None}, indent=2))
    got = seeds.read_config(spark, str(tmp_path / "c.json"))
    seeds.write_config(got, str(tmp_path / "out"))
    again = seeds.read_config(spark, str(tmp_path / "out"))
    assert [r["config"] for r in again.collect()] == [r["config"] for r in got.collect()] and again.first()["config"]["r"] == "64"


def test_providers_know_the_site(spark):
    df = spark.createDataFrame([("f", "https://a", "x"), ("g", None, "x"), ("g", None, None)], "file string, website string, text string")

    def make():
        return lambda batch: [None if t is None else f"{s}|{o}|{d}|{t}" for o, d, s, t in zip(batch["op"], batch["draw"], batch["site"], batch["text"], strict=True)]

    got = BatchProvider(make).fill(df, "out", "paraphrase", F.lit(1), F.col("text"), key=("file",))
    assert sorted(r["out"] or "" for r in got.collect()) == ["", "None|paraphrase|1|x", "https://a|paraphrase|1|x"]
    assert got.columns == ["file", "website", "text", "out"]
    assert "req_id" not in BatchProvider(lambda: lambda b: list(pd.Series(b["text"]))).fill(df.drop("website"), "out", "paraphrase", F.lit(1), F.col("text")).columns


def test_seed_prompts_and_answers(spark):
    rows = spark.createDataFrame([("f", k, f"i{k} {{wanted}}", "o", None) for k in range(3)], "file string, seed_ord long, input string, output string, explanation string")
    sites = spark.createDataFrame([("f", "https://a"), ("g", "https://b")], "file string, website string")
    got = {r["file"]: r["prompt"] for r in seed_prompts(rows, sites, template="{website} [{examples}] {wanted}").collect()}
    shown, wanted = got["f"].removeprefix("https://a ").rsplit(" ", 1)
    assert [x["Input"] for x in json.loads(shown)] == ["i0 {wanted}", "i1 {wanted}"] and wanted == "10" and got["g"] == "https://b [] 10"
    answers = spark.createDataFrame([(1, '[{"Input": "a", "Output": "b"}, ]'), (2, "no"), (3, None), (4, '{"Input": "c"},{"Output": "d"}')], "id long, answer string")
    assert sorted(tuple(r) for r in written_seeds(answers, "answer", "id").where("input is not null or output is not null").collect()) == [(1, 0, "a", "b", None), (4, 0, "c", None, None), (4, 1, None, "d", None)]


def test_one_per_id(spark):
    rows = [(1, None, "late"), (1, "2024-01-01", "x"), (2, "2024-01-01", None), (2, "2024-01-02", "y"), (3, "2024-01-01", "b"), (3, "2024-01-01", "a")]
    df = spark.createDataFrame(rows, "id long, at string, t string")
    got = {r["id"]: r["t"] for r in keyed.one_per_id(df, "id", F.col("at"), keyed.content_hash(F.col("t")), {"t": F.col("t")}).collect()}
    assert got == {1: "late", 2: None, 3: "a"}  # md5 of a is the smaller one


def test_cut_tables_go(spark):
    table = session.cut(spark.range(3), "gone")
    assert table.count() == 3 and session.clear_cuts(spark) >= 1 and session.clear_cuts(spark) == 0


def test_spread_looks_at_the_plan(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    joined = one.join(F.broadcast(spark.range(5)), "id")
    assert session.spread(joined).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
