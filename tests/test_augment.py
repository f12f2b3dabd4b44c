import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom.operators import augment, mcq, prompts, qa
from seedloom.operators.providers import BatchProvider, RuleProvider, stub_batch
from seedloom.sources import seeds, sinks

N = 12


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    """An instruction file of the usual size, read through the file reader."""
    folder = tmp_path_factory.mktemp("files")
    mc = [{"Input": f"Question {i}? (A) a{i} (B)b{i} (C)c{i} (D)d{i}", "Output": "ABCD"[i % 4], "Explanation": f"because {i}"} for i in range(N)]
    fact = [{"Input": f"Fact: Thing {i} is here. Question:  Where is thing {i}?", "Output": f"here {i}", "Explanation": "undefined"} for i in range(N)]
    tasks = [{"Instruction information": {"Categories": k}, "Definition": "d", "Positive Example": p, "Negative Example": []} for k, p in (("Multiple Selection", mc), ("Question answering", fact))]
    (folder / "demo_instructions.json").write_text(json.dumps(tasks, indent=4))
    rows = seeds.task_seeds(seeds.read_tasks(spark, str(folder)))
    assert rows.count() == 2 * N and rows.first()["file"] == "demo_instructions"
    return mcq.valid(mcq.parse(rows.where("task_kind = 'Multiple Selection'"))), mcq.valid(qa.parse(rows.where("task_kind = 'Question answering'")))


def test_golden_counts(parsed):
    got = {tuple(r)[:3]: r["count"] for r in augment.augment(*parsed, RuleProvider()).groupBy("task_kind", "polarity", "branch").count().collect()}
    per = {"M0": 1, "M1": 2, "M2": 10, "M3": 20, "M4": 20, "M5": 40, "Q0": 1, "Q1": 10, "Q2": 20, "Q3": 10, "Q4": 20}
    assert {k[2]: n for k, n in got.items()} == {b: N * n for b, n in per.items()}
    assert sum(got.values()) == 1848


def test_order_has_no_gap(parsed):
    rows = augment.augment(*parsed, RuleProvider()).withColumn("ord", augment.array_position(F.lit(N)))
    for r in rows.groupBy("task_kind", "polarity").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).collect():
        assert r["n"] == r["d"] == r["hi"] + 1 and r["lo"] == 0


def test_branch_details(parsed):
    rows = {(r["branch"], r["seed_ord"], r["variant"], r["shuffle"], r["neg_slot"]): r for r in augment.augment(*parsed, RuleProvider()).collect()}
    m2 = rows["M2", 0, 3, None, None]
    assert m2["input"] == "p3: Question 0?  (A) a0 (B)b0 (C)c0 (D)d0"
    assert m2["explanation"] == "x2: because 0" and m2["output"] == "A"
    m4 = rows["M4", 0, 3, 1, None]
    assert m4["explanation"] == "x1: because 0" and m4["input"].startswith("p3: Question 0?  (A)")
    assert f"({m4['output']})a0" in m4["input"]
    m3 = rows["M3", 0, 3, None, 1]
    assert m3["input"] == "Question 0? (A) a0 (B)b0 (C)c0 (D)d0" and m3["explanation"] == "because 0" and m3["output"] != "A"
    m5 = rows["M5", 0, 3, 1, 0]
    assert m5["input"] == m4["input"] and m5["output"] != m4["output"]
    assert m5["explanation"] == f"The correct answer is: {m4['output']}. x0: x1: because 0"
    assert rows["Q1", 0, 2, None, None]["input"] == "Fact: Thing 0 is here.  Question: p2:   Where is thing 0?"
    assert rows["Q3", 0, 2, None, None]["input"] == "Fact: s2: Thing 0 is here. Question:   Where is thing 0?"
    assert rows["Q2", 0, 2, None, 1]["explanation"] == "The correct answer is: here 0. x1: undefined"
    assert rows["Q4", 0, 2, None, 1]["explanation"] == "The correct answer is: here 0. x1: x0: undefined"


def test_batch_provider_agrees_with_rule(parsed):
    rule = augment.augment(*parsed, RuleProvider())
    model = augment.augment(*parsed, BatchProvider(lambda: stub_batch))
    key = ["branch", "seed_ord", "variant", "shuffle", "neg_slot", "input", "output", "explanation"]
    sort = lambda df: sorted(map(repr, df.select(*key).collect()))
    assert sort(rule) == sort(model)


def test_repartitioning_changes_nothing(parsed):
    key = ["branch", "seed_ord", "variant", "shuffle", "neg_slot", "input", "output", "explanation"]
    results = []
    for n in (1, 4, 16):
        a, b = (x.orderBy(F.desc("seed_ord")).repartition(n) for x in parsed)
        results.append(sorted(map(repr, augment.augment(a, b, RuleProvider()).select(*key).collect())))
    assert results[0] == results[1] == results[2]


def test_paraphrased_negatives(parsed):
    got = augment.multiple_choice(parsed[0], RuleProvider(), negatives_from="paraphrase")[1].where("branch = 'M3' and seed_ord = 0 and variant = 1").first()
    assert got["input"].startswith("p1: Question 0?")


def test_prompts(spark):
    rows = [("m", "positive", "i", "o", "e"), ("m", "negative", "i", "o", None), ("m", "positive", None, "o", "e")]
    df = spark.createDataFrame(rows, "task_kind string, polarity string, input string, output string, explanation string")
    got = [r["prompt"] for r in prompts.corpus(df).orderBy("polarity_ord").collect()]
    assert got == ["i\nThe answer to the question is:\no\nThe reason for the answer is: e", "i\nThe answer to the question is definitely not the following:\no\nThe reason for it's not the answer is: undefined"]


def test_fragments(spark, tmp_path):
    path = tmp_path / "example.txt"
    path.write_text('{"Input": "a", "Output": "b", "Explanation": "undefined"},\n\n{"Input": "c"},\n')
    assert [tuple(r) for r in seeds.read_fragments(spark, str(path)).collect()] == [(0, "a", "b", "undefined"), (1, "c", None, None)]


def test_sinks(spark, tmp_path):
    schema = "example_id long, file string, task_kind string, polarity string, input string, output string, explanation string"
    rows = [(2, "f", "t", "positive", "b", "x", None), (1, "f", "t", "positive", "a", "x", "é"), (1001, "f", "t", "negative", "c", "y", "z"), (3, None, "t", "negative", "d", "y", "z")]
    df = spark.createDataFrame(rows, schema)
    docs = sinks.nested_documents(df)
    first = json.loads(docs.where("file = 'f' and part = 0").first()["document"])
    assert [e["Input"] for e in first["Positive Example"]] == ["a", "b"] and first["Negative Example"] == []
    sinks.write_documents(docs, str(tmp_path / "docs"))
    sinks.write_examples(df, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4
    assert spark.read.text(str(tmp_path / "docs")).count() == 3


def test_configuration_and_logs(spark, tmp_path):
    (tmp_path / "adapter_config.json").write_text('{"r": 64, "bias": "none", "target_modules": ["query", "value"]}')
    (tmp_path / "trainer_state.json").write_text('{"log_history": [{"step": 10, "loss": 0.5}, {"step": 20}], "other": 1}')
    config = seeds.read_config(spark, str(tmp_path / "adapter_config.json")).first()["config"]
    assert config["r"] == "64" and json.loads(config["target_modules"]) == ["query", "value"]
    from seedloom.operators.metrics import loss_series

    assert [tuple(r) for r in loss_series(seeds.read_trainer_state(spark, str(tmp_path / "trainer_state.json"))).collect()] == [(10, 0.5), (20, None)]


def test_stub_batch():
    assert stub_batch(pd.DataFrame({"op": ["paraphrase"], "draw": [1], "text": ["t"]})) == ["p1: t"]
