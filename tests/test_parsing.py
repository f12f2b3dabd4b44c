import pytest
from pyspark.sql import functions as F

from seedloom.functions.text import pieces, strip
from seedloom.operators import mcq, qa

SEED = "file string, task_kind string, seed_ord long, input string, output string, explanation string"


def mc_rows(spark, *pairs):
    return mcq.parse(spark.createDataFrame([("f", "m", i, p[0], p[1], "why") for i, p in enumerate(pairs)], SEED))


@pytest.mark.parametrize(
    ("text", "answer", "options", "reason"),
    [
        ("Where? (A)Norwick (B)St. Orb (C)Pellham (D)Vey", "C", ["Norwick", "St. Orb", "Pellham", "Vey"], None),
        ("What? (A) rope (B) TAR (C) PITCH (D) All kinds", "D", ["rope", "TAR", "PITCH", "All kinds"], None),
        ("no options", "A", None, "no (A)"),
        ("Q (A)x (B)y", "A", None, "fewer than four options"),
        ("Q (A)x (B)y (C)z (D)w (E)v", "A", ["x", "y", "z", "w"], None),
        ("Q (A)x (n) (B)y (C)z (D)w", "A", ["x", "", "y", "z"], None),
        ("Q (A)x (A)y (B)z (C)w (D)v", "A", None, "fewer than four options"),
        ("Q (A)x (B)y (C)z (D)w", "E", ["x", "y", "z", "w"], "answer outside A-D"),
        ("Q (A)x (B)y (C)z (D)w", "@", ["x", "y", "z", "w"], "answer outside A-D"),
        ("Q (A)x (B)y (C)z (D)w", None, ["x", "y", "z", "w"], "no output"),
        (None, "A", None, "no input"),
    ],
)
def test_multiple_choice(spark, text, answer, options, reason):
    r = mc_rows(spark, (text, answer)).first()
    assert (r["options"], r["reason"]) == (options, reason)
    if text == "Q (A)x (n) (B)y (C)z (D)w":
        assert r["labels_ok"] is False


def test_strict(spark):
    assert mcq.must_parse(mc_rows(spark, ("Q (A)x (B)y (C)z (D)w", "A"))).count() == 1
    with pytest.raises(Exception, match="no \\(A\\)"):
        mcq.must_parse(mc_rows(spark, ("nothing", "A"))).collect()


def test_shuffle_invariants(spark):
    rows = mcq.valid(mc_rows(spark, *[("Who keeps it? (A)x (B) y (C)z (D)w", "ABCD"[i % 4]) for i in range(40)], ("Q (A)same (B)same (C)z (D)w", "B")))
    before = {r["seed_ord"]: r for r in rows.collect()}
    turned = mcq.shuffled(rows, 3, F.col("seed_ord"))
    after = {r["seed_ord"]: r for r in turned.collect()}
    for k, r in after.items():
        assert sorted(r["options"]) == sorted(before[k]["options"])
        assert r["options"][r["answer_idx"]] == before[k]["options"][before[k]["answer_idx"]]
        assert r["output"] == "ABCD"[r["answer_idx"]] and r["head"] == before[k]["head"]
        assert r["input"] == r["head"] + " ".join(f"({c}){o}" for c, o in zip("ABCD", r["options"], strict=True))
    assert len({tuple(r["options"]) for r in after.values()}) > 5
    again = {r["seed_ord"]: r["input"] for r in mcq.shuffled(rows.repartition(3), 3, F.col("seed_ord")).collect()}
    assert again == {k: r["input"] for k, r in after.items()}


def test_wrong_letters(spark):
    df = spark.createDataFrame([(i, c) for i in range(30) for c in "ABCDE"], "i long, output string")
    got = df.withColumn("w", mcq.wrong_letters(F.col("output"), 0, F.col("i"))).collect()
    assert all(len(set(r["w"])) == 2 and r["output"] not in r["w"] and set(r["w"]) <= set("ABCD") for r in got)


@pytest.mark.parametrize(
    ("text", "fact", "question", "reason"),
    [
        ("Fact: a b. Question: who?", "a b.", " who?", None),
        ("Fact: a b. Question:  who?", "a b.", "  who?", None),
        ("Fact: a Question: b Question: c", "a", " b ", None),
        ("Seven letters Question: x", "letters", " x", None),
        ("Fact: only", None, None, "no Question:"),
        (None, None, None, "no input"),
    ],
)
def test_fact_questions(spark, text, fact, question, reason):
    r = qa.parse(spark.createDataFrame([("f", "q", 0, text, "o", "e")], SEED)).first()
    assert r["reason"] == reason and r["question"] == question
    if reason is None:
        assert r["fact"] == fact


def test_strip_and_split_match_python(spark):
    texts = ["  　x y\t\n", "", "\x1c a \x85", "a(A)b(A)", "(A)", "a (b (c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", strip("t").alias("s"), pieces("t", "(A)").alias("p"), pieces("t", " (").alias("q")).collect()
    for r in got:
        assert (r["s"], r["p"], r["q"]) == (r["t"].strip(), r["t"].split("(A)"), r["t"].split(" ("))
