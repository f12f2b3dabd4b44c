import hashlib

import pytest
from pyspark.sql import functions as F

from seedloom.operators.packed_values import Codes, cheapest, options_of, split_packed

CASES = [
    (" (A)Norwick (B)St. Orb (C)Pellham (D)Vey", ["Norwick", "St. Orb", "Pellham", "Vey"]),
    (" (A) rope (B) TAR (C) PITCH (D) All kinds of sail", ["rope", "TAR", "PITCH", "All kinds of sail"]),
    (" Of all that the harbour board wrote down about its boats in that long summer (see the note) choose: (A) red barges (B) blue barges", ["red barges", "blue barges"]),
    (" Of all that the harbour board wrote about its boats / barges choose one: red barges; blue barges; green barges", ["red barges", "blue barges", "green barges"]),
    ("\nA) one way\nB) two ways\nC) no way", ["one way", "two ways", "no way"]),
    (' A: "60,719 riders" / B: "79.1 riders" / C: "6,709 riders"', ["60,719 riders", "79.1 riders", "6,709 riders"]),
    (" Choices: A. red barges; B. blue barges; C. green barges", ["red barges", "blue barges", "green barges"]),
    (" [A] 400 trips; B) 319 trips, (C)808 trips", ["400 trips", "319 trips", "808 trips"]),
    (" A - keeps totals; B - drops gates;", ["keeps totals", "drops gates"]),
    (" (1)red, late barges, (2)blue barges", ["red, late barges", "blue barges"]),
    (" red barges|blue barges|green barges |", ["red barges", "blue barges", "green barges"]),
    (" Options:\n• red barges\n• blue barges", ["red barges", "blue barges"]),
    ("\tred barges\tblue barges\tgreen barges", ["red barges", "blue barges", "green barges"]),
    (" red barges // blue barges // green barges", ["red barges", "blue barges", "green barges"]),
    (' "red, late barges","blue, slow barges"', ["red, late barges", "blue, slow barges"]),
    (" 'red barges' 'blue barges'", ["red barges", "blue barges"]),
    (' "the ""slow"" barges"; "the \\"fast\\" barges"', ['the "slow" barges', 'the "fast" barges']),
    (' red barges; "blue, slow barges" / green barges | grey barges', ["red barges", "blue, slow barges", "green barges", "grey barges"]),
    (" “red barges”, “blue barges”", ["red barges", "blue barges"]),
    (" (a)  red \n barges (b) blue barges", ["red barges", "blue barges"]),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_dialects(spark, text, values):
    got = cheapest(text, Codes())
    assert got[2] == values


@pytest.mark.parametrize("form", ["({0}) barge {1} ", "{0}. barge {1}; "])
@pytest.mark.parametrize("letters", [True, False])
def test_labels_count_on(form, letters):
    names = [chr(97 + k) for k in range(26)] + [a + chr(97 + k) for a in "abcd" for k in range(26)] if letters else [str(k + 1) for k in range(130)]
    got = cheapest(" " + "".join(form.format(n.upper(), k) for k, n in enumerate(names)), Codes())
    assert got[2] == [f"barge {k}" for k in range(130)]


def test_counts_tell_commas_inside_values_from_those_between(spark):
    """A comma stays in a value where the corpus has shown that what follows it opens no value."""
    rows = [(i, f" (A) leaves at {i % 7}, mostly (B) stays at {i % 5}, mostly (C) turns at {i % 3}, mostly") for i in range(60)]
    rows += [(100 + i, f" leaves at {i % 7}, mostly; stays at {i % 5}, mostly; turns at {i % 3}, mostly") for i in range(20)]
    got = split_packed(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    per = {r["id"]: r["vals"] for r in got.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("value_pos", "value_text"))).alias("vals")).collect()}
    assert [v["value_text"] for v in per[100]] == ["leaves at 0, mostly", "stays at 0, mostly", "turns at 0, mostly"]
    assert all([v["value_pos"] for v in x] == [0, 1, 2] for x in per.values())


def test_edge_cases(spark):
    long = " (A) " + "very " * 20_000 + "long (B) short"
    rows = [(1, None, "x"), (2, "", "x"), (3, "   ", "x"), (4, long, "x"), (5, " alone", "x"), (None, " (A) a (B) b", "x"), (6, " (A) a (B) b", "x"), (6, " (A) a (B) b", "y")]
    df = spark.createDataFrame(rows, "id long, t string, value_pos string")
    got = {(r[0], r[1]): r[2] for r in split_packed(df, "id", F.col("t")).collect()}
    assert got[(4, 1)] == "short" and got[(4, 0)].endswith("long")
    assert got[(5, 0)] == "alone"
    assert {k for k in got if k[0] == 6} == {(6, 0), (6, 1)}
    assert not {k for k in got if k[0] in (1, 2, 3, None)}
    assert split_packed(df.limit(0), "id", F.col("t")).count() == 0


def test_versions(spark):
    rows = [(1, " (A) new (B) b", "2024-01-02"), (1, " (A) old (B) b", "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, t string, at string").withColumn("at", F.to_timestamp("at"))
    assert split_packed(df, "id", F.col("t"), F.col("at")).where("value_pos = 0").first()["value_text"] == "old"
    # an earlier delivery counts even if it holds nothing
    earlier = df.unionByName(spark.createDataFrame([(1, None, "2023-01-01")], "id long, t string, at string").withColumn("at", F.to_timestamp("at")))
    assert split_packed(earlier, "id", F.col("t"), F.col("at")).count() == 0


def test_equal_versions_go_by_content(spark):
    rows = [(1, f" (A) v{n} (B) b") for n in range(6)]
    want = min((hashlib.md5(t.encode()).hexdigest(), t) for _, t in rows)[1][5:7]
    for n in (1, 4):
        got = split_packed(spark.createDataFrame(rows, "id long, t string").repartition(n), "id", F.col("t"))
        assert [r["value_text"] for r in got.orderBy("value_pos").collect()] == [want, "b"]


def test_options_end_and_polarity(spark):
    schema = "example_id long, polarity string, task_kind string, input string, loaded_at timestamp"
    rows = [(1, "positive", "Multiple Selection", "Who? (A)a? (B)b", None), (2, "negative", "Multiple Selection", "Who? (A)a (B)b", None), (3, "positive", "Multiple Selection", "no question mark (A)a (B)b", None)]
    got = [tuple(r) for r in options_of(spark.createDataFrame(rows, schema)).orderBy("value_pos").collect()]
    assert got == [(1, 0, "a?"), (1, 1, "b")]
