import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom.llm import pair_defects as pd_

SF = "/root/testdata/sf0.01"
SCHEMA = "example_id long, polarity string, input string, output string, explanation string, loaded_at timestamp, version string"
DOCS = "doc_id long, text string, lang string"

ENGLISH = ["The barges on the river were counted by the harbour board in the morning", "The survey of the town lists the trips of the buses for the month of May"]
GERMAN = [
    "Die Boote auf dem Fluss wurden am Morgen von der Behörde gezählt", "Die Studie der Stadt nennt die Fahrten der Busse für den Monat Mai",
    "Auf der Brücke wurden im Sommer keine Fahrten gezählt, weil die Messstelle nicht in Betrieb war", "Der Bericht sagt, dass die Werte für das Jahr nicht vollständig sind und später ergänzt werden",
    "Von den Fahrern haben die meisten den Weg durch die Stadt genommen, obwohl er länger dauert", "Die Behörde zählt die Boote und die Busse jeden Morgen und gibt die Zahlen an die Stadt weiter",
]


@pytest.fixture(scope="module")
def replies():
    """The model of responses, with all responses of a data folder as answers."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    rows = pd.read_parquet(f"{SF}/examples.parquet", columns=["output", "explanation"])
    _, parts = pd_._sentences([t for c in rows for t in rows[c] if pd_._says(t)])
    return pd_.Replies(np.stack([np.bincount(pd_._word_features(parts, {})[1], minlength=pd_.GRAMS), *pd_._seeds()]))


EMPTY = [None, "", "  ", "​", "...", '""', "[]", "n/a", "N/A", "TBD", "(no answer)", "<empty>", "null", "___", "undefined"]
NOT_EMPTY = ["None", "none", "A", "(D)", "0", "No."]
REFUSALS = ["I'm sorry, but I cannot answer this question.", "As a language assistant, I will not comment.", "My guidelines keep me from giving this answer", "UNFORTUNATELY I CAN’T HELP WITH THAT REQUEST", "Ich kann diese Frage nicht beantworten", "Leider darf ich keine Auskunft geben.", "Lo siento, pero no tengo acceso a esos datos", "No puedo responder", "Je ne peux pas répondre à cette question", "Désolé, mais je n'ai pas accès à ces données"]
NO_REFUSALS = ["Without access the planning desk cannot answer for the counts.", "The decline was put down to snow", "Wagen je Stunde", "The town could not tell cars from vans", None, ""]


@pytest.mark.parametrize(("texts", "kind", "yes"), [(REFUSALS, 0, True), (NO_REFUSALS, 0, False), (NOT_EMPTY, 1, False), (NOT_EMPTY, 0, False)])
def test_kinds_of_responses(replies, texts, kind, yes):
    for text in texts:
        assert bool(replies.kinds([text or ""], {})[kind][0]) is yes, text
    # a sentence more does not hide it
    if yes:
        assert replies.kinds([f"{t} The record on the town is long and can be read on the spot." if t[-1] == "." else t for t in texts], {})[kind].all()


def test_empty_outputs(spark):
    rows = [(i, "positive", f"Fact: the barges {i}. Question: where {i}?", t, None, None, "v") for i, t in enumerate(EMPTY + NOT_EMPTY)]
    examples, docs = small(spark)
    got = {r["example_id"] for r in pd_.example_defects(examples.where("example_id < 1000").withColumn("example_id", F.col("example_id") + 5000).unionByName(spark.createDataFrame(rows, SCHEMA)), docs).where("defect = 'empty'").collect()}
    assert got == set(range(len(EMPTY)))


def test_sums_as_a_tree(spark):
    df = spark.createDataFrame([(f"p{k % 3}", bytearray(pd_._pack(np.full(4, k))), k % 50) for k in range(300)], "piece string, counts binary, part int")
    for fan in (2, 32):
        got = pd_._added(df, 50, fan)
        assert {p: int(x[0]) for p, x in got.items()} == {f"p{r}": sum(k for k in range(300) if k % 3 == r) for r in range(3)}


@pytest.mark.parametrize(
    ("prompt", "text", "copy"),
    [
        ("Fact: a b c d e. Question: who keeps the old barges?", "Who keeps the old barges", True),
        ("Fact: a b c d e. Question: who keeps the old barges?", "question: WHO keeps the old barges", True),
        ("Question: who keeps the old barges? Fact: a b c d e.", "who keeps the old barges", True),
        ("Fact: a b c d e. Question: who keeps the old barges?", "Fact a b c d e question who keeps the old barges", True),
        ("Which road is the longest one? (A)this (B)that", "Which road is the longest one?", True),
        ("Which road is the longest one? (A)this (B)that", "The longest road is that one", False),
        ("Fact: a b c d e. Question: who?", "a b c d e", False),
        ("Fact: x. Question: who?", "who", False),
    ],
)
def test_copies(prompt, text, copy):
    assert pd_.copies_prompt(text, pd_._WORD.findall(prompt.lower()), prompt) is copy


@pytest.mark.parametrize(
    ("text", "whole"),
    [("late red barges", True), ("the answer is late red barges", True), ("late red bar", False), ("slow boats", True), ("slow", False), ("between 08:54 and", False), ("2.65 poin", False), ("2", False), ("2.65 points", True)],
)
def test_ends_like_prompt(text, whole):
    prompt = "Which? (A)late red barges (B) slow boats; open between 08:54 and 13:02, gain of 2.65 points."
    assert pd_.ends_like_prompt(text, prompt) is whole


def small(spark):
    rows = []
    for i in range(400):
        town = f"Town{chr(97 + i % 26)}{chr(97 + i // 26)}"
        rows.append((i, "positive", f"Fact: the barges of {town} were counted. Question: where were the barges counted?", f"in {town}", f"The note from {town} says that the barges were counted by the harbour board"))
    bad = {
        1000: ("in Townaa", "The note from Townaa says that the barges were counted by the har"),
        1001: ("in Townaa", "The note from Townaa says that the"),
        1002: ("", "undefined"),
        1003: ("in Townaa", "I cannot answer this question."),
        1004: ("where were the barges counted?", None),
        1005: ("in Townaa", "Die Boote auf dem Fluss wurden am Morgen von der Behörde gezählt und die Zahlen an die Stadt gegeben."),
        1006: ("in Townaa", "undefined"),
        1007: ("in Townaa", "The note from Townaa says that the barges were counted by the harbour board."),
    }
    prompt = "Fact: the barges of Townaa were counted. Question: where were the barges counted?"
    rows += [(i, "positive", prompt, o, e) for i, (o, e) in bad.items()]
    rows += [(1008, "positive", None, None, None), (1009, "positive", None, "x" * 100_000, None), (1003, "positive", prompt, *bad[1003]), (None, "positive", prompt, "", ""), (1010, "negative", prompt, "", "")]
    docs = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in ENGLISH] + [(t, "de") for t in GERMAN])] + [(10, None, "en"), (11, "text", None)]
    return spark.createDataFrame([(*r, None, "v") for r in rows], SCHEMA), spark.createDataFrame(docs, DOCS)


def test_each_defect(spark):
    examples, docs = small(spark)
    got = {r["example_id"]: r["defect"] for r in pd_.example_defects(examples, docs).collect()}
    assert {k: v for k, v in got.items() if k >= 1000} == {1000: "truncated", 1001: "truncated", 1002: "empty", 1003: "refusal", 1004: "copy", 1005: "language", 1008: "empty"}
    assert not [k for k in got if k < 1000]


@pytest.mark.parametrize("copies", [2, 5, 100])
def test_copies_of_a_cut_do_not_vouch_for_it(spark, copies):
    """Rows of one template that are cut at the same place, some of them sent twice."""
    examples, docs = small(spark)
    cuts = []
    for i in range(copies):
        town = f"Town{chr(97 + i % 26)}{chr(97 + i // 26)}"
        cuts += [(2000 + i, "positive", f"Fact: the barges of {town} were counted. Question: where were the barges counted?", f"in {town}", f"The note from {town} says that the barges were counted by the har", None, "v")] * (1 + i % 2)
    got = {r["example_id"]: r["defect"] for r in pd_.example_defects(examples.unionByName(spark.createDataFrame(cuts, SCHEMA)), docs).collect()}
    assert {k: v for k, v in got.items() if k >= 2000} == {2000 + i: "truncated" for i in range(copies)}
    assert not [k for k in got if k < 1000]


def test_contexts_are_never_taken_for_others():
    """More contexts than any fixed array of counters has room for."""
    rng = np.random.default_rng(0)
    bodies = ["".join(map(chr, row)) for row in rng.integers(97, 123, (12_000, 60))]
    found = {k: len(set(context)) for k, context, *_ in pd_._contexts(bodies, np.zeros(len(bodies), np.int64))}
    for k in (5, 7, 10):
        assert found[k] == len({f"\x03{b}"[i - k : i] for b in bodies for i in range(max(k, 2), 62)})
    one, other = (next(x for k, x, *_ in pd_._contexts(["abc"], np.array([f])) if k == 2) for f in (0, 1))
    assert not set(one) & set(other)


def test_empty_tables(spark):
    examples, docs = small(spark)
    assert pd_.example_defects(examples.limit(0), docs).count() == 0
    got = pd_.example_defects(examples, docs.limit(0))
    assert got.where("defect = 'language'").count() == 0 and got.where("defect = 'empty'").count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    """Sound pairs that are broken here: cut inside a word, or explained in another language."""
    examples = spark.read.parquet(f"{SF}/examples.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pd_.positive_rows(examples).dropDuplicates(["example_id"])
    known = pd_.example_defects(examples, docs).select("example_id")
    sound = rows.join(known, "example_id", "left_anti").where("explanation is not null and lower(explanation) <> 'undefined' and length(explanation) > 60")
    pick = F.pmod(F.xxhash64("example_id"), F.lit(20))
    cut = F.expr("regexp_replace(substring(explanation, 1, 45), '[^a-z]+$', '')")
    english = F.lower("input").rlike(r"\b(the|which|what)\b")
    broken = sound.withColumn("k", pick).withColumn("explanation", F.when(F.col("k") == 0, cut).when((F.col("k") == 1) & english, F.lit("Nach der Tabelle wurden die Fahrten in diesem Monat dort gezählt.")).otherwise(F.col("explanation")))
    got = pd_.defects(broken.drop("k"), docs, "example_id")
    told = broken.join(got, "example_id", "left").select("k", english.alias("en"), F.coalesce("defect", F.lit("")).alias("d")).collect()
    cuts = [r["d"] for r in told if r["k"] == 0]
    foreign = [r["d"] for r in told if r["k"] == 1 and r["en"]]
    rest = [r["d"] for r in told if r["k"] > 1]
    assert sum(d == "truncated" for d in cuts) >= 0.75 * len(cuts)
    assert sum(d == "language" for d in foreign) >= 0.95 * len(foreign)
    assert sum(d != "" for d in rest) <= 0.01 * len(rest)


# None of these are among the labelled examples.
HELD_OUT = {
    "refusal": ["Sorry, this is nothing I can talk about.", "I can't tell you, I have no access to these figures.", "I'm afraid I am unable to answer.", "We cannot provide that.", "I am not permitted to share such information.", "Leider kann ich Ihnen das nicht beantworten.", "Lo siento, no puedo ayudar con esa pregunta.", "Désolé, je ne peux pas vous donner ces données."],
    "empty": ["N.A.", "<null>", "[no answer]", "TBD.", "   ", "--", "not available.", "(no response)"],
}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", SF])
def test_held_out_recall_of_each_defect(spark, folder):
    """Sound pairs that are made to refuse, to stand for nothing or to give back the question, at two sizes."""
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    examples, docs = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("examples", "documents"))
    rows = pd_.positive_rows(examples).dropDuplicates(["example_id"])
    known = pd_.example_defects(examples, docs).select("example_id")
    k = F.pmod(F.xxhash64("example_id"), F.lit(20))
    pick = lambda kind: F.element_at(F.array(*[F.lit(t) for t in HELD_OUT[kind]]), (F.pmod(F.xxhash64("example_id", F.lit(1)), F.lit(len(HELD_OUT[kind]))) + 1).cast("int"))
    question = F.expr("regexp_extract(input, '([^.?]{20,}[?])', 1)")
    sound = rows.join(known, "example_id", "left_anti").withColumn("k", k).withColumn("q", question)
    broken = sound.withColumn("output", F.when(F.col("k") == 0, pick("refusal")).when(F.col("k") == 1, pick("empty")).when((F.col("k") == 2) & (F.col("q") != "") & F.col("input").contains("Question:"), F.trim("q")).otherwise(F.col("output")))
    got = pd_.defects(broken.drop("k", "q"), docs, "example_id")
    told = broken.join(got, "example_id", "left").select("k", (F.col("output") == F.trim("q")).alias("copied"), F.coalesce("defect", F.lit("")).alias("d")).collect()
    # of eight wordings that no example has, the model misses one that is worded like no other
    for number, name, bar in ((0, "refusal", 0.85), (1, "empty", 0.9), (2, "copy", 0.9)):
        of = [r["d"] for r in told if r["k"] == number and (name != "copy" or r["copied"])]
        assert sum(d == name for d in of) >= bar * len(of), (name, of)
    rest = [r["d"] for r in told if r["k"] > 2]
    assert sum(d != "" for d in rest) <= 0.02 * len(rest)
