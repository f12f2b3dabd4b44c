import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seedloom.llm import lookalike as la


@pytest.fixture(autouse=True)
def session(spark):
    """The maps come from the session's JVM."""


def mapped(text):
    """The form by plain Python."""
    one, several = la.character_maps()
    kept = "".join(c for c in text if unicodedata.category(c) != "Cf" or "\u0600" <= c <= "\u0605" or c in "\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
    return unicodedata.normalize("NFC", "".join(one.get(c, several.get(c, c)) for c in kept))


SAME = [
    ("Paris café", "Ｐａｒｉｓ café"),
    ("a b", "a b"),
    ("c d", "c　d"),
    ("zero", "ze​ro⁠﻿­"),
    ("Oscar", "Оѕсаr"),
    ("fine office", "ﬁne oﬃce"),
    ("Kelvin", "Kelvin"),
    ("Part II", "Part Ⅱ"),
    ("ё", "ë"),
    ("non-stop", "non‑stop"),
    ("ABO", "\ua4ee\ua4d0\u2c9e"),
    ("DATa", "\u13a0ATa"),
]
DIFFERENT = [("Cafe", "Café"), ("cafe", "Cafe"), ("m2", "m²"), ("a  b", "a b"), ("a\nb", "a b"), ("one two", "one"), ("Paris", "paris"), ("s\u0131k\u0131ld\u0131m", "sikildim"), ("\u03c3\u03b5", "\u03bf\u03b5"), ("\u0661\u06dd", "\u0661"), ("d\u03b9g", "dig"), ("\u0433ed", "red")]


def rows_of(pairs):
    return [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]


def test_same_and_different(spark):
    df = spark.createDataFrame(rows_of(SAME + DIFFERENT), "doc_id long, text string")
    got = sorted(map(tuple, la.same_looks(df, "doc_id", "text").collect()))
    assert [(a, b) for a, b in got if b < 2 * len(SAME)] == [(2 * k, 2 * k + 1) for k in range(len(SAME))]
    assert {b for a, b in got if b >= 2 * len(SAME)} == {b for a, b in got if b >= 2 * len(SAME) and mapped(dict(rows_of(SAME + DIFFERENT))[a]) == mapped(dict(rows_of(SAME + DIFFERENT))[b])}
    for k in range(len(SAME), len(SAME) + len(DIFFERENT)):
        assert (2 * k, 2 * k + 1) not in got


def test_letters_come_from_the_table_of_confusables(spark):
    got = la.lookalikes()
    assert {"\u13aa": "A", "\ua4d0": "B", "\u2c9e": "O", "\u0430": "a", "\u0406": "I", "\u0456": "i", "\u03bd": "v", "\u041e": "O", "\u0555": "O"}.items() <= got.items()
    assert not set(got) & set(la.TOLD_APART) and all(len(v) == 1 and v.isascii() for v in got.values())


def test_texts_without_a_plain_character(spark, monkeypatch):
    """They share one key, which a third of all rows may hold."""
    import seedloom.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, chr(0x4E00 + i % 200) + ("" if i % 2 else chr(0x200B)) if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = {(r["first_id"], r["copy_id"]) for r in la.same_looks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {(i % 200 if (i % 200) % 3 == 0 else next(k for k in range(0, 900, 3) if k % 200 == i % 200), i) for i in range(0, 900, 3)} - {(i, i) for i in range(900)}


def test_one_form(spark):
    rows = [(5, "Ｐａｒｉｓ café"), (3, "Paris café"), (4, "Paris café"), (9, None), (None, "x"), (7, ""), (8, "​"), (4, "Paris café"), (10, "long " * 50_000)]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, form string")
    got = sorted(map(tuple, la.one_form(df, "doc_id", "text").collect()))
    form = "Paris café"
    assert got == [(3, 3, form), (4, 3, form), (4, 3, form), (5, 3, form), (7, 7, ""), (8, 7, ""), (10, 10, "long " * 50_000)]
    assert sorted(map(tuple, la.same_looks(df, "doc_id", "text").collect())) == [(3, 4), (3, 5), (7, 8)]
    assert la.same_looks(df.limit(0), "doc_id", "text").count() == 0


def test_a_third_of_all_rows_look_the_same(spark, monkeypatch):
    import seedloom.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, "same​ text" if i % 6 == 0 else "same text" if i % 3 == 0 else f"text {i}") for i in range(600)]
    got = la.same_looks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(got) == 199 and {r["first_id"] for r in got} == {0}


alphabet = "aeoAEO²2é́  ​аеоΑΕＡａﬁ\n-‑I"


def test_against_plain_python(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(4)))) for i in range(1500)]
    groups = {}
    for i, t in rows:
        groups.setdefault(mapped(t), []).append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted(map(tuple, la.same_looks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())) == want


@settings(suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=8))
def test_mapping_is_stable(text):
    assert mapped(mapped(text)) == mapped(text) or any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", text))
