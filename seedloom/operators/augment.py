"""Seeds to positive and negative examples, branch by branch.

Every branch is a narrow fan-out (``explode`` of a sequence); branches are put
together by UNION ALL, seeds first.  Explanations are drawn by slot: a shuffle j of a variant carries
draw j, the variant itself draw 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.operators import mcq
from seedloom.operators.providers import Provider
from seedloom.schemas import LINEAGE

VARIANTS, SHUFFLES, NEGATIVES = 10, 2, 2
_COLUMNS = (*LINEAGE, "input", "output", "explanation")
_KEY = ("file", "task_kind", "seed_ord")


def _fan(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _row(df: DataFrame, polarity: str, branch: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("int")
    have = set(df.columns)
    extra = {c: none for c in ("variant", "shuffle", "neg_slot") if c not in have}
    return df.withColumns({**extra, **columns}).withColumns({"polarity": F.lit(polarity), "branch": F.lit(branch)}).select(*_COLUMNS)


def _record(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def _because(provider: Provider, df: DataFrame, branch: str, draw: Column, right: Column) -> DataFrame:
    told = provider.fill(df, "_told", "paraphrase_explanation", draw, _record("input", "output", "explanation"), F.col("explanation"), key=(*_KEY, "_branch", *[c for c in ("variant", "shuffle", "neg_slot") if c in df.columns]))
    return told.withColumn("explanation", F.concat(F.lit("The correct answer is: "), right, F.lit(". "), F.col("_told"))).drop("_told")


def _wrong(df: DataFrame, seed: int, branch: str, *key: Column) -> DataFrame:
    """Two rows per row, each with a wrong letter; the right one stays in ``_right``."""
    letters = mcq.wrong_letters(F.col("output"), seed, F.lit(branch), *[F.col(k) for k in _KEY], *key)
    out = df.withColumns({"_right": F.col("output"), "_branch": F.lit(branch)})
    return out.select(*out.columns, F.posexplode(letters).alias("neg_slot", "_letter"))


def multiple_choice(seeds: DataFrame, provider: Provider, seed: int = 0, negatives_from: str = "seed") -> tuple[DataFrame, DataFrame]:
    """Positive and negative examples of parsed multiple-choice seeds (``mcq.parse`` without rejects).

    ``seeds``: file, task_kind, seed_ord, input, output, explanation, head, tail, options, answer_idx.
    31 positive and 62 negative rows a seed.  Negatives of a variant repeat the seed's
    input and explanation; ``negatives_from='paraphrase'`` takes the variant's instead.
    """
    base = seeds.withColumn("_branch", F.lit("M"))
    m0 = _row(base, "positive", "M0")

    m1 = _wrong(base, seed, "M1")
    m1 = _because(provider, m1, "M1", F.col("neg_slot"), F.col("_right")).withColumn("output", F.col("_letter"))

    variants = _fan(base, "variant", VARIANTS)
    variants = provider.fill(variants, "_question", "paraphrase", F.col("variant"), F.col("head"), key=(*_KEY, "variant"))
    variants = variants.withColumn("_new", F.concat("_question", F.lit(" (A)"), "tail"))
    px = lambda df, draw: provider.fill(df, "_told", "paraphrase_explanation", draw, _record("input", "output", "explanation"), F.col("explanation"), key=(*_KEY, "_branch", "variant"))
    m2 = px(variants.withColumn("_branch", F.lit("M2")), F.lit(2))
    m2 = _row(m2.withColumns({"input": F.col("_new"), "explanation": F.col("_told")}), "positive", "M2")

    m3 = _wrong(variants, seed, "M3", F.col("variant"))
    if negatives_from == "paraphrase":
        m3 = m3.withColumn("input", F.col("_new"))
    m3 = m3.withColumn("output", F.col("_letter"))

    turned = _fan(variants, "shuffle", SHUFFLES).withColumn("_branch", F.lit("M2"))
    turned = px(turned, F.col("shuffle")).withColumns({"explanation": F.col("_told"), "head": F.concat("_question", F.lit(" "))}).drop("_told")
    turned = mcq.shuffled(turned, seed, *[F.col(k) for k in _KEY], F.col("variant"), F.col("shuffle"))
    m4 = _row(turned, "positive", "M4")

    m5 = _wrong(turned, seed, "M5", F.col("variant"), F.col("shuffle"))
    m5 = _because(provider, m5, "M5", F.col("neg_slot"), F.col("_right")).withColumn("output", F.col("_letter"))

    positive = m0.unionByName(m2).unionByName(m4)
    negative = _row(m1, "negative", "M1").unionByName(_row(m3, "negative", "M3")).unionByName(_row(m5, "negative", "M5"))
    return positive, negative


def question_answer(seeds: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """Positive and negative examples of parsed fact questions (``qa.parse`` without rejects).

    21 positive and 40 negative rows a seed.  Blanks stay as the seed has them: a new question follows the
    head's own last blank, a new fact is followed by the question's own first ones.
    """
    base = seeds
    q0 = _row(base, "positive", "Q0")
    px = lambda df: provider.fill(df, "_told", "paraphrase_explanation", F.lit(0), _record("input", "output", "explanation"), F.col("explanation"), key=(*_KEY, "_branch", "variant"))

    asked = _fan(base.withColumn("_branch", F.lit("Q1")), "variant", VARIANTS)
    asked = provider.fill(asked, "_text", "paraphrase", F.col("variant"), F.col("question"), key=(*_KEY, "variant"))
    asked = px(asked).withColumns({"_new": F.concat("head", F.lit(" Question: "), "_text")})
    q1 = _row(asked.withColumns({"input": F.col("_new"), "explanation": F.col("_told")}), "positive", "Q1")

    stated = _fan(base.withColumn("_branch", F.lit("Q3")), "variant", VARIANTS)
    stated = provider.fill(stated, "_text", "paraphrase_sentence", F.col("variant"), F.col("fact"), key=(*_KEY, "variant"))
    stated = px(stated).withColumns({"_new": F.concat(F.lit("Fact: "), "_text", F.lit(" Question: "), "question")})
    q3 = _row(stated.withColumns({"input": F.col("_new"), "explanation": F.col("_told")}), "positive", "Q3")

    def negatives(rows: DataFrame, branch: str, of_new: bool) -> DataFrame:
        rows = _fan(rows.withColumn("_branch", F.lit(branch)), "neg_slot", NEGATIVES).withColumn("_right", F.col("output"))
        rows = provider.fill(rows, "_false", "false_output", F.col("neg_slot"), F.col("output"), key=(*_KEY, "_branch", "variant", "neg_slot"))
        # the seed is explained in one branch, the new row in the other
        if of_new:
            rows = rows.withColumns({"input": F.col("_new"), "explanation": F.col("_told")})
        rows = _because(provider, rows.drop("_told"), branch, F.col("neg_slot"), F.col("_right"))
        return _row(rows.withColumns({"input": F.col("_new"), "output": F.col("_false")}), "negative", branch)

    return q0.unionByName(q1).unionByName(q3), negatives(asked, "Q2", False).unionByName(negatives(stated, "Q4", True))


def array_position(n: Column) -> Column:
    """Place of a row in its polarity's list, from 0; seeds must be numbered from 0 and ``n`` be their number."""
    s, p, j, k = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("seed_ord", "variant", "shuffle", "neg_slot"))
    return (
        F.when(F.col("branch").isin("M0", "Q0"), s)
        .when(F.col("branch") == "M2", n + 30 * s + 3 * p)
        .when(F.col("branch") == "M4", n + 30 * s + 3 * p + 1 + j)
        .when(F.col("branch") == "M1", 62 * s + k)
        .when(F.col("branch") == "M3", 62 * s + 2 + 6 * p + k)
        .when(F.col("branch") == "M5", 62 * s + 2 + 6 * p + 2 + 2 * j + k)
        .when(F.col("branch") == "Q1", n + 20 * s + p)
        .when(F.col("branch") == "Q3", n + 20 * s + 10 + p)
        .when(F.col("branch") == "Q2", 40 * s + 2 * p + k)
        .when(F.col("branch") == "Q4", 40 * s + 20 + 2 * p + k)
    )


def augment(mc_seeds: DataFrame, qa_seeds: DataFrame, provider: Provider, seed: int = 0) -> DataFrame:
    """All examples of both tasks."""
    mp, mn = multiple_choice(mc_seeds, provider, seed)
    qp, qn = question_answer(qa_seeds, provider)
    return mp.unionByName(mn).unionByName(qp).unionByName(qn)


