"""Texts that look the same, brought to one form through Unicode collation in SQL.

Look-alike characters are mapped inside the JVM (``translate`` and two
patterns), the mapped values are grouped under the accent-sensitive,
case-sensitive collation ``UNICODE``, under which an accent written apart
equals one written together, and each class's first member gives its form.  Only values
that share their plain characters are compared; all others are alone in their class.

Letters of other alphabets are mapped by Unicode's own table of confusable characters, as the ICU library of the JVM
holds it, but for those in ``TOLD_APART``; widths and ligatures by their compatibility forms.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import join_counted
from seedloom.session import cut, spread

#: Alphabets with letters drawn as Latin ones are.  Which letters these are comes from Unicode's table of confusable characters, which ICU holds.
SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
# Letters that this table takes for Latin ones, but that a reader tells from them: without a dot, open or closed otherwise, with a tail, of another height.
TOLD_APART = "ıɩιꙇσαγυгᴦⲅꮁЬҽѡառքզգӏ"

# Latin letters of phonetic writing and marks with the character drawn alike.
ALIKE = {
    "ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ǀ": "l",
    "‐": "-", "‑": "-", "˗": "-", "։": ":", "׃": ":", "․": ".", "‚": ",", "ʹ": "'", "⁄": "/", "∕": "/", "՝": "`",
}

#: Line ends differ from blanks; every other kind of blank is one blank.
BLANKS = "\t               　"
#: Characters that do not show: format characters but for the signs that enclose numbers, variation selectors, fillers, controls but for tab and line ends.
_SIGNS = r"\x{600}-\x{605}\x{6DD}\x{70F}\x{890}\x{891}\x{8E2}\x{110BD}\x{110CD}"
UNSEEN = rf"[[\p{{Cf}}&&[^{_SIGNS}]]͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\x{{E0100}}-\x{{E01EF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


@cache
def lookalikes() -> dict[str, str]:
    """Letters of ``SCRIPTS`` with the Latin letter of the same skeleton, of the same case where both cases share it; and ``ALIKE``.

    The skeletons come from the ICU library of the session's JVM, in one call on the driver.
    """
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.name(c, "").split(" ")[0] in SCRIPTS and not unicodedata.decomposition(c) and c not in TOLD_APART]
    latin = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    checker = session._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join([*latin, *letters])).split("\n")
    of: dict[str, list[str]] = {}
    for c, k in zip(latin, skeletons, strict=False):
        of.setdefault(k, []).append(c)
    out = dict(ALIKE)
    for c, k in zip(letters, skeletons[len(latin) :], strict=True):
        if k in of:
            out[c] = next((x for x in of[k] if x.islower() == (unicodedata.category(c) == "Ll")), of[k][0])
    return out


@cache
def character_maps() -> tuple[dict[str, str], dict[str, str]]:
    """Maps to one and to several characters, derived from the Unicode data.

    Full and half width, ligatures, number and letter signs take their
    compatibility form; raised, lowered, circled and styled ones stay. A letter
    with an accent is mapped as its bare letter is.
    """
    alike = lookalikes()
    one = {b: " " for b in BLANKS}
    several: dict[str, str] = {}
    for code in range(0x80, 0x2FA20):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or ch in one:
            continue
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        form = ch
        if tag in ("<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and code != 0x3000:
            form = unicodedata.normalize("NFKC", ch)
            if " " in form or any(unicodedata.combining(c) for c in form):
                form = ch
        apart = unicodedata.normalize("NFD", form)
        mapped = unicodedata.normalize("NFC", "".join(alike.get(c, c) for c in apart))
        if mapped != ch:
            (one if len(mapped) == 1 else several)[ch] = mapped
    return one, several


def with_looks(df: DataFrame, text_col: str, name: str = "form") -> DataFrame:
    """Adds the text with unseen characters gone, and blanks, widths and look-alikes mapped."""
    one, several = character_maps()
    text = F.col(text_col)
    mapped = F.translate(F.regexp_replace(text, UNSEEN, ""), "".join(one), "".join(one.values()))
    # plain text has nothing to map but tabs and controls; two steps, so that no expression runs twice
    out = df.withColumn("_mapped", F.when(F.rlike(text, F.lit(r"[^\n\r\x20-\x7E]")), mapped).otherwise(text))
    pairs = F.from_json(F.lit(json.dumps([{"f": c, "t": t} for c, t in several.items()])), "array<struct<f:string,t:string>>")
    step = F.aggregate(pairs, F.col("_mapped"), lambda text, pair: F.replace(text, pair["f"], pair["t"]))
    # the longer step runs only where a character of it may occur
    return out.withColumn(name, F.when(F.rlike("_mapped", F.lit(f"[{_ranges(several)}]")), step).otherwise(F.col("_mapped"))).drop("_mapped")


def _ranges(chars: dict[str, str]) -> str:
    """A pattern class of few ranges for many characters; gaps of characters that are not mapped do no harm."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code - runs[-1][1] < 64:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def look_classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows ``(id, digest)`` and classes ``(digest, first_id, form, n)``, one per distinct mapped value."""
    spark = df.sparkSession
    source = spread(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(*dict.fromkeys([id_col, text_col])))
    rows = with_looks(source.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text").select("id", "form")
    # what two values that the collation holds equal always share: their plain characters that bear no accent; and the signs that it does not see, but a reader does
    bare = F.unhex(F.md5(F.regexp_replace("form", rf"[\x00-\x7F]?\p{{M}}+|[^\x00-\x7F{_SIGNS}]", "")))
    rows = cut(rows.withColumns({"digest": F.unhex(F.md5("form")), "bare": bare}), "looks")
    # equal mapped values first, so that a value held by many rows reaches the collation once
    values = cut(spark.sql("SELECT digest, first(bare) AS bare, first(form) AS form, min(id) AS low, count(*) AS n FROM {rows} GROUP BY digest", rows=rows), "look-values")
    shared = values.groupBy("bare").agg(F.count("*").alias("v")).where("v > 1")
    several = cut(join_counted(values, shared, "bare", "v", values.count()), "look-several")
    alone = values.join(several.select("digest"), "digest", "left_anti")
    classes = spark.sql(
        """
        WITH classes AS (
          SELECT bare, form COLLATE UNICODE AS look, min(low) AS first_id, min_by(form, low) AS chosen, sum(n) AS members
          FROM {several} GROUP BY bare, form COLLATE UNICODE
        )
        SELECT v.digest, c.first_id, c.chosen AS form, c.members, v.n
        FROM {several} v JOIN classes c ON v.bare = c.bare AND v.form COLLATE UNICODE = c.look
        UNION ALL
        SELECT digest, low, form, n, n FROM {alone}
        """,
        several=several,
        alone=alone,
    )
    return rows, classes, rows.count()


def one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text: id, ``first_id`` of its class, ``form``, the class's one consistent text.

    Null texts and null ids have no row; texts with nothing to see form a class.
    A row that is repeated comes out as often as it occurs.  Other columns are not read.
    """
    rows, classes, total = look_classes(df, id_col, text_col)
    joined = join_counted(rows.select("id", "digest"), classes.drop("members"), "digest", "n", total)
    return joined.select(F.col("id").alias(id_col), "first_id", "form")


def same_looks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text that is not the first of its class: ``first_id``, ``copy_id``."""
    rows, classes, total = look_classes(df, id_col, text_col)
    joined = join_counted(rows.select("id", "digest"), classes.where("members > 1").select("digest", "first_id", "n"), "digest", "n", total)
    return joined.where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
