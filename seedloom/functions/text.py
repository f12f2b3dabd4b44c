"""Text functions as column expressions, with the meaning of their Python namesakes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that str.strip() removes.
BLANKS = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip(text: Column | str) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def pieces(text: Column | str, literal: str) -> Column:
    """str.split on a literal: all parts, empty ones kept."""
    return F.split(text, "".join(c if c.isalnum() or c in " :" else f"\\{c}" for c in literal), -1)


def nth(parts: Column, k: int) -> Column:
    """The k-th part from 0, null where there is none."""
    return F.get(parts, F.lit(k))


def letter(index: Column) -> Column:
    return F.char(index.cast("int") + 65)


def letter_index(output: Column) -> Column:
    """0 to 3 for A to D, null for anything else."""
    return F.when(output.rlike("^[A-D]$"), F.ascii(output) - 65)


def relabel(options: Column) -> Column:
    """``(A)x (B)y ...``: no blank after a label, one between options."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.lit("("), letter(i), F.lit(")"), x)), " ")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9; an empty array for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def python_tokens(text: str | None) -> list[str]:
    """The same in Python, for Arrow stages."""
    return re.findall("[a-z0-9]+", text.lower()) if text else []
