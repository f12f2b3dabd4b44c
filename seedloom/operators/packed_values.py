"""Several values packed in one field: dialects chosen by description length.

A packed field is text such as ``Options: (A) x (B) y`` or ``x; "y, z" | w``.
A *dialect* is a way to read it: with or without a lead-in, with labels of
one style, or split at one kind of delimiter, with or without quotes.  Every
dialect that fits is scored by the bits that describe the field under it: the
lead-in, the dialect, the number of values, and each value's words given what
stands before them.  The bits come from counts over *all* fields:

1. every field is read by its cheapest dialect under fixed starting bits,
2. the words of the values found, by hashed bucket and context, are counted
   on the executors and summed by key (``value_codes``); the result has a size
   bound fixed by ``BUCKETS``,
3. every field is read again by its cheapest dialect under those counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.operators.keyed import content_hash, one_per_id
from seedloom.session import spread

#: Hashed word buckets per context; bounds the size of the code table.
BUCKETS = 1 << 13
#: What a word follows: it opens a value, or comes after blanks, no blank, a comma, a tab or line end, another delimiter, another mark.
FIRST, SPACE, TIGHT, COMMA, BREAK, DELIMITER, OTHER = range(7)
_SHAPES = 5
_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“", "‘": "’"}
_WORD = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"\s*([^\W\d_][^\n\t:;|•\"“«„]*?)\s*:(?=\s|[\"“«„'‘(\[]|$)")
_NUMBER = r"(?:[^\W\d_]+|\d+)"
_LABELS = {
    "round": rf"\({_NUMBER}\)",
    "square": rf"\[{_NUMBER}\]",
    "half": rf"{_NUMBER}\)",
    "dot": rf"{_NUMBER}\.",
    "colon": rf"{_NUMBER}:(?=\s)",
    "dash": rf"{_NUMBER}\s[-–—](?=\s)",
}
_BEFORE = r"(?<![^\s,;|/])"
_LABEL = re.compile(_BEFORE + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _LABELS.items()) + ")")
#: The label that a list of labelled values opens with; a colon or a quotation mark may stand before it.
_OPENS = re.compile(r"(?<=:)\s*(?:[(\[]?(?:[Aa]|1)(?:[)\].]|:(?=\s)|\s[-–—](?=\s)))")
#: What looks like a label at the edge of a value.
_EDGE = re.compile(_BEFORE + "(?:" + "|".join(v.replace(_NUMBER, r"\w{1,2}") for v in _LABELS.values()) + ")")
_BULLET = re.compile(r"(?:^|\n|(?<=:))[ \t]*[-*•‣·–][ \t]+")
_DELIMITERS = {
    "comma": re.compile(r",(?=[\s\0\"'“«„‘]|$)|(?<=[\0\"'”»“’]),"),
    "semicolon": re.compile(r";"),
    "pipe": re.compile(r"\|"),
    "slashes": re.compile(r"//"),
    "slash": re.compile(r"(?<=\s)/(?=\s)"),
    "dot": re.compile(r"[•·]"),
    "tab": re.compile(r"\t"),
    "line": re.compile(r"\n"),
    "mixed": re.compile(r",(?=\s|$)|[;|]|(?<=\s)/(?=\s)"),
}
_TRAIL = re.compile(r"\s*[,;|/]\s*$")
#: Cheap tests of whether a delimiter can occur at all.
_NEEDS = {"comma": ",", "semicolon": ";", "pipe": "|", "slashes": "//", "slash": " / ", "dot": "•·", "tab": "\t", "line": "\n"}


def _shape(word: str) -> int:
    if word[0].isdigit():
        return 0
    if word.islower():
        return 1
    if word.isupper() and len(word) > 1:
        return 2
    return 3 if word[0].isupper() and word[1:].islower() or len(word) == 1 else 4


def _unquote(value: str) -> tuple[str, bool]:
    """The value without quotation marks around the whole of it, and whether it had some."""
    close = _QUOTES.get(value[:1])
    if close is None or len(value) < 2 or value[-1] != close:
        return value, False
    inner = value[1:-1]
    if close in "\"'":
        bare = inner.replace("\\" + close, "").replace(close * 2, "")
        if close == "'":
            bare = re.sub(r"(?<=\w)'(?=\w)", "", bare)
        if close in bare:
            return value, False
        inner = inner.replace("\\" + close, close).replace(close * 2, close)
    elif close in inner:
        return value, False
    return inner, True


def _quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans of whole quoted values: an opening mark after a boundary, its end before one."""
    spans, at, n = [], 0, len(text)
    while at < n:
        close = _QUOTES.get(text[at])
        if close is None or (at and text[at - 1] not in " \t\n,;|/•"):
            at += 1
            continue
        end = at + 1
        while end < n:
            if text[end] == "\\" and end + 1 < n and text[end + 1] == close:
                end += 2
            elif text[end] == close:
                if close in "\"'" and text[end + 1 : end + 2] == close:
                    end += 2
                elif end + 1 == n or text[end + 1] in " \t\n,;|/•":
                    break
                else:
                    end += 1
            else:
                end += 1
        if end < n:
            spans.append((at, end + 1))
            at = end + 1
        else:
            at += 1
    return spans


def _count_up(first: str) -> Callable[[int], str]:
    """The labels that follow a first one: 1, 2, 3 ..., or a to z, then aa, ab ..."""
    if first == "1":
        return lambda k: str(k + 1)

    def letters(k: int) -> str:
        out = ""
        while k >= 0:
            out = chr(97 + k % 26) + out
            k = k // 26 - 1
        return out

    return letters


def _labelled(text: str, start: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Readings by labels that count up from A or 1, in one style or in mixed ones."""
    first = _LABEL.match(text, start)
    opening = first and first[first.lastgroup].strip("()[].:- –—").casefold()
    if opening not in ("a", "1"):
        return
    label = _count_up(opening)
    found = list(_LABEL.finditer(text, start))
    named = [m[m.lastgroup].strip("()[].:- –—").casefold() for m in found]
    for style in {first.lastgroup, "any"}:
        run: list[re.Match] = []
        for m, name in zip(found, named, strict=True):
            if style in (m.lastgroup, "any") and name == label(len(run)):
                run.append(m)
        if len(run) < 2 or style == "any" and len({m.lastgroup for m in run}) == 1:
            continue
        ends = [m.start() for m in run[1:]] + [len(text)]
        trails, spans = [], []
        for m, end in zip(run, ends, strict=True):
            t = _TRAIL.search(text, m.end(), end)
            trails.append(t[0].strip() if t else "")
            spans.append((m.end(), t.start() if t else end))
        if trails[-1] and trails[-1] not in trails[:-1]:
            spans[-1] = (run[-1].end(), len(text))
        yield f"label-{style}", spans


def _leads(text: str) -> list[tuple[str, int]]:
    """What may stand before the first value, with where the values begin: nothing, the text up to the first colon, or up to the colon before a first label."""
    out = [("", 0)]
    m = _LEAD.match(text)
    if m and not _LABEL.match(m[1]):
        out.append((m[1].casefold(), m.end()))
    m = _OPENS.search(text)
    if m and m.start() != out[-1][1] and not _LABEL.match(text, len(text) - len(text.lstrip())):
        out.append((text[: m.start() - 1].strip().casefold(), m.start()))
    return out


def _delimited(text: str, begin: int, start: int) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """Readings split at a delimiter outside quoted values, with the delimiters used."""
    quoted = [s for s in _quoted_spans(text) if s[0] >= start]
    outside = text
    if quoted:
        chars = list(text)
        for a, b in quoted:
            chars[a:b] = "\0" * (b - a)
        outside = "".join(chars)
        if len(quoted) > 1 and not outside[start:].replace("\0", "").strip():
            yield "quotes-only", quoted, 0
    for q, shown in (("q", outside), ("", text)) if quoted else (("", text),):
        kinds = 0
        for kind, rx in _DELIMITERS.items():
            if kind == "mixed":
                if kinds < 2:
                    continue
            elif not any(c in shown for c in ([_NEEDS[kind]] if len(_NEEDS[kind]) > 1 and kind != "dot" else _NEEDS[kind])):
                continue
            cuts = [m for m in rx.finditer(shown, start)]
            if not cuts:
                continue
            kinds += kind in ("comma", "semicolon", "pipe", "slash")
            spans = list(zip([start, *(m.end() for m in cuts)], [*(m.start() for m in cuts), len(text)], strict=True))
            if not text[spans[-1][0] : spans[-1][1]].strip():
                spans.pop()
            if spans and not text[spans[0][0] : spans[0][1]].strip() and kind in ("tab", "line"):
                spans.pop(0)
            if kind == "mixed" and len({m[0] for m in cuts}) < 2:
                continue
            if spans:
                yield f"{kind}{q}", spans, len(cuts)
        bullets = list(_BULLET.finditer(shown, begin))
        if len(bullets) > 1 and not text[begin : bullets[0].start()].strip():
            yield f"bullet{q}", list(zip([m.end() for m in bullets], [*(m.start() for m in bullets[1:]), len(text)], strict=True)), len(bullets)


class Codes:
    """Bits of dialects, lead-ins, numbers of values and words by context."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = counts
        if counts:
            self.total = {}
            for key, n in counts.items():
                kind = key.split("\t", 1)[0]
                self.total[kind] = self.total.get(kind, 0) + n
            self.memo: dict[tuple[int, str], float] = {}

    def part(self, kind: str, value: str, unseen: float) -> float:
        """Bits of one of few outcomes, or those of spelling out one never seen."""
        n, total = self.counts.get(f"{kind}\t{value}", 0), self.total.get(kind, 0)
        return -math.log2(n / (total + 1)) if n else math.log2(total + 1) + unseen

    def lead(self, lead: str) -> float:
        spelled = min(5.0 * len(lead), 30.0 + 12.0 * (lead.count(" ") + 1)) if lead else 0.0
        if not self.counts:
            return 5.0 + lead.count(" ") + 1 if lead else 1.0
        return self.part("lead", str(crc32(lead.encode()) % BUCKETS) if lead else "", spelled)

    def dialect(self, name: str) -> float:
        if not self.counts:
            return 10.0 if "mixed" in name else 8.0 if "any" in name else 5.0
        return self.part("dialect", name, 6.0)

    def number(self, n: int) -> float:
        if not self.counts:
            return 14.0 if n < 2 else 3.0
        return self.part("number", str(min(n, 30)), 4.0 + n)

    def word(self, context: int, word: str) -> float:
        """Bits of a word and of what stands before it."""
        if not self.counts:
            return (6.0, 0.5, 1.0, 9.0, 8.0, 18.0, 10.0)[context]
        key = (context, word)
        if (bits := self.memo.get(key)) is None:
            get = self.counts.get
            here = self.total.get(f"w{context}", 0)
            after = sum(self.total.get(f"w{c}", 0) for c in range(SPACE, OTHER + 1)) + 6
            bits = 0.0 if context == FIRST else -math.log2((here + 1) / after)
            shapes = self.total.get(f"s{context}", 0)
            shape = (get(f"s{context}\t{_shape(word)}", 0) + 0.1) / (shapes + 0.1 * _SHAPES)
            seen = get(f"w{context}\t{crc32(word.lower().encode()) % BUCKETS}", 0)
            bits -= math.log2((seen + 4.0 * shape / BUCKETS * 8) / (here + 4.0))
            if len(self.memo) < 200_000:
                self.memo[key] = bits
        return bits


def _contexts(text: str) -> tuple[list[int], list[int], list[str], list[int]]:
    starts, ends, words, contexts, last = [], [], [], [], 0
    for m in _WORD.finditer(text):
        gap = text[last : m.start()]
        if not gap.strip():
            contexts.append(BREAK if "\t" in gap or "\n" in gap else SPACE)
        elif "," in gap and gap[-1:].isspace():
            contexts.append(COMMA)
        elif any(c in gap for c in ";|•·") or "/" in gap and len(gap) > 1:
            contexts.append(DELIMITER)
        else:
            contexts.append(TIGHT if len(gap) == 1 and gap != '"' else OTHER)
        starts.append(m.start())
        ends.append(m.end())
        words.append(m[0])
        last = m.end()
    return starts, ends, words, contexts


def cheapest(text: str, codes: Codes) -> tuple[str, str, list[str]] | None:
    """Lead-in, dialect and values of the cheapest reading; None where there is no text."""
    if not text or not text.strip():
        return None
    starts, ends, words, contexts = _contexts(text)
    inner = [0.0]
    for w, c in zip(words, contexts, strict=True):
        inner.append(inner[-1] + codes.word(c, w))
    opens: dict[int, float] = {}
    seen: dict[tuple[int, int], float] = {}

    def edges(a: int, b: int) -> float:
        if (a, b) not in seen:
            seen[a, b] = _edges(text[a:b].strip())
        return seen[a, b]

    best, best_bits = None, math.inf
    for lead, begin in _leads(text):
        start = begin
        while start < len(text) and text[start].isspace():
            start += 1
        base = codes.lead(lead)
        readings = [("single", [(start, len(text))], 0), *((n, s, 0) for n, s in _labelled(text, start)), *_delimited(text, begin, start)]
        for name, spans, cuts in readings:
            bits = base + codes.dialect(name) + codes.number(len(spans)) + (1.0 * cuts if "mixed" in name else 0.0) + (1.5 * len(spans) if "any" in name else 0.0)
            for a, b in spans:
                # tokens whose start lies in the span
                lo = _lower(starts, a)
                hi = _lower(starts, b)
                if lo == hi:
                    bits += 24.0
                    continue
                if lo not in opens:
                    opens[lo] = codes.word(FIRST, words[lo])
                bits += opens[lo] + inner[hi] - inner[lo + 1]
                bits += edges(a, b)
                if bits > best_bits:
                    break
            if bits < best_bits:
                best, best_bits = (lead, name, spans), bits
    lead, name, spans = best
    values = [" ".join(_unquote(" ".join(text[a:b].split()))[0].split()) for a, b in spans]
    return lead, name, values


def _edges(value: str) -> float:
    """Bits of marks at a value's edges that its dialect leaves unexplained."""
    if _EDGE.match(value):
        return 8.0
    if value[0].isalnum() and (value[-1].isalnum() or value[-1] in ").%"):
        return 0.0
    if value[0] in _QUOTES:
        return 2.0 if _unquote(value)[1] else 10.0
    return (0.0 if value[0].isalnum() or value[0] in "(¿¡" else 8.0) + (4.0 if value[-1] in ",;|/:-•" or value[-1] in "\"'”»" else 0.0)


def _lower(starts: list[int], at: int) -> int:
    from bisect import bisect_left

    return bisect_left(starts, at)


def _count(codes: Codes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch["packed"]:
                if (got := cheapest(text, codes)) is None:
                    continue
                lead, name, values = got
                found[f"lead\t{crc32(lead.encode()) % BUCKETS if lead else ''}"] += 1
                found[f"dialect\t{name}"] += 1
                found[f"number\t{min(len(values), 30)}"] += 1
                for value in values:
                    _, _, words, contexts = _contexts(value)
                    for i, (w, c) in enumerate(zip(words, contexts, strict=True)):
                        c = c if i else FIRST
                        found[f"w{c}\t{crc32(w.lower().encode()) % BUCKETS}"] += 1
                        found[f"s{c}\t{_shape(w)}"] += 1
        if found:
            yield pd.DataFrame({"code": list(found.keys()), "n": list(found.values())})

    return run


def value_codes(df: DataFrame, packed: Column) -> dict[str, int]:
    """Counts over all fields, by code; at most 7 x BUCKETS words and as many lead-ins, so a fixed size."""
    counted = spread(df.select(packed.alias("packed")).where("packed is not null")).mapInPandas(_count(Codes()), "code string, n long")
    return {r["code"]: r["n"] for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def split_packed(df: DataFrame, id_col: str, packed: Column, version: Column | None = None, content: Column | None = None, prefix: str = "value") -> DataFrame:
    """One row per value of each packed field: id, ``<prefix>_pos`` from 0, ``<prefix>_text``.

    A null, empty or blank field has no rows.  Of rows that share an id one counts (``keyed.one_per_id``): the
    earliest ``version``, then by ``content`` (the field itself if none is given); a row sent again adds nothing.
    Other columns of ``df`` are not read.
    """
    codes = df.sparkSession.sparkContext.broadcast(value_codes(df, packed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Codes(codes.value)
        for batch in batches:
            got = [cheapest(t, c) if isinstance(t, str) else None for t in batch["packed"]]
            yield batch[["id", "version", "said"]].assign(vals=[g[2] if g else [] for g in got])

    version = F.lit(None).cast("timestamp") if version is None else version
    said = content_hash(packed if content is None else content)
    rows = df.select(F.col(id_col).alias("id"), version.cast("timestamp").alias("version"), said.alias("said"), packed.alias("packed"))
    kind = rows.schema["id"].dataType.simpleString()
    read = spread(rows.where("id is not null")).mapInPandas(run, f"id {kind}, version timestamp, said string, vals array<string>")
    one = one_per_id(read, "id", F.col("version"), F.col("said"), {"vals": F.col("vals")})
    return one.select(F.col("id").alias(id_col), F.posexplode("vals").alias(f"{prefix}_pos", f"{prefix}_text"))


def options_of(examples: DataFrame) -> DataFrame:
    """The options of the positive multiple-choice rows: what follows the first question mark."""
    rows = examples.where((F.col("polarity") == "positive") & (F.col("task_kind") == "Multiple Selection"))
    at = F.locate("?", F.col("input"))
    return split_packed(rows, "example_id", F.when(at > 0, F.expr("substring(input, locate('?', input) + 1)")), F.col("loaded_at"), F.col("input"))
