"""Nested records to flat tables by columnar shredding.

Each record is shredded into one column per leaf path: the leaf's values with
a repetition level (the list that went on) and a definition level (how far the
path is there) for each entry.  A repeated ancestor at depth ``k`` has two
definition steps: ``2k - 1`` says that its list has a slot, ``2k`` that the slot
is not null; ``2k + 1`` says that the leaf is not null.  The tables are read back
from these sequences alone, one per repeated ancestor, with the path of every
node and of its parent as the link.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.session import cut, spread


@dataclass(frozen=True)
class Repeated:
    """A list (or a single value in its place): its path below the parent, its leaves and inner lists.

    Without ``leaves`` the elements themselves are the values.
    """

    code: str
    name: str
    path: tuple[str, ...] = ()
    leaves: tuple[str, ...] = ()
    inner: tuple[Repeated, ...] = field(default_factory=tuple)


_PARTS = ("Input", "Output", "Explanation")
#: An instruction file: tasks with categories, definitions, examples, their variants and shuffles.
INSTRUCTION_FILE = Repeated(
    "t",
    "task",
    inner=(
        Repeated("c", "category", ("Instruction information", "Categories")),
        Repeated("d", "definition", ("Definition",)),
        Repeated("p", "positive", ("Positive Example",), _PARTS, (Repeated("v", "variant", ("Variants",), _PARTS, (Repeated("s", "shuffle", ("Shuffles",), _PARTS),)),)),
        Repeated("n", "negative", ("Negative Example",), _PARTS),
    ),
)

_LEVELS = "array<struct<leaf:string,reps:array<int>,defs:array<int>,vals:array<string>>>"


def chains(root: Repeated) -> list[tuple[Repeated, ...]]:
    """Every repeated ancestor with those above it, outermost first."""
    out = [(root,)]
    for child in root.inner:
        out += [(root, *chain) for chain in chains(child)]
    return out


def _slots(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _under(value: object, path: tuple[str, ...]) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def shred_value(value: object, chain: tuple[Repeated, ...], leaf: str, keep: bool) -> tuple[list[int], list[int], list[str | None]]:
    """Repetition levels, definition levels and values of one leaf path of one record."""
    reps: list[int] = []
    defs: list[int] = []
    vals: list[str | None] = []

    def walk(at: object, depth: int, rep: int) -> None:
        if depth == len(chain):
            got = at.get(leaf) if leaf and isinstance(at, dict) else None if leaf else at
            reps.append(rep)
            defs.append(2 * depth + (got is not None))
            vals.append(_text(got) if keep else None)
            return
        slots = _slots(_under(at, chain[depth].path))
        if not slots:
            reps.append(rep)
            defs.append(2 * depth)
            vals.append(None)
        for i, slot in enumerate(slots):
            r = rep if i == 0 else depth + 1
            if slot is None:
                reps.append(r)
                defs.append(2 * depth + 1)
                vals.append(None)
            else:
                walk(slot, depth + 1, r)

    walk(value, 0, 0)
    return reps, defs, vals


def nodes(reps: list[int], defs: list[int], depth: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Positions and entry of each non-null node at ``depth``, from the levels of one leaf path."""
    at = [0] * (depth + 1)
    for i, (r, d) in enumerate(zip(reps, defs, strict=True)):
        if r == 0:
            at = [0] * (depth + 1)
        elif r <= depth:
            at[r] += 1
            for k in range(r + 1, depth + 1):
                at[k] = 0
        if r <= depth and d >= 2 * depth:
            yield tuple(at[1:]), i


def _dotted(chain: tuple[Repeated, ...], at: tuple[int, ...]) -> str:
    return ".".join(f"{level.code}{k}" for level, k in zip(chain, at, strict=False))


def read_record(text: object) -> tuple[object, str | None]:
    """The value of a JSON text, or why it does not read."""
    if not isinstance(text, str):
        return None, "no text"
    if not text.strip():
        return None, "blank"
    try:
        return json.loads(text), None
    except RecursionError:
        return None, "nested too deep"
    except ValueError:
        return None, "no JSON"


def shred(df: DataFrame, id_col: str, json_col: str, spec: Repeated = INSTRUCTION_FILE, keep_values: bool = True, names: tuple[str, ...] | None = None) -> DataFrame:
    """Columns of levels: one row for each record and repeated ancestor, with its leaves' level sequences.

    A record that does not read has no rows here but one in ``rejects``; a JSON ``null`` has no nodes.  ``names`` limits the ancestors.
    """
    wanted = [c for c in chains(spec) if names is None or c[-1].name in names]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ancestors, leaves = [], [], []
            for rid, text in zip(batch["id"], batch["raw"], strict=True):
                value, _ = read_record(text)
                if value is None:
                    continue
                for chain in wanted:
                    cols = []
                    for leaf in chain[-1].leaves if keep_values and chain[-1].leaves else ("",):
                        reps, defs, vals = shred_value(value, chain, leaf, keep_values)
                        cols.append({"leaf": leaf, "reps": reps, "defs": defs, "vals": vals})
                    ids.append(rid)
                    ancestors.append(chain[-1].name)
                    leaves.append(cols)
            if ids:
                yield pd.DataFrame({"record": ids, "ancestor": ancestors, "leaves": leaves})

    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("raw")).where("id is not null and raw is not null")
    return spread(rows).mapInPandas(run, f"record {kind}, ancestor string, leaves {_LEVELS}")


def rejects(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, reason)`` for each record that does not read: no text, blank, no JSON or nested too deep."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            why = [read_record(t)[1] for t in batch["raw"]]
            out = pd.DataFrame({"id": batch["id"], "reason": pd.Series(why, dtype=object, index=batch.index)})
            yield out[out["reason"].notna()]

    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("raw")).where("id is not null")
    return spread(rows).mapInPandas(run, f"id {kind}, reason string").withColumnRenamed("id", id_col)


def rebuild(shredded: DataFrame, spec: Repeated = INSTRUCTION_FILE) -> DataFrame:
    """Nodes of all ancestors from their level sequences: record, ancestor, parent_path, node_path, leaf values by name."""
    by_name = {c[-1].name: c for c in chains(spec)}
    kind = shredded.schema["record"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for record, ancestor, leaves in zip(batch["record"], batch["ancestor"], batch["leaves"], strict=True):
                chain = by_name[ancestor]
                depth = len(chain)
                rows: dict[tuple[int, ...], dict[str, str]] = {}
                for col in leaves:
                    vals = col["vals"]
                    for at, i in nodes(col["reps"], col["defs"], depth):
                        got = rows.setdefault(at, {})
                        if vals[i] is not None and (col["leaf"] or not chain[-1].leaves):
                            got[col["leaf"].lower() or "value"] = vals[i]
                out += [(record, ancestor, _dotted(chain, at[:-1]), _dotted(chain, at), got) for at, got in rows.items()]
            if out:
                yield pd.DataFrame(out, columns=["record", "ancestor", "parent_path", "node_path", "leaf_values"])

    return shredded.mapInPandas(run, f"record {kind}, ancestor string, parent_path string, node_path string, leaf_values map<string,string>")


def flat_tables(df: DataFrame, id_col: str, json_col: str, spec: Repeated = INSTRUCTION_FILE, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """One flat table per repeated ancestor: id, parent_path, node_path and a column per leaf.

    parent_path is empty for the outermost ancestor.  Rows of ``df`` that are
    repeated are shredded as often as they occur; other columns are not read.  ``names`` limits the tables.
    Each record is read once: the level columns are written before more than one table is made of them.
    """
    wanted = [c for c in chains(spec) if names is None or c[-1].name in names]
    shredded = shred(df, id_col, json_col, spec, True, tuple(c[-1].name for c in wanted))
    if len(wanted) > 1:
        shredded = cut(shredded, "levels")
    out = {}
    for chain in wanted:
        level = chain[-1]
        rows = rebuild(shredded.where(F.col("ancestor") == level.name), spec)
        values = [F.col("leaf_values")[c.lower()].alias(c.lower()) for c in level.leaves] or ([F.col("leaf_values")["value"].alias("value")] if not level.inner else [])
        out[level.name] = rows.select(F.col("record").alias(id_col), "parent_path", "node_path", *values)
    return out


def all_nodes(df: DataFrame, id_col: str, json_col: str, spec: Repeated = INSTRUCTION_FILE) -> DataFrame:
    """Every node of every record: id, parent_path, node_path; the level columns of all leaves are made and read back."""
    rows = rebuild(shred(df, id_col, json_col, spec), spec)
    return rows.select(F.col("record").alias(id_col), "parent_path", "node_path")
