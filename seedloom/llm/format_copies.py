"""Records that differ only in format: recursive radix partitioning and tries that count.

Every record gets canonical bytes: the words of its fields in order, where a
fact part and a question part come in one order.  Then

1. each task puts its records into a trie and hands on one row per content
   with its count and smallest id, so a content held by a third of all rows
   leaves a task once;
2. buckets by the first bytes are counted; those that hold more than fits are
   split by further bytes, again and again, until each fits or its bytes end;
3. rows move to their bucket, and one trie per partition adds up the counts in
   its terminal nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import join_counted, positive_rows, words
from seedloom.operators.keyed import content_hash, one_per_id
from seedloom.session import cut, input_splits, spread

#: Bytes per edge of a trie.
EDGE = 16
#: Bytes of contents that a trie holds; a task's is handed on then.
HELD = 32 << 20
#: A content counts as so many bytes more, for its nodes.
NODE = 400
#: A bucket of so many bytes always fits; with more data the limit is a partition's share.
FITS = 4 << 20


class Trie:
    """Byte strings with a counter and a smallest id in each terminal node.

    Nodes are made only where two keys part: a lone key hangs as a rest on its edge.
    """

    def __init__(self) -> None:
        self.root: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, key: bytes, low: int, n: int) -> None:
        node, at = self.root, 0
        while True:
            edge = key[at : at + EDGE]
            slot = node.get(edge)  # [rest, smallest id, count] or [inner node]
            if slot is None:
                node[edge] = [key[at + EDGE :], low, n]
                self.bytes += len(key) + NODE
                return
            at += EDGE
            if len(slot) == 3:
                rest = key[at:]
                if slot[0] == rest:
                    slot[1] = min(slot[1], low)
                    slot[2] += n
                    return
                # two keys part below this edge: the one here moves a level down
                inner = {slot[0][:EDGE]: [slot[0][EDGE:], slot[1], slot[2]]}
                node[edge] = [inner]
                node = inner
            else:
                node = slot[0]

    def counts(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for edge, slot in node.items():
                if len(slot) == 3:
                    yield prefix + edge + slot[0], slot[1], slot[2]
                else:
                    stack.append((prefix + edge, slot[0]))


def fields_canonical(*fields: Column) -> Column:
    """Canonical bytes of a record: its fields' words, apart and with nulls marked."""
    return F.encode(F.concat_ws("\u0001", *[F.coalesce(words(f), F.lit("\u0002")) for f in fields]), "UTF-8")


def parts_in_order(text: Column) -> Column:
    """The words of a text with its fact part before its question part, whichever came first.

    A text that opens with ``question`` is cut at its first ``fact``.
    """
    return F.regexp_replace(words(text), r"^(question\b.*?) (fact\b.*)$", "$2 $1")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = Trie()
    for batch in batches:
        for key, low, n in zip(batch["canon"], batch["low"], batch["n"], strict=True):
            trie.add(key, low, n)
        if trie.bytes > HELD:
            yield pd.DataFrame(list(trie.counts()), columns=["canon", "low", "n"])
            trie = Trie()
    yield pd.DataFrame(list(trie.counts()), columns=["canon", "low", "n"])


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of a partition; its buckets are bounded by bytes, so its trie is."""
    trie = Trie()
    for batch in batches:
        for key, low, n in zip(batch["canon"], batch["low"], batch["n"], strict=True):
            trie.add(key, low, n)
    found = [(hashlib.md5(key).digest(), low, n) for key, low, n in trie.counts() if n > 1]
    yield pd.DataFrame(found, columns=["digest", "low", "n"])


def radix_bucket(rows: DataFrame, partitions: int, total: int) -> Column:
    """The bucket of each row's canonical bytes; splits what does not fit by further bytes.

    ``total`` is the bytes of all rows.  At each depth only prefixes with more bytes than fit come to the driver; as
    each holds more than a partition's share, there are at most ``partitions``.
    """
    fits = max(FITS, -(-total // partitions))
    levels: list[tuple[int, list[bytes]]] = []
    depth, rest = 8, rows.select("canon")
    while total > fits:
        prefix = F.substring("canon", 1, depth)
        full = [bytes(r["p"]) for r in rest.groupBy(prefix.alias("p")).agg(F.sum(F.length("canon") + NODE).alias("n")).where(F.col("n") > fits).collect()]
        # a bucket whose bytes have ended is one content, which is not split
        full = [p for p in full if len(p) == depth]
        levels.append((depth, full))
        if not full:
            break
        rest = rest.where(prefix.isin([F.lit(p) for p in full]))
        depth *= 2
    bucket = F.col("canon")
    for depth, full in reversed(levels):
        prefix = F.substring("canon", 1, depth)
        bucket = F.when(prefix.isin([F.lit(p) for p in full]), bucket).otherwise(prefix) if full else prefix
    return bucket if levels else F.col("canon")


def copy_classes(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows ``(id, digest)``, classes of two or more ``(digest, low, n)``, number of rows.

    ``rows`` has the id and ``canon``, one row per id.
    """
    spark = rows.sparkSession
    kept = cut(rows.select(F.col(id_col).alias("id"), "canon", F.unhex(F.md5("canon")).alias("digest")), "canonical")
    total = kept.count()
    local = cut(kept.select("canon", F.col("id").cast("long").alias("low"), F.lit(1).cast("long").alias("n")).mapInPandas(_counted, "canon binary, low long, n long"), "contents")
    held = local.agg(F.sum(F.length("canon") + NODE)).first()[0] or 0
    partitions = max(input_splits(spark), -(-held // HELD))
    moved = local.repartition(partitions, radix_bucket(local, partitions, held))
    return kept.select("id", "digest"), moved.mapInPandas(_merged, "digest binary, low long, n long"), total


def collapse(df: DataFrame, id_col: str, fields: list[str], parts: str | None = None, version: str | None = None) -> DataFrame:
    """One row per content: ``first_id`` (smallest id) and ``copies``, the number of ids that hold it.

    Null fields equal only null ones; texts without a word equal each other.
    ``parts`` names a field whose fact and question part may stand in either
    order.  Rows that share an id count once (``keyed.one_per_id``).  Ids are whole numbers.
    """
    pairs, classes, _ = _classes(df, id_col, fields, parts, version)
    single = pairs.join(classes.select("digest"), "digest", "left_anti").select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return classes.select(F.col("low").alias("first_id"), F.col("n").alias("copies")).unionByName(single)


def copies(df: DataFrame, id_col: str, fields: list[str], parts: str | None = None, version: str | None = None) -> DataFrame:
    """One row per record that is not the first of its content: ``first_id``, ``copy_id``; see ``collapse``."""
    pairs, classes, total = _classes(df, id_col, fields, parts, version)
    joined = join_counted(pairs, classes, "digest", "n", total)
    return joined.where("id <> low").select(F.col("low").alias("first_id"), F.col("id").alias("copy_id"))


def _classes(df: DataFrame, id_col: str, fields: list[str], parts: str | None, version: str | None) -> tuple[DataFrame, DataFrame, int]:
    columns = [parts_in_order(F.col(f)) if f == parts else F.col(f) for f in fields]
    when = F.col(version) if version else F.lit(None).cast("timestamp")
    source = spread(df.where(F.col(id_col).isNotNull()).select(*dict.fromkeys([id_col, *fields, *([version] if version else [])])))
    rows = source.select(F.col(id_col).alias("id"), when.alias("version"), content_hash(*[F.col(f) for f in fields]).alias("said"), fields_canonical(*columns).alias("canon"))
    pairs, classes, total = copy_classes(one_per_id(rows, "id", F.col("version"), F.col("said"), {"canon": F.col("canon")}), "id")
    return pairs, cut(classes, "classes"), total


def example_copies(examples: DataFrame) -> DataFrame:
    return copies(positive_rows(examples), "example_id", ["input", "output", "explanation"], "input", "loaded_at")
