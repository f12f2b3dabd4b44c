"""Pages to chunks, vectors and contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.text import python_tokens
from seedloom.operators.metrics import hashed_embedding
from seedloom.session import cut

#: Queries that are searched at once; bounds what a task holds.
QUERY_BLOCK = 8192
#: Numbers of the base that a task holds where the queries are more than one block.
CELL = 1 << 24
#: Where a text is cut, from the coarsest mark to none.
SEPARATORS = ("\n\n", "\n", " ", "")


def page_documents(items: DataFrame) -> DataFrame:
    """Crawl items as documents: page_content ('' for no text) and metadata with the source."""
    return items.withColumns({"page_content": F.coalesce("text", F.lit("")), "metadata": F.create_map(F.lit("source"), F.col("url"))})


def latest_pages(items: DataFrame) -> DataFrame:
    """One row per page_id: the latest crawl, ties by the largest url and text."""
    last = F.max(F.struct("crawled_at", "url", "text", "file")).alias("x")
    return items.where("page_id is not null").groupBy("page_id").agg(last).select("page_id", "x.*")


def fixed_chunks(text: Column | str, width: int = 1000) -> Column:
    """Pieces of ``width`` characters, the last one shorter; none for an empty or null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int")), lambda k: F.substring(text, k * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def recursive_chunks(text: str, width: int = 1000, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``width`` characters, cut at the coarsest mark that helps; marks between pieces of a chunk stay."""
    if len(text) <= width:
        return [text.strip()] if text.strip() else []
    mark, finer = separators[0], separators[1:]
    if mark and mark not in text:
        return recursive_chunks(text, width, finer)
    parts = text.split(mark) if mark else [text[i : i + width] for i in range(0, len(text), width)]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for part in parts:
        grown = size + len(part) + (len(mark) if held else 0)
        if grown <= width:
            held.append(part)
            size = grown
            continue
        if held:
            out.append(mark.join(held).strip())
        held, size = [], 0
        if len(part) > width:
            out += recursive_chunks(part, width, finer)
        else:
            held, size = [part], len(part)
    if held:
        out.append(mark.join(held).strip())
    return [c for c in out if c]


def chunks(docs: DataFrame, id_col: str, text_col: str, width: int = 1000) -> DataFrame:
    """``(id, chunk_no, chunk)`` by recursive cutting; no row for a null or blank text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, c) for i, t in zip(batch["id"], batch["text"], strict=True) for k, c in enumerate(recursive_chunks(t, width))]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "chunk_no", "chunk"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(split, f"id {kind}, chunk_no int, chunk string").withColumnRenamed("id", id_col)


def embed_text(text: str) -> np.ndarray:
    """The sum of the text's token vectors; stands in for a model."""
    parts = [hashed_embedding(t) for t in python_tokens(text)]
    return np.sum(parts, axis=0) if parts else np.zeros(32)


def embed(rows: DataFrame, text_col: str, keep: list[str], model: Callable[[str], np.ndarray] = embed_text) -> DataFrame:
    """The kept columns with ``embedding``."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(embedding=[model(t or "").astype(np.float32) for t in batch["_text"]])

    return rows.select(*keep, F.col(text_col).alias("_text")).mapInPandas(run, f"{schema}, embedding array<float>")


class _Best:
    """The k rows most alike for each query of a block, from any number of batches; ties go to the smaller key."""

    def __init__(self, queries: pd.DataFrame, key: list[str], k: int) -> None:
        self.key, self.k = key, k
        v, self.ids, groups = _units(queries, ["query_id"])
        self.v = v
        self.known = pd.Index(pd.unique(groups)) if len(groups) else pd.Index([])
        self.group = self.known.get_indexer(groups)
        self.least = np.full(len(v), -np.inf)
        self.rows = pd.DataFrame({"x": pd.Series(dtype=np.int64), "similarity": pd.Series(dtype=float), **{c: pd.Series(dtype=object) for c in key}})

    def add(self, batch: pd.DataFrame) -> None:
        if not len(self.v):
            return
        m, keys, groups = _units(batch[[len(v) == self.v.shape[1] for v in batch["v"]]], self.key)
        of = self.known.get_indexer(groups)
        found = []
        for at in range(0, len(m), 1024):
            sims = np.round(self.v @ m[at : at + 1024].T, 9)
            sims[self.group[:, None] == of[None, at : at + 1024]] = -np.inf
            least = self.least
            if sims.shape[1] > self.k:
                least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k])
            x, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            found.append(keys.iloc[at + j].assign(x=x, similarity=sims[x, j]))
            if sum(map(len, found)) > 4 * self.k * len(self.v):
                self._keep(found)
                found = []
        self._keep(found)

    def _keep(self, found: list[pd.DataFrame]) -> None:
        if not sum(map(len, found)):
            return
        rows = pd.concat([self.rows, *found] if len(self.rows) else found)
        rows = rows.sort_values(["x", "similarity", *self.key], ascending=[True, False, *[True] * len(self.key)], kind="stable")
        place = rows.groupby("x").cumcount()
        self.rows = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.least[full["x"].to_numpy(np.int64)] = full["similarity"].to_numpy(float)

    def result(self) -> pd.DataFrame:
        out = self.rows.assign(query_id=self.ids["query_id"].to_numpy()[self.rows["x"].to_numpy(np.int64)] if len(self.rows) else None)
        return out[["query_id", *self.key, "similarity"]]


def _units(frame: pd.DataFrame, key: list[str]) -> tuple[np.ndarray, pd.DataFrame, np.ndarray]:
    """Unit vectors of the rows that have one, with their keys and groups."""
    if frame.empty:
        return np.zeros((0, 0)), frame[key], np.zeros(0, object)
    m = np.stack([np.asarray(v, np.float64) for v in frame["v"]])
    norm = np.linalg.norm(m, axis=1)
    there = norm > 0
    return m[there] / norm[there, None], frame.loc[there, key], frame["g"].to_numpy()[there]


def vector_topk(base: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 4, block: int = QUERY_BLOCK, group_col: str | None = None, key: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """``(query_id, rank, id, similarity)``: the k rows most alike by cosine for each query, itself left out.

    ``key`` names the columns that tell rows of ``base`` apart, where one is not enough; they stand in the result in
    place of ``id``.  With ``group_col`` all rows of the query's group are left out, before the k best are taken.
    Ties go to the smaller id; rows without a vector, of length zero or of another size are not found and ask nothing.

    One block of queries is broadcast and the base read where it lies.  More are searched as a grid: each task holds a block of queries and a
    part of the base with at most about ``cell`` numbers, and hands on only the k best of each query.
    """
    spark = base.sparkSession
    names = key or [id_col]
    group = F.col(group_col or id_col).alias("g")
    rows = base.where(F.col(vec_col).isNotNull()).select(*[F.col(c).alias(f"i{n}") for n, c in enumerate(names)], F.col(vec_col).alias("v"), group)
    rows = rows.where(" and ".join(f"i{n} is not null" for n in range(len(names))))
    asked = queries.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("v"), group)
    keys = [f"i{n}" for n in range(len(names))]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", similarity double"
    n = asked.count()
    if n <= block:
        held = spark.sparkContext.broadcast(asked.toPandas())

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(held.value, keys, k)
            for batch in batches:
                best.add(batch)
            yield best.result()

        found = rows.mapInPandas(search, schema)
    else:
        there = rows.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
        parts, blocks = max(1, -(-there // cell)), -(-n // block)
        mine = rows.withColumns({"b": F.pmod(F.xxhash64(*keys), F.lit(parts)), "q": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        asks = asked.withColumns({"q": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})

        def cross(base_part: pd.DataFrame, query_part: pd.DataFrame) -> pd.DataFrame:
            best = _Best(query_part, keys, k)
            for at in range(0, len(base_part), 10_000):
                best.add(base_part.iloc[at : at + 10_000])
            return best.result()

        found = mine.groupBy("b", "q").cogroup(asks.groupBy("b", "q")).applyInPandas(cross, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *keys)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    shown = [F.col(c).alias(x) for c, x in zip(keys, names, strict=True)] if key else [F.col("i0").alias("id")]
    return ranked.select("query_id", "rank", *shown, "similarity")


def contexts(pages: DataFrame, asked: Column, k: int = 4, width: int = 1000, cuts: DataFrame | None = None, model: Callable[[str], np.ndarray] = embed_text) -> DataFrame:
    """``(page_id, context, prompt)`` for each page that asks: the k chunks of other pages most like its text, best first.

    ``asked`` is a condition on pages, one row each; their whole text is the question.  ``cuts`` are the chunks (page_id, chunk_no, chunk), cut
    recursively if none are given.  A page asks nothing and a chunk is not found if its vector has length zero.
    """
    cuts = chunks(pages, "page_id", "text", width) if cuts is None else cuts
    keyed = cut(embed(cuts, "chunk", ["page_id", "chunk_no", "chunk"], model), "chunks")
    questions = embed(pages.where(asked & F.col("text").isNotNull()), "text", ["page_id"], model)
    found = vector_topk(keyed, questions, "page_id", "embedding", k, key=["page_id", "chunk_no"])
    named = found.join(keyed.select("page_id", "chunk_no", "chunk"), ["page_id", "chunk_no"])
    told = named.groupBy(F.col("query_id").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("context"))
    out = told.join(pages.select("page_id", "text"), "page_id")
    return out.select("page_id", "context", F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "text", F.lit("\nAnswer:")).alias("prompt"))
