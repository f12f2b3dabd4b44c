"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.session import spread

#: A rank file of a byte-level BPE; the path is a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of that file cuts a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(id, tokens, *keep)`` for each text that is not null; an empty text has no token.

    A repeated id counts once: its smallest size.  The tokenizer's file is read by the driver and shipped to the executors.
    """
    held = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = df.schema[id_col].dataType.simpleString()
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        code = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(code.encode_ordinary(t)) for t in batch["text"]]
            yield batch.drop(columns="text").assign(tokens=sizes)[["id", "tokens", *keep]]

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    sized = spread(rows).mapInPandas(count, f"id {kind}, tokens long" + (f", {kept}" if kept else ""))
    best = F.min(F.struct("tokens", *keep))
    return sized.groupBy("id").agg(best.alias("x")).select("id", "x.*")
