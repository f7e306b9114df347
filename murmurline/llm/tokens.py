"""Token counts of whole texts under a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of vocabulary files; the same path must exist on every executor.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    """The tokenizer of a ranks file, loaded once in each worker process."""
    import tiktoken

    # Kept on the library's module: this function travels by value and has no lasting globals there.
    loaded = vars(tiktoken).setdefault("_by_path", {})
    if path not in loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def with_token_counts(df: DataFrame, keep: dict[str, Column], text: str, path: str | None = None) -> DataFrame:
    """``keep`` (name to column) plus ``tokens``: the length of the whole text; NULL and empty texts have 0."""
    path = path or os.path.join(TOKENIZER_DIR, VOCABULARY)
    rows = df.select(*[c.alias(name) for name, c in keep.items()], F.coalesce(F.col(text), F.lit("")).alias("text__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", tokens int"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            enc = encoding(path)
            sizes = [len(enc.encode_ordinary(t)) for t in pdf["text__"]]
            yield pdf.drop(columns="text__").assign(tokens=pd.Series(sizes, index=pdf.index, dtype="int32"))

    return rows.mapInPandas(count, schema)
