"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import small_batches
from lectern.session import spread

#: A byte-pair vocabulary for many languages, as ranks; any file of that form can be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the public pattern that splits text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the tokens of ``text`` counted; null and empty texts have none."""
    small_batches(df.sparkSession)

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = encoding(vocabulary)
        for part in parts:
            yield pd.Series([len(tokenizer.encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return spread(df).withColumn(name, count(F.col(text)))
