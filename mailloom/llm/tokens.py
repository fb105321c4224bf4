"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER):
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return texts.map(lambda t: len(e.encode_ordinary(t)) if t else 0)

    # not pushed around nor worked out twice by the optimizer: texts are tokenized once
    return count.asNondeterministic()


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; 0 for null and empty. Whole texts are counted."""
    return token_counter(path)(text)


def sized(documents: DataFrame, key: str, text: str, *more: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, more..., n_tokens)."""
    from mailloom.plans.storage import spread

    return spread(documents.select(key, *more, text)).select(F.col(key), *more, n_tokens(F.col(text), tokenizer).alias("n_tokens"))
