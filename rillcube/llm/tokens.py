"""Sizes of texts in tokens of a public tokenizer, as an Arrow UDF."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"


def default_path() -> str:
    """The vocabulary file that the installed package of public tokenizers has; another can be given wherever this is a default."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("sizes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text (bigint); a null text has none."""
    where = path or default_path()

    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(where).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(count, returnType="bigint")(text.cast("string"))
