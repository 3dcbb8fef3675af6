"""Sizes of texts in tokens of public tokenizers."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def byte_tokens(text: Column | str) -> Column:
    """Size under ByT5's tokenizer: a token for each byte in UTF-8 and one end
    token. A null text has no size (null)."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.octet_length(text) + 1).cast("bigint")


@lru_cache(maxsize=4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, vocabulary: str, pattern: str) -> Column:
    """Size under a byte-level BPE whose ranks are in the file ``vocabulary``
    (a path that every executor can read). A null text has no size."""

    @pandas_udf("bigint")
    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary, pattern)
        for texts in parts:
            yield pd.Series([None if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="Int64")

    return sizes(text)
