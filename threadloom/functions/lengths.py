"""Token-length estimators for context packs: Column in, integer Column out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType

TokenLength = Callable[[Column], Column]


def estimate_tokens(line: Column) -> Column:
    """Four characters per token, rounded up; stays in the JVM."""
    return F.ceil(F.length(line) / F.lit(4.0)).cast("int")


def _encoding(rank_file: str, pattern: str):
    import base64

    import tiktoken

    with open(rank_file, "rb") as handle:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, handle)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(rank_file: str, pattern: str) -> TokenLength:
    """Exact byte-pair lengths from a rank file that every worker can open."""
    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(rank_file, pattern)
        for lines in batches:
            yield lines.map(lambda t: len(encoding.encode_ordinary(t or "")))

    return count
