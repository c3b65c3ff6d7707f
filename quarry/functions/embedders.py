"""Text to vector. A model is any ``Column -> Column`` function giving ARRAY<FLOAT or DOUBLE>.

``model_embedder`` wraps a Python model as an Arrow-batched pandas UDF; the two native
embedders stay in the JVM and serve tests and small set-ups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from quarry.functions import fixed as X
from quarry.functions.text import embed_text

# --- fixed values: keyword groups -----------------------------------------------------------
KEYWORD_GROUPS = [
    "auth|token|login|session|credential|password|user",
    "math|sum|add|subtract|multiply|number|calculate",
    "file|path|index|search|sync|chunk",
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def keyword_vector(text: Column) -> Column:
    low = F.lower(text)
    flags = [F.when(low.rlike(g), 1.0).otherwise(0.0) for g in KEYWORD_GROUPS]
    return F.array(*flags, F.least(F.lit(1.0), F.length(text) / F.lit(200.0)))


def letter_vector(text: Column) -> Column:
    """Counts of a to z, case folded: 26 dimensions. A letter is a byte, so bytes are compared, which need not be counted."""
    low = F.lower(text)
    n = F.octet_length(low)
    return F.array(*[(n - F.octet_length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def model_embedder(load: Callable[[], Callable[[list[str]], list]], max_tokens: int = 8192,
                   batch: int = X.EMBED_BATCH) -> Callable[[Column], Column]:
    """``load`` runs once per Python worker and gives a function over a list of texts."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in texts:
            vals = s.tolist()
            out = []
            for i in range(0, len(vals), batch):
                out.extend(model(vals[i : i + batch]))
            yield pd.Series(out, index=s.index)

    return lambda text: run(embed_text(text, max_tokens))


def wrong_dimension(df, vector: str, dim: int):
    """Rows whose vector has not the declared dimension; must be empty."""
    return df.where(F.col(vector).isNull() | (F.size(vector) != dim))
