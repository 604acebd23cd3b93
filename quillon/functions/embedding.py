"""Embedders: phrases to L2-normalised vectors. The default needs no model and is a pure expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import let

Embedder = Callable[[Column], Column]


def hashed_ngrams(dim: int = 128, n: int = 3) -> Embedder:
    """Counts of hashed character n-grams of the marked phrase, L2-normalised."""

    def embed(phrase: Column) -> Column:
        marked = F.concat(F.lit("^"), F.lower(F.translate(phrase, "_-", "  ")), F.lit("$"))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(n))), F.lit(dim)))
        counts = let(grams, lambda g: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(g, lambda x: x == d)).cast("double")))
        return let(counts, lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))

    return embed
