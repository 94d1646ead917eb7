"""Field-weighted BM25 as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term saturation, length normalisation, and the floor for very common terms.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def idf(n_with: Column, n_docs: Column) -> Column:
    raw = F.ln((n_docs - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def term_score(f: Column, dl: Column, n_with: Column, n_docs: Column, n_tokens: Column) -> Column:
    """Contribution of one leaf; ``f`` is its field-weighted frequency in the document."""
    relative = dl / (n_tokens / n_docs)
    return idf(n_with, n_docs) * (f * (K1 + 1.0)) / (f + K1 * (1.0 - B + B * relative))
