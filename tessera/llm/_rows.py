"""Whole rows carried as one struct, so that an operator's own columns cannot clash with a table's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> DataFrame:
    """One column ``row`` that holds all of ``docs``; ``select("row.*")`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
