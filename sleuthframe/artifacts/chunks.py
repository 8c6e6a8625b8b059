"""Texts that apps store in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_chunks(rows: DataFrame, keys: list[str], order: Column, chunk: str, separator: str = "") -> DataFrame:
    """``keys`` with the pieces of each joined in ``order``; a null piece is left out."""
    pieces = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col(chunk).alias("piece"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), separator).alias(chunk))
