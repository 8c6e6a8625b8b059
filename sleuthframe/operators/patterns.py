"""Indicators in text: addresses of cryptocurrencies, phone numbers, e-mail addresses and words, with the text around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What indicators look like.
PATTERNS = {
    "bitcoin": r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}",
    "ethereum": r"0x[a-fA-F0-9]{40}",
    "litecoin": r"[LM3][a-km-zA-HJ-NP-Z1-9]{26,33}",
    "international_phone": r"\+\d{1,3}\d{4,14}",
    "indian_mobile": r"(?:\+91|91)?[6-9]\d{9}",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
}
KEYWORDS = ("drug", "weapon", "bomb", "terror", "hack", "fraud")


def whole_matches(rows: DataFrame, text: str = "text", kinds: Sequence[str] = tuple(PATTERNS)) -> DataFrame:
    """``rows`` with a column ``kinds`` of the patterns that the whole text fits."""
    return rows.withColumn("kinds", F.array_compact(F.array(*(F.when(F.col(text).rlike(f"^(?:{PATTERNS[k]})$"), k) for k in kinds))))


def occurrences(rows: DataFrame, kind: str, id_column: str, text: str = "text") -> DataFrame:
    """(id, pos, value): every occurrence of a pattern within texts."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return rows.select(F.col(id_column).alias("id"), F.posexplode(found).alias("pos", "value"))


def keyword_contexts(rows: DataFrame, id_column: str, text: str = "text", keywords: Sequence[str] = KEYWORDS, width: int = 50) -> DataFrame:
    """(id, keyword, at, context): the first occurrence of each word, and ``width`` characters on either side."""
    words = rows.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.explode(F.array(*map(F.lit, keywords))).alias("keyword"))
    placed = words.withColumn("at", F.instr(F.lower("text"), F.col("keyword"))).where("at > 0")
    begin = F.greatest(F.col("at") - width, F.lit(1))
    return placed.select("id", "keyword", (F.col("at") - 1).alias("at"), F.substring("text", begin, F.col("at") - begin + F.length("keyword") + width).alias("context"))
