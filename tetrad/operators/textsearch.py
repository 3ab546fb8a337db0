"""Full text: case-insensitive substrings of literals, by a scan or by a table of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(text: Column, wanted: str) -> Column:
    """Whether a text contains another one, whatever their case."""
    return F.contains(F.lower(text), F.lit(wanted.lower()))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    chars = F.split(F.lower(text), "")
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.zip_with(pairs, F.slice(chars, 3, n), lambda x, y: F.concat(x, y)))


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(trigram, key) postings, ranged by trigram so that a lookup reads few files."""
    return df.select(F.explode(trigrams(F.col(text))).alias("trigram"), F.col(key)).repartitionByRange("trigram").sortWithinPartitions("trigram")


def search(postings: DataFrame, df: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """Rows that contain a text: those with all its trigrams, then checked. Short texts scan."""
    low = wanted.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return df.where(matches(F.col(text), wanted))
    hits = postings.where(F.col("trigram").isin(grams)).groupBy(key).agg(F.count_distinct("trigram").alias("n")).where(F.col("n") >= len(grams)).select(key)
    return df.join(hits, key, "left_semi").where(matches(F.col(text), wanted))
