"""Dictionaries: value to dense index by several orders, and the joins that encode and decode with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.operators.order import numbered


def sorted_dictionary(df: DataFrame, *cols: str, index: str = "idx") -> DataFrame:
    """Distinct values with their rank from 0."""
    return numbered(df.select(*cols).distinct(), *cols, name=index)


def frequency_dictionary(df: DataFrame, *cols: str, index: str = "idx") -> DataFrame:
    """Distinct values and their counts, ranked by count, ties by value."""
    return numbered(df.groupBy(*cols).agg(F.count("*").alias("cnt")), F.col("cnt").desc(), *cols, name=index)


def first_seen_dictionary(df: DataFrame, *cols: str, at: str = "pos", index: str = "idx") -> DataFrame:
    """Distinct values ranked by the least position at which they occur."""
    return numbered(df.groupBy(*cols).agg(F.min(at).alias("first_pos")), "first_pos", *cols, name=index)


def encode(df: DataFrame, dictionary: DataFrame, *cols: str) -> DataFrame:
    """df with the dictionary's index; a value without an entry would vanish, so it raises instead.

    No broadcast is asked for: a dictionary may grow with the data. Adaptive execution broadcasts the small ones.
    """
    joined = df.join(dictionary, list(cols), "left")
    missing = F.assert_true(F.col("idx").isNotNull(), F.lit("a value is not in the dictionary"))
    return joined.withColumn("__ok", missing).where("__ok IS NULL").drop("__ok")


def decode(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    return df.join(dictionary, "idx")


def variants(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, variant): the distinct values of each key, numbered from 0 in order."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("vs"))
    return sets.select(key, F.posexplode("vs").alias("variant", value))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their ranks; at most k rows, so it may be broadcast."""
    best = df.groupBy(col).agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), col).limit(k)
    return numbered(best, F.col("cnt").desc(), col, name="sym")


def split_by(df: DataFrame, head: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose value is in head, with its symbol, and the others; together they are df."""
    small = F.broadcast(head.select(col, "sym"))
    return df.join(small, col), df.join(small, col, "left_anti")
