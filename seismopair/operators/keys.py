"""Whole-number keys for names, and small stored values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import with_ordinal


def encoded(stored: DataFrame, values: DataFrame, name: str = "evid", key: str = "event_id") -> DataFrame:
    """The key table (key, name) with a number for each value of `values` too: stored names keep theirs, new ones follow the largest in the order of names. Null names have none."""
    new = values.select(name).where(F.col(name).isNotNull()).distinct().join(stored.select(name), name, "left_anti")
    numbered = with_ordinal(new, name, name="_n")
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
    more = numbered.crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n") + 1).cast("bigint").alias(key), name)
    return stored.select(F.col(key).cast("bigint").alias(key), name).unionByName(more)


def with_keys(rows: DataFrame, keys: DataFrame, columns: dict[str, str], name: str = "evid", key: str = "event_id") -> DataFrame:
    """rows with a key column for each name column of `columns` (name column to key column); unknown names have null."""
    for column, to in columns.items():
        rows = rows.join(keys.select(F.col(name).alias(column), F.col(key).alias(to)), column, "left")
    return rows


def evids_of_pair(pairs: DataFrame, keys: DataFrame, pair_id: int, n: int) -> DataFrame:
    """The two evids of the pair whose canonical number is low * n + high, by keys below n."""
    low, high = divmod(pair_id, n)
    known = pairs.where((F.least("event_id1", "event_id2") == low) & (F.greatest("event_id1", "event_id2") == high)).limit(1)
    ends = [keys.select(F.col("event_id").alias(f"event_id{k}"), F.col("evid").alias(f"evid{k}")) for k in (1, 2)]
    return known.join(ends[0], "event_id1").join(ends[1], "event_id2").select("evid1", "evid2")


def put_values(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value) rows of both; a new value replaces the stored one of its key, of repeated new ones the last by value."""
    last = new.groupBy("key").agg(F.max("value").alias("value"))
    return stored.join(last.select("key"), "key", "left_anti").unionByName(last)
