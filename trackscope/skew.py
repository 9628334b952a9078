"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: A key is hot when it holds more than one of so many equal parts of the rows: the shuffle partitions, between these bounds.
LEAST_PARTS, MOST_PARTS = 64, 4096


def parts_of(df: DataFrame) -> int:
    """The share of the rows (1 / parts) that one task should get."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_PARTS), MOST_PARTS)


def hot_counts(df: DataFrame, key: str, parts: int | None = None) -> list[tuple]:
    """(key, share of the rows in parts, rounded up) of the keys that hold more than ``1 / parts`` of the rows; at most ``parts``, so they may go to the driver.

    Counts are pre-aggregated before the shuffle. Nulls and empty tables give no hot key.
    """
    parts = parts or parts_of(df)
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    top = counts.observe(seen, F.sum("n").alias("total")).orderBy(F.desc("n")).limit(parts).collect()
    return [(row["k"], -(-row["n"] * parts // seen.get["total"])) for row in top if row["n"] * parts > seen.get["total"]] if top else []


def hot_keys(df: DataFrame, key: str, parts: int | None = None) -> list:
    """The keys of ``hot_counts``."""
    return [k for k, _ in hot_counts(df, key, parts)]


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: Column, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; rows of ``left`` with a hot key are spread by the hash of ``salt_by`` over as many tasks as the key has parts of the rows.

    Only the rows of ``right`` with a hot key are repeated, once for each of these tasks. ``how`` is inner, left,
    left_semi or left_anti, which keep one meaning under salting of the left side. Null keys match nothing. The salt is a
    hash of the row, so a task that runs again after a lost executor gives the same rows.
    """
    hot = hot_counts(left, key, parts)
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType
    table = F.broadcast(left.sparkSession.createDataFrame([(k, max(n, 2)) for k, n in hot], StructType([StructField(key, kind), StructField("_salts", IntegerType())])))
    salted = left.join(table, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = right.join(table, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
