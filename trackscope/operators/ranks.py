"""Values at given ranks of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096


def values_at_ranks(scores: DataFrame, ranks: DataFrame, groups: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``ranks`` (groups, rank from 1) with ``value``: the rank-th largest score of each group.

    A group is never sorted as a whole: equal scores are counted first, scores fall into ``BUCKETS`` ranges of
    [low, high] (values outside fall into the outermost), the ranges' counts are summed up, and only ranges in which a
    rank ends are ordered. Ranks beyond the group give no row.
    """
    counted = scores.groupBy(*groups, "score").agg(F.count(F.lit(1)).alias("n"))
    place = F.floor((F.lit(high) - F.col("score")) / (high - low) * BUCKETS)
    counted = counted.withColumn("bucket", F.greatest(F.lit(0), F.least(place, F.lit(BUCKETS - 1))))
    ahead = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heaps = counted.groupBy(*groups, "bucket").agg(F.sum("n").alias("heap")).withColumn("before", F.coalesce(F.sum("heap").over(ahead), F.lit(0)))
    found = ranks.join(heaps, groups).where("rank > before AND rank <= before + heap").select(*ranks.columns, "bucket", "before")
    within = Window.partitionBy(*groups, "rank").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    inside = found.join(counted, [*groups, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(within))
    return inside.where("upto >= rank AND upto - n < rank").select(*ranks.columns, F.col("score").alias("value"))
