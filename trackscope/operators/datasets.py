"""Experiment plans, seeded splits, collision-free names, class pairs and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def hash_order(*parts: Column) -> Column:
    """A seeded order that any engine can repeat: the md5 of the parts' text."""
    return F.md5(F.concat_ws("|", *parts))


#: Leading digits of a hash by which a class is cut into ranges, 16 ranges a digit.
RANGE_DIGITS = 3


def hash_ranks(files: DataFrame, class_name: str, path: str, seed: int) -> DataFrame:
    """(class, path, _rank from 1, _n): distinct files numbered in their class by ``hash_order``, and the class's files.

    A class is never sorted in one task: files are numbered within ranges of their hash, and a range's first number
    comes from the counts of the ranges before it.
    """
    rows = files.select(class_name, path).distinct().withColumn("_h", hash_order(F.lit(str(seed)), F.col(path))).withColumn("_range", F.substr("_h", F.lit(1), F.lit(RANGE_DIGITS)))
    by_class = Window.partitionBy(class_name)
    counts = rows.groupBy(class_name, "_range").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(class_name, "_range", (F.sum("_c").over(by_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_start"), F.sum("_c").over(by_class).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(class_name, "_range").orderBy("_h", path))
    return rows.withColumn("_inside", inside).join(starts, [class_name, "_range"]).select(class_name, path, (F.col("_start") + F.col("_inside")).alias("_rank"), "_n")


def seeded_split(files: DataFrame, class_name: str, path: str, seed: int = 42, train: float = 0.9) -> DataFrame:
    """(class, path, split_name): of each class the first ``train`` by hash order, one at least; the rest val, one at least where there are two. Equal paths are taken once."""
    most = F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(F.col("_n"))
    first = F.least(F.greatest(F.floor(F.col("_n") * train).cast("long"), F.lit(1)), most)
    return hash_ranks(files, class_name, path, seed).select(class_name, path, F.when(F.col("_rank") <= first, F.lit("train")).otherwise(F.lit("val")).alias("split_name"))


def per_class_cap(files: DataFrame, class_name: str, path: str, most: int, seed: int | None = None) -> DataFrame:
    """At most ``most`` files of each class, the first by path or by seeded hash."""
    order = F.col(path) if seed is None else hash_order(F.lit(str(seed)), F.col(path))
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(class_name).orderBy(order, path))).where(F.col("_n") <= most).drop("_n")


def collision_names(files: DataFrame, class_name: str, name: str) -> DataFrame:
    """``files`` with ``target``: the plain name for its first class, ``<class>_<name>`` for further ones, ``<class>_<stem>_<k><ending>`` for repeats within a class."""
    per_class = F.row_number().over(Window.partitionBy(name, class_name).orderBy("ord"))
    rows = files.withColumn("_k", per_class).withColumn("_first", F.min(class_name).over(Window.partitionBy(name)))
    ending = F.regexp_extract(name, r"(\.[^.]*)?$", 1)
    stem = F.substr(F.col(name), F.lit(1), F.length(name) - F.length(ending))
    numbered = F.concat(F.col(class_name), F.lit("_"), stem, F.lit("_"), (F.col("_k") - 1).cast("string"), ending)
    plain = F.when(F.col(class_name) == F.col("_first"), F.col(name)).otherwise(F.concat(F.col(class_name), F.lit("_"), F.col(name)))
    return rows.withColumn("target", F.when(F.col("_k") > 1, numbered).otherwise(plain)).drop("_k", "_first")


def path_ranks(files: DataFrame, class_name: str, path: str) -> DataFrame:
    """(class, path, _rank from 1, _n): distinct files numbered in their class by path, and the class's files.

    Files are cut into ranges of class and path, as many as there are shuffle partitions, and the ranges written down, so
    that both passes see the same ones: no class is sorted in one task.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(files.select(class_name, path).distinct().repartitionByRange(parts, class_name, path).withColumn("_range", F.spark_partition_id()))
    by_class = Window.partitionBy(class_name)
    counts = rows.groupBy(class_name, "_range").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(class_name, "_range", (F.sum("_c").over(by_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_start"), F.sum("_c").over(by_class).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(class_name, "_range").orderBy(path))
    return rows.withColumn("_inside", inside).join(starts, [class_name, "_range"]).select(class_name, path, (F.col("_start") + F.col("_inside")).alias("_rank"), "_n")


def class_pairs(files: DataFrame, class_name: str, path: str, seed: int = 42) -> DataFrame:
    """(class, path, pair): each file with a different one of its class, at a distance drawn from its hash; classes with one file are left out."""
    ranked = path_ranks(files, class_name, path).where("_n > 1").withColumn("_r", F.col("_rank") - 1)
    draw = F.conv(F.substr(hash_order(F.lit(str(seed)), F.col(path)), F.lit(1), F.lit(7)), 16, 10).cast("long")
    sought = (F.col("_r") + 1 + draw % (F.col("_n") - 1)) % F.col("_n")
    other = ranked.select(class_name, F.col("_r").alias("_s"), F.col(path).alias("pair"))
    return ranked.withColumn("_s", sought).join(other, [class_name, "_s"]).select(class_name, path, "pair")


def experiment_plan(files: DataFrame, specs: DataFrame, class_name: str) -> DataFrame:
    """(experiment, scope, files...) of known and unknown classes. ``specs``: experiment, known array, unknown array."""
    wanted = specs.select("experiment", F.explode(F.concat(F.transform("known", lambda c: F.struct(F.lit("known").alias("scope"), c.alias("class"))), F.transform("unknown", lambda c: F.struct(F.lit("unknown").alias("scope"), c.alias("class"))))).alias("_w"))
    return files.join(wanted.select("experiment", "_w.scope", F.col("_w.class").alias(class_name)), class_name)


def missing_classes(specs: DataFrame, files: DataFrame, class_name: str) -> DataFrame:
    """(experiment, class) that a spec names and no file has, and whether a class is on both sides."""
    both = specs.select("experiment", F.explode(F.array_distinct(F.concat("known", "unknown"))).alias(class_name), F.array_intersect("known", "unknown").alias("_both"))
    return both.join(files.select(class_name).distinct(), class_name, "left_anti").select("experiment", class_name, (F.size("_both") > 0).alias("overlap"))


def resume(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is planned and not among the results without an error."""
    return planned.join(done.where("error IS NULL OR error = ''").select(*key).distinct(), key, "left_anti")


# ---- schedules ----------------------------------------------------------------------------------------------------


def lr_schedule(spark: SparkSession, epochs: int, warmup: int) -> DataFrame:
    """(epoch, factor): a line up over ``warmup`` epochs, then half a cosine down."""
    e = F.col("epoch")
    cosine = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (e - warmup) / max(epochs - warmup, 1)))
    return spark.range(epochs).select(F.col("id").alias("epoch")).withColumn("factor", F.when(e < warmup, (e + 1) / warmup).otherwise(cosine))


def ema(history: DataFrame, order: str, value: str, beta: float) -> DataFrame:
    """One row: the exponential moving average old * beta + new * (1 - beta) over a short history in order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    merged = F.aggregate(F.slice(F.col("_v"), F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0))), F.get("_v", F.lit(0)), lambda a, x: a * beta + x * (1 - beta))
    return history.where(F.col(value).isNotNull()).agg(values.alias("_v")).select(merged.alias("ema"))


def eta(history: DataFrame, order: str, seconds: str, total: int, recent: int = 50) -> DataFrame:
    """(order, mean_seconds, remaining): the mean of the last ``recent`` steps and what is left at that pace."""
    last = Window.orderBy(order).rowsBetween(-(recent - 1), 0)
    done = F.row_number().over(Window.orderBy(order))
    return history.select(order, F.avg(seconds).over(last).alias("mean_seconds"), (F.greatest(F.lit(total) - done, F.lit(0)) * F.avg(seconds).over(last)).alias("remaining"))


def early_stop(history: DataFrame, order: str, loss: str, patience: int) -> DataFrame:
    """(order, best, since, stop): running best loss, epochs since it improved, and whether patience has run out. A history is a few rows."""
    before = F.min(loss).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    marked = history.select(order, loss, (before.isNull() | (F.col(loss) < before)).cast("int").alias("better"))
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    islands = marked.withColumn("best", F.min(loss).over(upto)).withColumn("_island", F.sum("better").over(upto))
    since = F.row_number().over(Window.partitionBy("_island").orderBy(order)) - 1
    return islands.withColumn("since", since.cast("long")).select(order, "best", "since", (F.col("since") >= patience).alias("stop"))


def round_robin(rows: DataFrame, index: str, workers: int) -> DataFrame:
    return rows.withColumn("worker", F.pmod(F.col(index), F.lit(workers)).cast("int"))
