"""Decisions under thresholds, and screening, accuracy and confusion metrics over decisions.

``decisions`` have true_class, predicted_class, similarity; NaN and null scores accept nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "unknown"


def class_thresholds_join(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``results`` with ``known_class``: the predicted class if cosine and distance pass its thresholds, else unknown.

    Thresholds are looked up by the trimmed name, then by its lower case, then ``default``; a null field is the default's.
    """
    fields = ("similarity_threshold", "l2_distance_threshold")
    named = lambda p: thresholds.select(F.col("class_name").alias(p + "name"), *(F.col(f).alias(p + f) for f in fields))
    default = thresholds.where("class_name = 'default'").agg(*(F.max(f).alias("d_" + f) for f in fields))
    name = F.trim("predicted_class")
    joined = results.join(named("e_"), name == F.col("e_name"), "left").join(named("l_"), F.lower(name) == F.col("l_name"), "left").crossJoin(default)
    hit = F.col("e_name").isNotNull()
    least, most = (F.coalesce(F.when(hit, F.col("e_" + f)).otherwise(F.col("l_" + f)), F.col("d_" + f)) for f in fields)
    fine = ~F.isnan("similarity") & ~F.isnan("l2_distance") & (F.col("similarity") >= least) & (F.col("l2_distance") <= most)
    known = F.when(F.coalesce(fine, F.lit(False)), F.col("predicted_class")).otherwise(F.lit(UNKNOWN))
    return joined.select(*(results[c] for c in results.columns), known.alias("known_class"))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, null for a divisor of 0."""
    return F.try_divide(a.cast("double"), b)


def screening_summary(decisions: DataFrame, in_scope: list[str]) -> DataFrame:
    """tp, fn, tn, fp of screening for the classes of ``in_scope`` (exact spelling), recall, rejection and purity."""
    truth, said = F.coalesce(F.col("true_class").isin(in_scope), F.lit(False)), F.coalesce(F.col("predicted_class").isin(in_scope), F.lit(False))
    counts = decisions.agg(F.count_if(truth & said).alias("tp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"), F.count_if(~truth & said).alias("fp"))
    c = F.col
    r = lambda a, b: F.round(ratio(a, b), 6)
    return counts.select("*", r(c("tp"), c("tp") + c("fn")).alias("in_scope_recall"), r(c("tn"), c("tn") + c("fp")).alias("out_of_scope_rejection"), r(c("tp"), c("tp") + c("fp")).alias("candidate_purity"))


def accuracy_sets(decisions: DataFrame) -> DataFrame:
    """(part, class_name, total, correct, accuracy, margin) for each true class, known, unknown and all, with the 95 % margin."""
    right = F.lower("predicted_class") == F.lower("true_class")
    rows = decisions.where("true_class IS NOT NULL").select("true_class", F.coalesce(right, F.lit(False)).alias("right"), (F.col("true_class") != UNKNOWN).alias("known"))
    counts = rows.groupingSets([[F.col("true_class")], [F.col("known")], []], F.col("true_class"), F.col("known")).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct")
    )
    part = F.when(F.col("_set") == 1, F.lit("class")).when(F.col("_set") == 3, F.lit("all")).when(F.col("known"), F.lit("known")).otherwise(F.lit("unknown"))
    p = F.col("correct") / F.col("total")
    return counts.select(part.alias("part"), F.when(F.col("_set") == 1, F.col("true_class")).alias("class_name"), "total", "correct", F.round(p, 6).alias("accuracy"), F.round(1.96 * F.sqrt(p * (1 - p) / F.col("total")), 6).alias("margin"))


def weighted_prf(decisions: DataFrame) -> DataFrame:
    """Precision, recall and F1 weighted by support over the union of true and predicted labels; 0 on zero division."""
    rows = decisions.where("true_class IS NOT NULL AND predicted_class IS NOT NULL")
    truth = rows.groupBy(F.col("true_class").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("true_class") == F.col("predicted_class")).alias("hits"))
    said = rows.groupBy(F.col("predicted_class").alias("label")).agg(F.count(F.lit(1)).alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    by = truth.join(said, "label", "full").select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hits", "said")))
    by = by.withColumn("p", zero(ratio(F.col("hits"), F.col("said")))).withColumn("r", zero(ratio(F.col("hits"), F.col("support")))).withColumn("f", zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))
    mean = lambda c: F.round(F.try_divide(F.sum(F.col("support") * F.col(c)), F.sum("support")), 6)
    return by.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), F.sum("support").alias("support"))


def confusion(decisions: DataFrame) -> DataFrame:
    """(true_class, predicted_class, n, share): every pair of true labels, zeros filled; predictions that are no true label are left out.

    ``share`` is n over the row's sum, null for an empty row.
    """
    rows = decisions.where("true_class IS NOT NULL")
    labels = rows.select("true_class").distinct()
    counts = rows.groupBy("true_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"))
    grid = labels.crossJoin(labels.withColumnRenamed("true_class", "predicted_class"))  # labels, not rows
    full = grid.join(counts, ["true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("true_class"))), 6))


def confusion_pivot(decisions: DataFrame, labels: list[str]) -> DataFrame:
    return decisions.where(F.col("true_class").isin(labels)).groupBy("true_class").pivot("predicted_class", labels).count().na.fill(0)


def top_confused(decisions: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent confusions, ties by the labels' order."""
    off = confusion(decisions).where("true_class <> predicted_class AND n > 0")
    return off.orderBy(F.desc("n"), "true_class", "predicted_class").limit(k).select("true_class", "predicted_class", "n")


def confidence_bins(decisions: DataFrame) -> DataFrame:
    """(bin, total, correct, accuracy) by tenths of the similarity, clipped to [0, 1)."""
    place = F.floor(F.least(F.greatest("similarity", F.lit(0.0)), F.lit(0.999999)) * 10).cast("int")
    rows = decisions.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower("predicted_class") == F.lower("true_class")).alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def calibration(decisions: DataFrame) -> DataFrame:
    """(midpoint, accuracy, total) of each confidence bin with a decision in it."""
    return confidence_bins(decisions).select(F.round((F.col("bin") + 0.5) / 10, 6).alias("midpoint"), "accuracy", "total")


def similarity_means(decisions: DataFrame) -> DataFrame:
    """(right, mean, n) of finite similarities in [-1, 1], by correctness."""
    rows = decisions.where(F.col("similarity").between(-1, 1) & ~F.isnan("similarity"))
    return rows.groupBy(F.coalesce(F.lower("predicted_class") == F.lower("true_class"), F.lit(False)).alias("right")).agg(F.round(F.avg("similarity"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def similarity_histogram(decisions: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, right, n): equal bins over the range of finite similarities in [-1, 1], by correctness; the last holds the largest."""
    rows = decisions.where(F.col("similarity").between(-1, 1) & ~F.isnan("similarity"))
    span = rows.agg(F.min("similarity").alias("a"), F.max("similarity").alias("b"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("similarity") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return rows.crossJoin(span).groupBy(place.alias("bin"), F.coalesce(F.lower("predicted_class") == F.lower("true_class"), F.lit(False)).alias("right")).agg(F.count(F.lit(1)).alias("n"))


def unknown_distribution(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("predicted_class") == UNKNOWN).groupBy("true_class").agg(F.count(F.lit(1)).alias("n"))
