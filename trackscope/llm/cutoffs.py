"""Cutoffs that keep a target fraction of each source's records (problem 5).

Method: scores are coded as integers of ``BITS`` bits, strictest first; a persistent dyadic tree holds the number of
records of each node (source, level, first bits of the code). A batch is added by appending its nodes' counts to the
stored tree. The target rank of every source is sought by descending from the root; the leaf that it ends in is refined
to distinct scores, so the cutoff is exact for any doubles. The tree keeps the levels of ``LEVELS`` (a descent passes
``STRIDE`` binary levels at a time, over at most ``2 ** STRIDE`` nodes of a source); below them only the leaves that a
descent reaches are opened, from the scores in them, so a batch never costs more than its own rows and those leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..session import cut_lineage

BITS, STRIDE = 42, 6
#: The levels that are stored; 4096 nodes of a source and measure lie in the last.
LEVELS = (0, 6, 12)
#: Sources with a target up to which they are sent to the executors.
BROADCAST_SOURCES = 100_000

#: measure -> (is usable, place in [0, 1] with the strictest at 0), of a score. Each step of a place rounds without
#: changing the order, so places are in the order of scores.
MEASURES = {
    "similarity": (lambda s: ~F.isnan(s) & s.between(-1.0, 1.0), lambda s: (1 - s) / 2),
    "l2_distance": (lambda s: ~F.isnan(s) & (s >= 0) & (s < float("inf")), lambda s: 1 - 1 / (s + 1)),
}


def latest(results: DataFrame) -> DataFrame:
    """Of rows with equal experiment and image_path the one evaluated last, then with the largest id.

    A null is equal to a null in these two columns; a null time is the earliest. Sources are brought to one spelling.
    """
    last = F.max(F.struct(F.col("evaluated_at"), F.col("result_id"), F.col("source"), *(F.col(m) for m in MEASURES), F.col("true_class"))).alias("_last")
    return results.groupBy("experiment", "image_path").agg(last).select("_last.*").withColumn("source", names.slug(F.col("source")))


def usable_scores(rows: DataFrame) -> DataFrame:
    """(measure, source, result_id, true_class, score): one row for each usable score of a row with a source, both measures in one pass."""
    known = rows.where("source IS NOT NULL AND source <> ''")
    score = lambda m, usable: F.when(F.col(m).isNotNull() & usable(F.col(m)), F.when(F.col(m) == 0, F.lit(0.0)).otherwise(F.col(m)))
    both = F.array(*(F.struct(F.lit(m).alias("measure"), score(m, usable).alias("score")) for m, (usable, _) in MEASURES.items()))
    return known.select("source", "result_id", "true_class", F.explode(both).alias("_s")).where("_s.score IS NOT NULL").select("_s.measure", "source", "result_id", "true_class", "_s.score")


def strictness(measure: Column, score: Column) -> Column:
    """Grows from the strictest score on."""
    return F.when(measure == "similarity", -score).otherwise(score)


def coded(scores: DataFrame) -> DataFrame:
    """``scores`` with ``code``, the place of the score in ``BITS`` bits."""
    place = reduce(lambda other, m: F.when(F.col("measure") == m, MEASURES[m][1](F.col("score"))).otherwise(other), MEASURES, F.lit(0.0))
    return scores.withColumn("code", F.least(F.floor(place * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long"))


def tree_nodes(scores: DataFrame) -> DataFrame:
    """(measure, source, level, node, n): the counts of all stored nodes above the scores of a batch, counted in each task before the shuffle."""
    deepest = coded(scores).groupBy("measure", "source", F.shiftright("code", BITS - LEVELS[-1]).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    above = F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright("leaf", LEVELS[-1] - level).alias("node")) for level in LEVELS))
    return deepest.select("measure", "source", "n", F.inline(above)).groupBy("measure", "source", "level", "node").agg(F.sum("n").alias("n"))


def add_batch(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tree with a batch's nodes added; both may be stored tables."""
    return tree.unionByName(nodes).groupBy("measure", "source", "level", "node").agg(F.sum("n").alias("n"))


def store_batch(scores: DataFrame, path: str) -> None:
    """Appends the nodes of a batch of scores to the tree stored at ``path``; nothing that stands there is read."""
    tree_nodes(scores).write.mode("append").parquet(path)


def stored_tree(spark: SparkSession, path: str) -> DataFrame:
    """The tree of all batches stored at ``path``."""
    return spark.read.parquet(path).groupBy("measure", "source", "level", "node").agg(F.sum("n").alias("n"))


def target_ranks(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(measure, source, target_fraction, n, rank): how many of the strictest records of each source must be kept, one at least.

    Of several targets of one source the largest holds; null targets and sources are no targets.
    """
    wanted = targets.select(names.slug(F.col("source")).alias("source"), "target_fraction").where("source <> '' AND NOT isnan(target_fraction)").groupBy("source").agg(F.max("target_fraction").alias("target_fraction"))
    roots = tree.where("level = 0").select("measure", "source", F.col("n").alias("usable"))
    rank = F.least(F.greatest(F.ceil(F.col("target_fraction") * F.col("usable")), F.lit(1)), F.col("usable"))
    return roots.join(wanted, "source").select("measure", "source", "target_fraction", "usable", rank.alias("rank"))


def _step(place: DataFrame, nodes: DataFrame) -> DataFrame:
    """``place`` moved into the child that holds its rank; ``nodes``: measure, source, code (the parent), node, n, at most ``2 ** STRIDE`` for each row of ``place``."""
    upto = F.sum("n").over(Window.partitionBy("measure", "source").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    under = place.join(nodes, ["measure", "source", "code"]).withColumn("upto", upto)
    reached = under.where("upto >= inside AND upto - n < inside")
    return reached.withColumn("inside", F.col("inside") - F.col("upto") + F.col("n")).withColumn("code", F.col("node")).drop("node", "n", "upto")


def descend(tree: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranks`` with ``code``, the stored leaf that holds the record of that rank, and ``inside``, its rank in the leaf."""
    place = ranks.withColumn("code", F.lit(0).cast("long")).withColumn("inside", F.col("rank"))
    for level in LEVELS[1:]:
        place = _step(place, tree.where(F.col("level") == level).select("measure", "source", F.shiftright("node", STRIDE).alias("code"), "node", "n"))
    return place


def refine(scores: DataFrame, leaves: DataFrame) -> DataFrame:
    """(measure, source, target_fraction, usable, rank, cutoff): the distinct score at which the rank is reached.

    Only scores in the reached leaves are read on; these are opened level by level, and the distinct scores of the last
    one are put in order.
    """
    leaves = cut_lineage(leaves)
    few = leaves.count() <= BROADCAST_SOURCES
    small = lambda df: F.broadcast(df) if few else df
    keys = ["measure", "source"]
    at = lambda df, level: df.join(small(leaves if level == LEVELS[-1] else place).select(*keys, F.col("code").alias("_leaf")), keys).where(F.shiftright("code", BITS - level) == F.col("_leaf")).drop("_leaf")
    inside, place = cut_lineage(at(coded(scores).select(*keys, "code", "score"), LEVELS[-1])), leaves
    for level in range(LEVELS[-1] + STRIDE, BITS + 1, STRIDE):
        nodes = at(inside, level - STRIDE).groupBy(*keys, F.shiftright("code", BITS - level).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        place = cut_lineage(_step(place, nodes.select(*keys, F.shiftright("node", STRIDE).alias("code"), "node", "n")))
    counts = at(inside, BITS).groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    order = strictness(F.col("measure"), F.col("score"))
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ordered = place.join(counts, keys).withColumn("upto", F.sum("n").over(window))
    return ordered.where("upto >= inside AND upto - n < inside").select(*keys, "target_fraction", "usable", "rank", F.col("score").alias("cutoff"))


def cutoffs(scores: DataFrame, targets: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(measure, source, target_fraction, usable, rank, cutoff) for each source with a target and a usable score.

    ``tree``: the stored tree of the same scores; without it the tree is counted here. An empty table gives no row.
    """
    tree = cut_lineage(tree_nodes(scores)) if tree is None else tree
    return refine(scores, descend(tree, target_ranks(tree, targets)))


def kept(results: DataFrame, targets: DataFrame) -> DataFrame:
    """The usable scores that are as strict as their source's cutoff, ties at the cutoff included."""
    scores = cut_lineage(usable_scores(latest(results)).drop("true_class"))
    bounds = cut_lineage(cutoffs(scores, targets)).select("measure", "source", "cutoff")
    measure = F.col("measure")
    return scores.join(bounds, ["measure", "source"]).where(strictness(measure, F.col("score")) <= strictness(measure, F.col("cutoff")))


def cutoff_report(results: DataFrame, targets: DataFrame, class_thresholds: DataFrame) -> DataFrame:
    """Per measure and source: target, usable rows, cutoff, kept rows, and how many rows today's cutoffs per class keep.

    Today's cutoff of a row is that of its true class (in one spelling), else, and for null fields, that of ``default``.
    """
    scores = cut_lineage(usable_scores(latest(results)))
    bounds = cut_lineage(cutoffs(scores, targets))
    today = class_thresholds.select(names.slug(F.col("class_name")).alias("true_class"), F.col("similarity_threshold").alias("similarity"), F.col("l2_distance_threshold").alias("l2_distance"))
    fallback = today.where("true_class = 'default'").agg(F.max("similarity").alias("_similarity"), F.max("l2_distance").alias("_l2_distance"))
    rows = scores.withColumn("true_class", names.slug(F.col("true_class"))).join(bounds, ["measure", "source"]).join(today, "true_class", "left").crossJoin(fallback)
    measure, order = F.col("measure"), strictness(F.col("measure"), F.col("score"))
    now = F.when(measure == "similarity", F.coalesce("similarity", "_similarity")).otherwise(F.coalesce("l2_distance", "_l2_distance"))
    return rows.groupBy("measure", "source", "target_fraction", "usable", "cutoff").agg(
        F.count_if(order <= strictness(measure, F.col("cutoff"))).alias("kept"),
        F.count_if(order <= strictness(measure, now)).alias("kept_today"),
    )


def found(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(measure, result_id) of p5_found."""
    return kept(results, targets).select("measure", "result_id")
