"""Comparison of embeddings with labelled references, and the losses over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of references that one pass sends to the executors; classes beyond go into further passes.
PASS_BYTES = 64 << 20

STATS = ("max", "min", "mean", "median", "variance", "std", "q1", "q3")
L2_STATS = ("min", "max", "mean", "median", "variance", "std")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1, the length taken as 1e-12 at least."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / length)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _stats(values: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    q1, q2, q3 = np.percentile(values, [25, 50, 75], axis=1)
    every = {"max": values.max(1), "min": values.min(1), "mean": values.mean(1), "median": q2, "variance": values.var(1), "std": values.std(1), "q1": q1, "q3": q3}
    return [every[n] for n in names]


def class_match_stats(queries: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, true_class, member, class_name, s_*, l_*): of each query and class the statistics of cosine and of distance to its references.

    ``queries``: key, true_class, unit, raw; ``references``: member, class_name, unit, raw. Cosine is taken between unit
    vectors, distance between raw ones. Every query meets every reference as one matrix product for each batch; the
    references, a bounded set by the design of the filter, go out in passes of ``PASS_BYTES`` (whole classes). Queries
    are not shuffled. Null vectors give no row.
    """
    by_class: dict[tuple, list] = {}
    for r in references.where("unit IS NOT NULL AND raw IS NOT NULL").select("member", "class_name", "unit", "raw").orderBy("member", "class_name").toLocalIterator():
        by_class.setdefault((r["member"], r["class_name"]), []).append((r["unit"], r["raw"]))
    passes, size = [[]], 0
    for (member, name), vectors in by_class.items():
        u, w = (np.array([v[i] for v in vectors], np.float64) for i in (0, 1))
        if passes[-1] and size + u.nbytes + w.nbytes > PASS_BYTES:
            passes.append([])
            size = 0
        passes[-1].append((member, name, u, w))
        size += u.nbytes + w.nbytes
    columns = [*(f"s_{s}" for s in STATS), *(f"l_{s}" for s in L2_STATS)]
    kinds = {f: queries.schema[f].dataType.simpleString() for f in (key, "true_class")}
    schema = f"{key} {kinds[key]}, true_class {kinds['true_class']}, member int, class_name string, " + ", ".join(f"{c} double" for c in columns)
    result = None
    for part in passes:
        shared = queries.sparkSession.sparkContext.broadcast(part)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, w = (np.array(batch.column(i).to_pylist(), np.float64).reshape(batch.num_rows, -1) for i in (2, 3))
                if not batch.num_rows:
                    continue
                for member, name, ru, rw in shared.value:
                    sims = u @ ru.T
                    distances = np.sqrt(np.maximum(((w[:, None, :] - rw[None, :, :]) ** 2).sum(2), 0)) if len(rw) * batch.num_rows * w.shape[1] < 1 << 24 else np.stack([np.sqrt(((rw - x) ** 2).sum(1)) for x in w])
                    arrays = [*_stats(sims, STATS), *_stats(distances, L2_STATS)]
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([member] * n, pa.int32()), pa.array([name] * n), *(pa.array(a) for a in arrays)], names=[key, "true_class", "member", "class_name", *columns])

        rows = queries.where("unit IS NOT NULL AND raw IS NOT NULL").select(key, "true_class", "unit", "raw").mapInArrow(compare, schema)
        result = rows if result is None else result.unionByName(rows)
    return result


def ensemble_merge(stats: DataFrame, key: str) -> DataFrame:
    """(key, true_class, class_name, ...): the members' statistics combined: of largest cosines mean, max, min, median, spread; of distances mean of means, min of mins and so on."""
    return stats.groupBy(key, "true_class", "class_name").agg(
        F.avg("s_max").alias("mean"), F.max("s_max").alias("max"), F.min("s_max").alias("min"), F.median("s_max").alias("median"), F.stddev_pop("s_max").alias("std"), F.var_pop("s_max").alias("variance"),
        F.avg("l_mean").alias("l2_mean"), F.max("l_max").alias("l2_max"), F.min("l_min").alias("l2_min"), F.median("l_median").alias("l2_median"), F.avg("l_std").alias("l2_std"), F.avg("l_variance").alias("l2_variance"),
    )


def best_class(merged: DataFrame, key: str) -> DataFrame:
    """(key, true_class, best, similarity, l2_distance): the class of the least distance, then of the largest cosine, then the first by name."""
    order = F.struct(F.col("l2_min"), -F.col("max"), F.col("class_name"))
    best = F.min_by(F.struct("class_name", "max", "l2_min"), order).alias("_b")
    return merged.groupBy(key, "true_class").agg(best).select(key, "true_class", F.col("_b.class_name").alias("best"), F.col("_b.max").alias("similarity"), F.col("_b.l2_min").alias("l2_distance"))


def open_set_decide(best: DataFrame, similarity: float, l2: float, unknown: str = "unknown") -> DataFrame:
    """With ``predicted_class``, ``unknown`` below the cosine or above the distance, and ``correct`` without regard to case."""
    rejected = (F.col("similarity") < similarity) | (F.col("l2_distance") > l2)
    predicted = F.when(rejected, F.lit(unknown)).otherwise(F.col("best"))
    return best.withColumn("predicted_class", predicted).withColumn("correct", F.lower("predicted_class") == F.lower("true_class"))


def candidate_scores(stats: DataFrame, key: str, similarity: float, median: float, variance: float, l2: float) -> DataFrame:
    """(key, member, class_name, strict, score): the best candidate class of each query; the relaxed rule holds where no class passes the strict one."""
    c = F.col
    iqr = c("s_q3") - c("s_q1")
    strict = (c("s_median") > median) & (c("s_q1") > similarity * 0.95) & (iqr < variance * 2) & (c("s_mean") > similarity) & (c("s_variance") < variance) & (c("l_mean") < l2)
    relaxed = (c("s_median") > median * 1.02) & (c("s_q3") > similarity * 1.05) & (c("s_q1") > similarity * 0.85) & (iqr < variance * 3) & (c("s_mean") > similarity * 1.02) & (c("l_mean") < l2 * 1.2)
    strict_score = (c("s_mean") * 0.3 + c("s_median") * 0.3 + c("s_q1") * 0.2 + (1 - iqr) * 0.2) * 0.7 + (1 - c("l_mean") / l2) * 0.3
    relaxed_score = (c("s_mean") * 0.25 + c("s_median") * 0.25 + c("s_q3") * 0.3 + c("s_q1") * 0.1 + (1 - iqr) * 0.1) * 0.7 + (1 - c("l_mean") / (l2 * 1.2)) * 0.3
    query = Window.partitionBy(key, "member")
    rated = stats.withColumn("strict", F.max(strict.cast("int")).over(query) == 1).withColumn("score", F.when(c("strict") & strict, strict_score).when(~c("strict") & relaxed, relaxed_score)).where("score IS NOT NULL")
    best = F.min_by(F.struct("class_name", "strict", "score"), F.struct(-c("score"), c("class_name"))).alias("_b")
    return rated.groupBy(key, "member").agg(best).select(key, "member", "_b.*")


# ---- losses -------------------------------------------------------------------------------------------------------


def class_centers(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, center): the mean of each dimension; partial sums are formed before the shuffle."""
    return vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("center"))


def center_vectors(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    return class_centers(vectors, label, vector).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "center"))), lambda s: s["center"]).alias("center"))


def radius_loss(vectors: DataFrame, label: str, vector: str, radius: float) -> DataFrame:
    """Mean by which vectors lie further than ``radius`` from their class's center, plus 1e-6."""
    over = F.greatest(l2_distance(F.col(vector), F.col("center")) - radius, F.lit(0.0))
    return vectors.join(center_vectors(vectors, label, vector), label).agg((F.avg(over) + 1e-6).alias("loss"))


def center_distance_loss(vectors: DataFrame, label: str, vector: str, margin: float) -> DataFrame:
    """Mean over pairs of classes by which their centers are nearer than ``margin``, plus 1e-6; 0 with fewer than two classes."""
    centers = center_vectors(vectors, label, vector)
    a, b = centers.select(F.col(label).alias("a"), F.col("center").alias("ca")), centers.select(F.col(label).alias("b"), F.col("center").alias("cb"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # as many rows as pairs of classes
    return pairs.agg(F.coalesce(F.avg(F.greatest(F.lit(margin) - l2_distance(F.col("ca"), F.col("cb")), F.lit(0.0))) + 1e-6, F.lit(0.0)).alias("loss"))


def consistency_loss(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of 2 - 2 cos over pairs of vectors."""
    return pairs.agg(F.avg(2 - 2 * dot(unit(F.col(a)), unit(F.col(b)))).alias("loss"))
