"""Queries over embeddings, eval_results and class_thresholds: open-set matching and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, vectors
from ..tables import table

_LABEL = "CASE WHEN label >= 7 THEN 'unknown' ELSE 'class_' || CAST(label AS STRING) END"


def _vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", "label", F.expr(_LABEL).alias("true_class"), vectors.unit(F.col("embedding")).alias("unit"), F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("raw"))


def _stats(spark, folder, members=3):
    v = _vectors(spark, folder)
    refs = v.where("vec_id % 5 = 0 AND label < 7").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).where(f"floor(vec_id / 5) % 3 <> member OR {members} = 1")
    return vectors.class_match_stats(v.where("vec_id % 5 <> 0"), refs.withColumnRenamed("true_class", "class_name"), "vec_id")


def _rounded(df, *keys):
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in df.columns if c not in keys))


def _merged(spark, folder):
    return vectors.ensemble_merge(_stats(spark, folder), "vec_id")


def decisions(spark, folder):
    """eval_results with the class that today's thresholds let pass as prediction."""
    known = metrics.class_thresholds_join(table(spark, folder, "eval_results"), table(spark, folder, "class_thresholds"))
    return known.select("result_id", "true_class", F.col("known_class").alias("predicted_class"), "similarity", "l2_distance")


IN_SCOPE = ["amber_dace", "copper_bream", "glass_gudgeon", "moss_tench", "thorn_loach"]


def _history(spark, folder):
    """(epoch, loss): the mean order price of each day."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("epoch")
    return table(spark, folder, "orders").groupBy(day).agg((F.avg("o_totalprice") / 1e5).alias("loss"))


def queries():
    on = lambda f: lambda spark, folder: f(decisions(spark, folder))
    loss = lambda f: lambda spark, folder: f(_vectors(spark, folder)).select(F.round("loss", 6).alias("loss"))
    near = lambda spark, folder: _rounded(vectors.best_class(vectors.ensemble_merge(_stats(spark, folder, 1), "vec_id"), "vec_id"), "vec_id", "true_class", "best")
    pairs = lambda v: v.select(F.col("vec_id").alias("a"), F.col("unit").alias("ua")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("unit").alias("ub")), "a")
    return {
        "class_match_stats": lambda spark, folder: _rounded(_stats(spark, folder), "vec_id", "true_class", "member", "class_name"),
        "ensemble_merge": lambda spark, folder: _rounded(_merged(spark, folder), "vec_id", "true_class", "class_name"),
        "nearest_reference": near,
        "open_set_decide": lambda spark, folder: vectors.open_set_decide(vectors.best_class(_merged(spark, folder), "vec_id"), 0.20, 0.76).select("vec_id", "true_class", "predicted_class", "correct"),
        "candidate_scores": lambda spark, folder: vectors.candidate_scores(_stats(spark, folder), "vec_id", 0.01, 0.0, 0.2, 0.98).select("vec_id", "member", "class_name", "strict", F.round("score", 6).alias("score")),
        "class_thresholds_join": lambda spark, folder: decisions(spark, folder).select("result_id", "predicted_class"),
        "screening_summary": on(lambda d: metrics.screening_summary(d, IN_SCOPE)),
        "class_accuracy_sets": on(metrics.accuracy_sets),
        "weighted_prf": on(metrics.weighted_prf),
        "confusion_long": on(metrics.confusion),
        "confusion_pivot": on(lambda d: metrics.confusion_pivot(d, IN_SCOPE)),
        "top_confused": on(metrics.top_confused),
        "confidence_bins": on(metrics.confidence_bins),
        "calibration": on(metrics.calibration),
        "similarity_means": on(metrics.similarity_means),
        "similarity_histogram": on(metrics.similarity_histogram),
        "unknown_distribution": on(metrics.unknown_distribution),
        "class_centers": lambda spark, folder: vectors.class_centers(_vectors(spark, folder), "label", "unit").select("label", F.col("pos").cast("int").alias("pos"), F.round("center", 6).alias("center")),
        "radius_loss": loss(lambda v: vectors.radius_loss(v, "label", "unit", 0.5)),
        "center_distance_loss": loss(lambda v: vectors.center_distance_loss(v, "label", "unit", 1.0)),
        "consistency_loss": loss(lambda v: vectors.consistency_loss(pairs(v), "ua", "ub")),
    }


_V = """v AS (SELECT vec_id, label, CASE WHEN label >= 7 THEN 'unknown' ELSE 'class_' || label END AS true_class, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS unit, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS raw FROM embeddings)"""
_S = """pr AS (SELECT q.vec_id, q.true_class, member, r.true_class AS class_name, list_dot_product(q.unit, r.unit) AS s, list_distance(q.raw, r.raw) AS l FROM (SELECT * FROM v WHERE vec_id % 5 <> 0) q, (SELECT * FROM v, (VALUES {members}) m(member) WHERE vec_id % 5 = 0 AND label < 7 AND {rule}) r),
st AS (SELECT vec_id, true_class, member, class_name, max(s) AS s_max, min(s) AS s_min, avg(s) AS s_mean, median(s) AS s_median, var_pop(s) AS s_variance, stddev_pop(s) AS s_std, quantile_cont(s, 0.25) AS s_q1, quantile_cont(s, 0.75) AS s_q3,
 min(l) AS l_min, max(l) AS l_max, avg(l) AS l_mean, median(l) AS l_median, var_pop(l) AS l_variance, stddev_pop(l) AS l_std FROM pr GROUP BY 1, 2, 3, 4),
mg AS (SELECT vec_id, true_class, class_name, avg(s_max) AS mean, max(s_max) AS max, min(s_max) AS min, median(s_max) AS median, stddev_pop(s_max) AS std, var_pop(s_max) AS variance, avg(l_mean) AS l2_mean, max(l_max) AS l2_max, min(l_min) AS l2_min, median(l_median) AS l2_median, avg(l_std) AS l2_std, avg(l_variance) AS l2_variance FROM st GROUP BY 1, 2, 3),
bc AS (SELECT vec_id, true_class, class_name AS best, max AS similarity, l2_min AS l2_distance FROM mg QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY l2_min, max DESC, class_name) = 1)"""
_E3 = f"WITH {_V}, " + _S.format(members="(0), (1), (2)", rule="(vec_id // 5) % 3 <> member")
_E1 = f"WITH {_V}, " + _S.format(members="(0)", rule="true")
_D = """WITH t AS (SELECT * FROM class_thresholds), df AS (SELECT max(similarity_threshold) AS s, max(l2_distance_threshold) AS d FROM t WHERE class_name = 'default'),
d AS (SELECT result_id, true_class, CASE WHEN NOT isnan(similarity) AND NOT isnan(l2_distance) AND similarity >= coalesce(CASE WHEN e.class_name IS NULL THEN l.similarity_threshold ELSE e.similarity_threshold END, s) AND l2_distance <= coalesce(CASE WHEN e.class_name IS NULL THEN l.l2_distance_threshold ELSE e.l2_distance_threshold END, d) THEN predicted_class ELSE 'unknown' END AS predicted_class, similarity, l2_distance
 FROM eval_results r LEFT JOIN t e ON e.class_name = trim(r.predicted_class) LEFT JOIN t l ON l.class_name = lower(trim(r.predicted_class)) CROSS JOIN df),
k AS (SELECT *, coalesce(lower(predicted_class) = lower(true_class), false) AS ok FROM d)"""


def _round_sql(columns: str, rest: str) -> str:
    return ", ".join([*columns.split(), *(f"round({c}, 6) AS {c}" for c in rest.split())])


def oracle_sql():
    scope = "(" + ", ".join(f"'{c}'" for c in IN_SCOPE) + ")"
    cells = ", ".join(f"count(*) FILTER (predicted_class = '{c}') AS {c}" for c in IN_SCOPE)
    acc = "count(*) AS total, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy, round(1.96 * sqrt(avg(ok::INT) * (1 - avg(ok::INT)) / count(*)), 6) AS margin"
    grid = "lb AS (SELECT DISTINCT true_class AS c FROM d WHERE true_class IS NOT NULL), cf AS (SELECT a.c AS true_class, b.c AS predicted_class, count(d.result_id) AS n FROM lb a CROSS JOIN lb b LEFT JOIN d ON d.true_class = a.c AND d.predicted_class = b.c GROUP BY 1, 2)"
    iqr = "(s_q3 - s_q1)"
    strict = f"s_median > 0.0 AND s_q1 > 0.01 * 0.95 AND {iqr} < 0.2 * 2 AND s_mean > 0.01 AND s_variance < 0.2 AND l_mean < 0.98"
    relaxed = f"s_median > 0.0 AND s_q3 > 0.01 * 1.05 AND s_q1 > 0.01 * 0.85 AND {iqr} < 0.2 * 3 AND s_mean > 0.01 * 1.02 AND l_mean < 0.98 * 1.2"
    ctr = "ct AS (SELECT label, pos, avg(x) AS center FROM (SELECT label, unnest(unit) AS x, unnest(range(len(unit))) AS pos FROM v) GROUP BY 1, 2), cv AS (SELECT label, list(center ORDER BY pos) AS center FROM ct GROUP BY 1)"
    return {
        "class_match_stats": f"{_E3} SELECT {_round_sql('vec_id true_class member class_name', 's_max s_min s_mean s_median s_variance s_std s_q1 s_q3 l_min l_max l_mean l_median l_variance l_std')} FROM st",
        "ensemble_merge": f"{_E3} SELECT {_round_sql('vec_id true_class class_name', 'mean max min median std variance l2_mean l2_max l2_min l2_median l2_std l2_variance')} FROM mg",
        "nearest_reference": f"{_E1} SELECT {_round_sql('vec_id true_class best', 'similarity l2_distance')} FROM bc",
        "open_set_decide": f"{_E3} SELECT vec_id, true_class, p AS predicted_class, lower(p) = lower(true_class) AS correct FROM (SELECT *, CASE WHEN similarity < 0.20 OR l2_distance > 0.76 THEN 'unknown' ELSE best END AS p FROM bc)",
        "candidate_scores": f"""{_E3}, x AS (SELECT *, max(({strict})::INT) OVER (PARTITION BY vec_id, member) = 1 AS strict FROM st), y AS (SELECT vec_id, member, class_name, strict,
 CASE WHEN strict AND {strict} THEN (s_mean * 0.3::DOUBLE + s_median * 0.3::DOUBLE + s_q1 * 0.2::DOUBLE + (1 - {iqr}) * 0.2::DOUBLE) * 0.7::DOUBLE + (1 - l_mean / 0.98::DOUBLE) * 0.3::DOUBLE
 WHEN NOT strict AND {relaxed} THEN (s_mean * 0.25::DOUBLE + s_median * 0.25::DOUBLE + s_q3 * 0.3::DOUBLE + s_q1 * 0.1::DOUBLE + (1 - {iqr}) * 0.1::DOUBLE) * 0.7::DOUBLE + (1 - l_mean / (0.98::DOUBLE * 1.2::DOUBLE)) * 0.3::DOUBLE END AS score FROM x)
 SELECT vec_id, member, class_name, strict, round(score, 6) AS score FROM y WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id, member ORDER BY y.score DESC, class_name) = 1""",
        "class_thresholds_join": f"{_D} SELECT result_id, predicted_class FROM d",
        "screening_summary": f"""{_D}, c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp FROM (SELECT coalesce(true_class IN {scope}, false) AS t, coalesce(predicted_class IN {scope}, false) AS p FROM d))
 SELECT *, round(tp / nullif(tp + fn, 0), 6) AS in_scope_recall, round(tn / nullif(tn + fp, 0), 6) AS out_of_scope_rejection, round(tp / nullif(tp + fp, 0), 6) AS candidate_purity FROM c""",
        "class_accuracy_sets": f"{_D}, z AS (SELECT * FROM k WHERE true_class IS NOT NULL) SELECT 'class' AS part, true_class AS class_name, {acc} FROM z GROUP BY 2 UNION ALL SELECT CASE WHEN true_class = 'unknown' THEN 'unknown' ELSE 'known' END, NULL, {acc} FROM z GROUP BY 1 UNION ALL SELECT 'all', NULL, {acc} FROM z",
        "weighted_prf": f"""{_D}, z AS (SELECT * FROM d WHERE true_class IS NOT NULL AND predicted_class IS NOT NULL), t2 AS (SELECT true_class AS label, count(*) AS support, count(*) FILTER (true_class = predicted_class) AS hits FROM z GROUP BY 1), s2 AS (SELECT predicted_class AS label, count(*) AS said FROM z GROUP BY 1),
 m AS (SELECT coalesce(support, 0) AS support, coalesce(hits / nullif(said, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM t2 FULL JOIN s2 USING (label)) SELECT round(sum(support * p) / sum(support), 6) AS precision, round(sum(support * r) / sum(support), 6) AS recall, round(sum(support * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(support), 6) AS f1, sum(support)::BIGINT AS support FROM m""",
        "confusion_long": f"{_D}, {grid} SELECT true_class, predicted_class, n, round(n / nullif(sum(n) OVER (PARTITION BY true_class), 0), 6) AS share FROM cf",
        "confusion_pivot": f"{_D} SELECT true_class, {cells} FROM d WHERE true_class IN {scope} GROUP BY 1",
        "top_confused": f"{_D}, {grid} SELECT true_class, predicted_class, n FROM cf WHERE true_class <> predicted_class AND n > 0 ORDER BY n DESC, 1, 2 LIMIT 10",
        "confidence_bins": f"{_D} SELECT floor(least(greatest(similarity, 0), 0.999999::DOUBLE) * 10)::INT AS bin, count(*) AS total, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy FROM k WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY 1",
        "calibration": f"{_D} SELECT round((b + 0.5::DOUBLE) / 10, 6) AS midpoint, round(avg(ok::INT), 6) AS accuracy, count(*) AS total FROM (SELECT *, floor(least(greatest(similarity, 0), 0.999999::DOUBLE) * 10) AS b FROM k WHERE similarity IS NOT NULL AND NOT isnan(similarity)) GROUP BY b",
        "similarity_means": f"{_D} SELECT ok AS right, round(avg(similarity), 6) AS mean, count(*) AS n FROM k WHERE similarity BETWEEN -1 AND 1 GROUP BY 1",
        "similarity_histogram": f"{_D}, z AS (SELECT * FROM k WHERE similarity BETWEEN -1 AND 1), r AS (SELECT min(similarity) AS a, max(similarity) AS b FROM z) SELECT least(floor((similarity - a) / (b - a) * 20), 19)::INT AS bin, ok AS right, count(*) AS n FROM z, r GROUP BY 1, 2",
        "unknown_distribution": f"{_D} SELECT true_class, count(*) AS n FROM d WHERE predicted_class = 'unknown' GROUP BY 1",
        "class_centers": f"WITH {_V}, {ctr} SELECT label, pos::INT AS pos, round(center, 6) AS center FROM ct",
        "radius_loss": f"WITH {_V}, {ctr} SELECT round(avg(greatest(list_distance(unit, center) - 0.5::DOUBLE, 0)) + 0.000001::DOUBLE, 6) AS loss FROM v JOIN cv USING (label)",
        "center_distance_loss": f"WITH {_V}, {ctr} SELECT round(avg(greatest(1 - list_distance(a.center, b.center), 0)) + 0.000001::DOUBLE, 6) AS loss FROM cv a JOIN cv b ON a.label < b.label",
        "consistency_loss": f"WITH {_V} SELECT round(avg(2 - 2 * list_dot_product(a.unit, b.unit)), 6) AS loss FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    }
