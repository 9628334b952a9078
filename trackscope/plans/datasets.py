"""Queries over file_tasks and schedules: plans, splits, names, pairs, and the functions users bring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plugins
from ..operators import datasets
from ..tables import table
from .traces import rewarded_sql

_NAME = r"regexp_extract(lower(trim(source)), '[^/\\]*$', 0)"
_CLASS = r"translate(regexp_extract(lower(trim(source)), '([^/\\]+)[/\\][^/\\]+$', 1), '- ', '__')"
EXPERIMENTS = [("s2_a", ["gilt_rudder", "moss_tench"], ["amber_dace", "thorn_loach"]), ("s3_b", ["gilt_rudder", "moss_tench", "mud_lantern"], ["amber_dace", "thorn_loach", "veil_minnow"]), ("s2_c", ["dusk_catlet", "sea_ghost"], ["pale_chublin"])]


def files(spark, folder):
    """(ord, path, name, class_name) of the planned files with a name and a class folder."""
    pattern = lambda group: F.regexp_extract(F.lower(F.trim("source")), group, 1)
    t = table(spark, folder, "file_tasks").select(F.col("task_id").alias("ord"), F.lower(F.trim("source")).alias("path"), pattern(r"([^/\\]*)$").alias("name"), F.translate(pattern(r"([^/\\]+)[/\\][^/\\]+$"), "- ", "__").alias("class_name"))
    return t.where("name <> '' AND class_name <> ''")


def _specs(spark):
    return spark.createDataFrame(EXPERIMENTS, "experiment string, known array<string>, unknown array<string>")


def _history(spark, folder):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, folder, "orders").groupBy(day.alias("epoch")).agg((F.avg("o_totalprice") / 1e5).alias("loss"))


def _pandas_reward(spark, folder):
    plugins.register_rewards(spark)
    return table(spark, folder, "res").select("result_id", F.call_function("answer_accuracy", F.col("model_raw_output"), F.try_element_at("source_item", F.lit("ground_truth"))).alias("reward"))


def _udtf(spark, folder):
    plugins.register_table_functions(spark)
    table(spark, folder, "res").createOrReplaceTempView("trackscope_res")
    return spark.sql("SELECT result_id, o.letter, o.species FROM trackscope_res, LATERAL question_options(question) o")


def _split_summary(spark, folder):
    f = files(spark, folder)
    split = datasets.seeded_split(f, "class_name", "path")
    return split.groupBy("class_name").pivot("split_name", ["train", "val"]).count().na.fill(0)


def queries():
    on = lambda f: lambda spark, folder: f(files(spark, folder))
    return {
        "seeded_split": on(lambda f: datasets.seeded_split(f, "class_name", "path")),
        "split_summary": _split_summary,
        "per_class_cap": on(lambda f: datasets.per_class_cap(f.select("class_name", "path").distinct(), "class_name", "path", 25)),
        "collision_names": on(lambda f: datasets.collision_names(f.select("ord", "name", "class_name"), "class_name", "name").select("ord", "target")),
        "class_pairs": on(lambda f: datasets.class_pairs(f, "class_name", "path")),
        "experiment_plan": lambda spark, folder: datasets.experiment_plan(files(spark, folder), _specs(spark), "class_name").groupBy("experiment", "scope", "class_name").agg(F.count(F.lit(1)).alias("files")),
        "missing_classes": lambda spark, folder: datasets.missing_classes(_specs(spark), files(spark, folder), "class_name"),
        "resume_plan": lambda spark, folder: datasets.resume(table(spark, folder, "res").select("video_path", "question").distinct(), table(spark, folder, "res").where("checkpoint IS NOT NULL AND prediction IS NOT NULL"), ["video_path", "question"]),
        "lr_schedule": lambda spark, folder: datasets.lr_schedule(spark, 100, 10).withColumn("factor", F.round("factor", 6)),
        "ema": lambda spark, folder: datasets.ema(_history(spark, folder), "epoch", "loss", 0.996).withColumn("ema", F.round("ema", 6)),
        "eta_stats": lambda spark, folder: datasets.eta(_history(spark, folder), "epoch", "loss", 3000).select("epoch", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("remaining", 4).alias("remaining")),
        "early_stop": lambda spark, folder: datasets.early_stop(_history(spark, folder), "epoch", "loss", 200).withColumn("best", F.round("best", 9)),
        "round_robin_chunks": lambda spark, folder: datasets.round_robin(table(spark, folder, "res").select("benchmark_index"), "benchmark_index", 8).groupBy("worker").agg(F.count(F.lit(1)).alias("rows")),
        "pandas_reward": _pandas_reward,
        "udtf_options": _udtf,
        "map_in_pandas_match": lambda spark, folder: plugins.map_batches(table(spark, folder, "eval_results").select("result_id", "true_class", "predicted_class"), lambda b: b.assign(correct=b.true_class.str.lower().eq(b.predicted_class.str.lower()))[["result_id", "correct"]], "result_id long, correct boolean"),
    }


_FILES = rf"f AS (SELECT * FROM (SELECT task_id AS ord, lower(trim(source)) AS path, {_NAME} AS name, {_CLASS} AS class_name FROM file_tasks) WHERE name <> '' AND class_name <> '')"
_HISTORY = "h AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS epoch, avg(o_totalprice) / 100000::DOUBLE AS loss FROM orders GROUP BY 1)"
_SPLIT = f"WITH {_FILES}, d AS (SELECT DISTINCT class_name, path FROM f), s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY class_name ORDER BY md5('42|' || path), path) <= least(greatest(floor(count(*) OVER (PARTITION BY class_name) * 0.9::DOUBLE), 1), CASE WHEN count(*) OVER (PARTITION BY class_name) > 1 THEN count(*) OVER (PARTITION BY class_name) - 1 ELSE 1 END) THEN 'train' ELSE 'val' END AS split_name FROM d)"


def oracle_sql():
    specs = "sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{scope}', '{c}')" for e, known, unknown in EXPERIMENTS for scope, cs in (("known", known), ("unknown", unknown)) for c in cs) + ") v(experiment, scope, class_name))"
    pattern = r"'\(([A-Ja-j])\)\s*([^\n]+)'"
    return {
        "seeded_split": f"{_SPLIT} SELECT * FROM s",
        "split_summary": f"{_SPLIT} SELECT class_name, count(*) FILTER (split_name = 'train') AS train, count(*) FILTER (split_name = 'val') AS val FROM s GROUP BY 1",
        "per_class_cap": f"WITH {_FILES} SELECT * FROM (SELECT DISTINCT class_name, path FROM f) QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY path) <= 25",
        "collision_names": rf"WITH {_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY name, class_name ORDER BY ord) AS k, min(class_name) OVER (PARTITION BY name) AS first, regexp_extract(name, '(\.[^.]*)?$', 1) AS ending FROM f) SELECT ord, CASE WHEN k > 1 THEN class_name || '_' || name[1:len(name) - len(ending)] || '_' || (k - 1) || ending WHEN class_name = first THEN name ELSE class_name || '_' || name END AS target FROM k",
        "class_pairs": f"WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY path) - 1 AS r, count(*) OVER (PARTITION BY class_name) AS n FROM (SELECT DISTINCT class_name, path FROM f)), s AS (SELECT *, (r + 1 + ('0x' || md5('42|' || path)[1:7])::BIGINT % (n - 1)) % n AS s FROM r WHERE n > 1) SELECT s.class_name, s.path, r.path AS pair FROM s JOIN r ON r.class_name = s.class_name AND r.r = s.s",
        "experiment_plan": f"WITH {_FILES}, {specs} SELECT experiment, scope, class_name, count(*) AS files FROM f JOIN sp USING (class_name) GROUP BY 1, 2, 3",
        "missing_classes": f"WITH {_FILES}, {specs} SELECT experiment, class_name, false AS overlap FROM sp WHERE class_name NOT IN (SELECT class_name FROM f)",
        "resume_plan": "SELECT DISTINCT video_path, question FROM res r WHERE NOT EXISTS (SELECT 1 FROM res d WHERE d.video_path = r.video_path AND d.question = r.question AND d.checkpoint IS NOT NULL AND d.prediction IS NOT NULL AND coalesce(d.error, '') = '')",
        "lr_schedule": "SELECT range AS epoch, round(CASE WHEN range < 10 THEN (range + 1) / 10 ELSE 0.5 * (1 + cos(pi() * (range - 10) / 90)) END, 6) AS factor FROM range(100)",
        "ema": f"WITH {_HISTORY} SELECT round(list_reduce(list(loss ORDER BY epoch), lambda a, x: a * 0.996::DOUBLE + x * (1 - 0.996::DOUBLE)), 6) AS ema FROM h",
        "eta_stats": f"WITH {_HISTORY} SELECT epoch, round(avg(loss) OVER w, 6) AS mean_seconds, round(greatest(3000 - row_number() OVER (ORDER BY epoch), 0) * avg(loss) OVER w, 4) AS remaining FROM h WINDOW w AS (ORDER BY epoch ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
        "early_stop": f"WITH {_HISTORY}, b AS (SELECT *, min(loss) OVER (ORDER BY epoch) AS best, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS better FROM h), i AS (SELECT *, sum(better) OVER (ORDER BY epoch) AS island FROM b), s AS (SELECT epoch, best, row_number() OVER (PARTITION BY island ORDER BY epoch) - 1 AS since FROM i) SELECT epoch, round(best, 9) AS best, since, since >= 200 AS stop FROM s",
        "round_robin_chunks": "SELECT (benchmark_index % 8)::INT AS worker, count(*) AS rows FROM res GROUP BY 1",
        "pandas_reward": f"SELECT result_id, {rewarded_sql('model_raw_output', 't')} AS reward FROM (SELECT *, source_item['ground_truth'] AS t FROM res)",
        "udtf_options": f"SELECT result_id, upper(unnest(regexp_extract_all(question, {pattern}, 1))) AS letter, trim(unnest(regexp_extract_all(question, {pattern}, 2))) AS species FROM res",
        "map_in_pandas_match": "SELECT result_id, coalesce(lower(true_class) = lower(predicted_class), false) AS correct FROM eval_results",
    }
