"""Queries of the problems tagged llm, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import names
from ..tables import table
from . import cutoffs, groups, leaks, levels, mixing, overlap, pairs

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, folder: operator(*(table(spark, folder, name) for name in tables))


def queries() -> dict[str, Query]:
    splits = ("val", "sft_train", "rl_train")
    crops = ("file_tasks", "object_info")
    return {
        "p1_found": _over(overlap.found, *splits),
        "p1_report": _over(overlap.overlap_report, *splits),
        "p2_found": _over(pairs.found, "res", "stage2_cot"),
        "p2_report": _over(pairs.defect_report, "res", "stage2_cot"),
        "p3_found": _over(groups.found, *crops),
        "p3_splits": _over(groups.assign_splits, *crops, "split_targets"),
        "p3_report": _over(groups.split_report, *crops, "split_targets"),
        "p5_found": _over(cutoffs.found, "eval_results", "keep_targets"),
        "p5_report": _over(cutoffs.cutoff_report, "eval_results", "keep_targets", "class_thresholds"),
        "p6_found": _over(leaks.found, "documents", "eval_items"),
        "p6_report": _over(leaks.leak_report, "documents", "eval_items"),
        "p7_mix": _over(mixing.mixture, "documents", "mix_targets"),
        "p7_report": _over(mixing.mixture_report, "documents", "mix_targets"),
        "p8_found": _over(levels.found, "documents", "level_samples"),
        "p8_profile": _over(levels.level_profile, "documents", "level_samples"),
    }


_SLUG = "trim(regexp_replace(lower({0}), '[\\s_-]+', '_', 'g'), '_')"

_LATEST = f"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment, image_path ORDER BY evaluated_at DESC, result_id DESC) AS place FROM eval_results) WHERE place = 1),
known AS (SELECT result_id, true_class, {_SLUG.format("source")} AS source, similarity, l2_distance FROM last),
usable AS (SELECT 'similarity' AS measure, source, result_id, true_class, similarity AS score, -similarity AS strict FROM known WHERE similarity BETWEEN -1 AND 1
 UNION ALL SELECT 'l2_distance', source, result_id, true_class, l2_distance, l2_distance FROM known WHERE isfinite(l2_distance) AND l2_distance >= 0),
targets AS (SELECT {_SLUG.format("source")} AS source, max(target_fraction) AS target_fraction FROM keep_targets GROUP BY 1),
ranked AS (SELECT usable.*, target_fraction, count(*) OVER (PARTITION BY measure, source) AS usable_rows, rank() OVER (PARTITION BY measure, source ORDER BY strict) AS place FROM usable JOIN targets USING (source)),
kept AS (SELECT * FROM ranked WHERE place <= greatest(ceil(target_fraction * usable_rows), 1))"""


_BLANKS = r"\s" + "".join("-".join(r"\x{" + code + "}" for code in codes.split("-")) for codes in names.BLANK_CODES.split())


def _plain_path_sql(path: str) -> str:
    """A path in one spelling, step by step as ``names.plain_path`` says; steps up are resolved three times, more than the tables need."""
    c = f"regexp_replace({path}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"
    c = f"url_decode(replace(replace({c}, '\\', '/'), '+', '%2B'))"
    c = f"regexp_replace(regexp_replace({c}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:/*', '/')"
    c = f"regexp_replace(regexp_replace(lower({c}), '/(?:\\./)+', '/', 'g'), '/{{2,}}', '/', 'g')"
    for _ in range(3):
        c = f"regexp_replace({c}, '/[^/.][^/]*/\\.\\.(/|$)', '\\1')"
    return f"regexp_replace({c}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def _clip_sql(plain: str) -> str:
    """The clip that a path names, '' for none."""
    c = f"regexp_extract({plain}, '(?:[^/]+/){{3}}[^/]+$')"
    c = f"regexp_replace({c}, '(?:\\.(?:{'|'.join(names.VIDEO_ENDINGS.split())}))+$', '')"
    c = f"regexp_replace(regexp_replace({c}, '[{_BLANKS}_\\x{{2010}}-\\x{{2015}}-]+', '_', 'g'), '^_+|_+$', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '_*/_*', '/', 'g'), '/copy_of_', '/', 'g')"
    return f"regexp_replace({c}, '(?:_?\\(\\d+\\)|_(?:{names.COPY_MARKS}))+$', '')"


_CLIPS = f"""WITH samples AS (SELECT 'val' AS split, sample_id, source, videos FROM val UNION ALL SELECT 'sft_train', sample_id, source, videos FROM sft_train UNION ALL SELECT 'rl_train', sample_id, source, videos FROM rl_train),
clips AS (SELECT DISTINCT split, sample_id, clip FROM (SELECT split, sample_id, {_clip_sql('plain')} AS clip FROM (SELECT split, sample_id, {_plain_path_sql('v')} AS plain FROM (SELECT split, sample_id, unnest(videos) AS v FROM samples))) WHERE clip <> ''),
pairs AS (SELECT a.sample_id AS eval_record, b.sample_id AS train_record, count(*) AS shared FROM clips a JOIN clips b ON a.clip = b.clip AND a.split = 'val' AND b.split <> 'val' GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_CLIPS} SELECT least(eval_record, train_record) AS id_a, greatest(eval_record, train_record) AS id_b FROM pairs",
        "p1_report": f"""{_CLIPS}, sizes AS (SELECT sample_id AS eval_record, count(*) AS clips FROM clips WHERE split = 'val' GROUP BY 1)
SELECT split, {_SLUG.format('source')} AS source, count(*) AS pairs, count(DISTINCT eval_record) AS eval_records, count(DISTINCT train_record) AS train_records, count(DISTINCT eval_record) FILTER (shared = clips) AS contained_records
FROM pairs JOIN sizes USING (eval_record) JOIN samples ON samples.sample_id = train_record GROUP BY 1, 2""",
        "p5_found": f"{_LATEST} SELECT measure, result_id FROM kept",
        "p5_report": f"""{_LATEST},
today AS (SELECT {_SLUG.format("class_name")} AS class_name, similarity_threshold, l2_distance_threshold FROM class_thresholds),
fallback AS (SELECT max(similarity_threshold) AS s, max(l2_distance_threshold) AS d FROM today WHERE class_name = 'default'),
bounds AS (SELECT measure, source, arg_max(score, strict) AS cutoff, max(strict) AS bound FROM kept GROUP BY ALL)
SELECT measure, source, target_fraction, usable_rows AS usable, cutoff, count(*) FILTER (strict <= bound) AS kept,
 count(*) FILTER (strict <= CASE WHEN measure = 'similarity' THEN -coalesce(similarity_threshold, s) ELSE coalesce(l2_distance_threshold, d) END) AS kept_today
FROM ranked JOIN bounds USING (measure, source) LEFT JOIN today ON class_name = {_SLUG.format("true_class")} CROSS JOIN fallback GROUP BY ALL""",
        "p3_found": f"""WITH RECURSIVE tasks AS (SELECT task_id, regexp_extract({_SLUG.format(r"regexp_replace(regexp_extract(lower(trim(source)), '[^/\\]*$'), '[.](webp|jpe?g|png)$', '')")}, '^(.+)_\\d+_\\d+$', 1) AS video FROM file_tasks),
reads AS (SELECT DISTINCT {_SLUG.format("regexp_extract(trim(sequence_name), '[^/]*$')")} AS video, regexp_extract({_SLUG.format("trim(fish_tag)")}, '^pt_?0*([1-9]\\d*)$', 1) AS tag FROM object_info),
links AS (SELECT DISTINCT a.video AS a, b.video AS b FROM reads a JOIN reads b USING (tag) WHERE tag <> ''),
reach AS (SELECT DISTINCT a AS video, a AS other FROM links UNION SELECT video, b FROM reach JOIN links ON other = a),
component AS (SELECT video, min(other) AS component FROM reach GROUP BY 1),
grouped AS (SELECT task_id, min(task_id) OVER (PARTITION BY coalesce(component, video)) AS group_task_id FROM tasks LEFT JOIN component USING (video) WHERE video <> '')
SELECT group_task_id, task_id FROM grouped WHERE task_id <> group_task_id""",
    }
