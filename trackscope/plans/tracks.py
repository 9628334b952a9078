"""Queries over object_info and file_tasks: detections, tracks, crops, masks and label updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks
from ..tables import table
from .traces import NAMES, resolved_sql


def det(spark, folder):
    return tracks.detections(table(spark, folder, "object_info"))


def tracked(spark, folder):
    return det(spark, folder).where("instance_id IS NOT NULL")


def updates(spark, folder):
    """Labels from the names of planned crop files: one row for each task with a video, an instance and a class folder."""
    pattern = r"([^/\\]+)[/\\]([^/\\]+)_(\d+)_\d+\.\w+\s*$"
    part = lambda i: F.regexp_extract(F.lower("source"), pattern, i)
    rows = table(spark, folder, "file_tasks").select(F.col("task_id").alias("ord"), F.translate(part(2), "- ", "__").alias("sequence_name"), F.expr("try_cast(regexp_extract(lower(source), '([^/\\\\\\\\]+)[/\\\\\\\\]([^/\\\\\\\\]+)_(\\\\d+)_\\\\d+\\\\.\\\\w+\\\\s*$', 3) AS BIGINT)").alias("instance_id"), F.translate(part(1), "- ", "__").alias("class_name"))
    return rows.where("sequence_name <> '' AND instance_id IS NOT NULL")


def results(spark, folder):
    """What the inference results say of instances' videos."""
    return tracks.result_updates(table(spark, folder, "res"), NAMES)


def queries():
    on = lambda f, source=det: lambda spark, folder: f(source(spark, folder))
    first_frames = lambda d: d.groupBy("sequence_name").agg(F.min("frame_id").alias("a"), (F.min("frame_id") + 400).alias("b")).where("sequence_name < 'n'")
    windows = lambda d: tracks.crop_rectangles(d, tracks.crop_windows(d))
    masks = lambda d: tracks.mask_rectangles(d.where("instance_id IS NOT NULL AND frame_id IS NOT NULL"))
    with_video = lambda f: lambda spark, folder: f(det(spark, folder), updates(spark, folder))
    return {
        "scan_detections_flat": on(lambda d: d),
        "filter_boxes": on(lambda d: tracks.filter_boxes(d).select("ord", "sequence_name", "frame_id")),
        "semi_join_gt_sequences": with_video(lambda d, u: d.join(u.select("sequence_name").distinct(), "sequence_name", "left_semi").groupBy("sequence_name").agg(F.count(F.lit(1)).alias("boxes"))),
        "coverage_anti": on(lambda d: d.select("sequence_name").distinct().join(d.where("class_name = 'moss_tench'").select("sequence_name").distinct(), "sequence_name", "left_anti")),
        "allowed_frames": with_video(lambda d, u: tracks.allowed_frames(d, d.where("class_name = 'moss_tench'")).groupBy("sequence_name").agg(F.count(F.lit(1)).alias("boxes"))),
        "conversion_summary": on(tracks.conversion_summary),
        "normalize_names": on(lambda d: d.groupBy("class_name").agg(F.count(F.lit(1)).alias("rows")), lambda spark, folder: table(spark, folder, "object_info").select(tracks.class_name(F.col("class_name")).alias("class_name"))),
        "frame_range_filter": on(lambda d: tracks.frame_range(d, first_frames(d)).groupBy("sequence_name").agg(F.count(F.lit(1)).alias("boxes"), F.max("frame_id").alias("last_frame"))),
        "category_counts_rollup": on(tracks.category_counts),
        "seqmap": on(tracks.sequence_map),
        "prediction_detail_export": on(lambda d: d.select("sequence_name", "frame_id", "instance_id", "class_name", F.format_string("%.6f", F.col("score")).alias("score"), F.concat_ws(" ", *(F.format_string("%.2f", F.col(c)) for c in ("x1", "y1", "x2", "y2"))).alias("box"))),
        "instance_occurrences": on(tracks.track_lengths, tracked),
        "min_track_length": on(lambda d: tracks.long_tracks(d, 60).select("ord")),
        "crop_windows": on(tracks.crop_windows, tracked),
        "crop_rectangles": on(windows, tracked),
        "keyframe_windows": on(tracks.keyframe_windows),
        "fill_forward": on(lambda d: tracks.fill(d, "class_name"), tracked),
        "fill_backward": on(lambda d: tracks.fill(d, "class_name", 20), tracked),
        "new_track_ids": on(tracks.new_track_ids, tracked),
        "new_ids_per_keyframe": on(lambda d: tracks.new_ids_per_keyframe(tracks.new_track_ids(d)), tracked),
        "duplicate_boxes": on(lambda d: d.groupBy("sequence_name", "frame_id", "instance_id", "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")),
        "update_labels_join": with_video(lambda d, u: tracks.update_labels(d.where("instance_id IS NOT NULL"), u).select("ord", "class_name", "updated")),
        "update_conflicts": lambda spark, folder: tracks.update_conflicts(updates(spark, folder)),
        "instance_videos": lambda spark, folder: results(spark, folder).where("sequence_name IS NOT NULL"),
        "update_load_stats": lambda spark, folder: tracks.load_statistics(results(spark, folder)),
        "update_stats": with_video(lambda d, u: tracks.update_statistics(tracks.update_labels(d.where("instance_id IS NOT NULL"), u))),
        "update_unmatched": lambda spark, folder: tracks.unmatched_updates(results(spark, folder).where("sequence_name IS NOT NULL AND class_name IS NOT NULL"), det(spark, folder)),
        "fill_forward_bounded": on(lambda d: tracks.fill(d, "class_name", forward_span=10), tracked),
        "mask_area_bbox": on(lambda d: tracks.mask_boxes(masks(d))),
        "mask_iou": on(lambda d: tracks.mask_iou(masks(d)).withColumn("iou", F.round("iou", 6))),
        "mask_associate": on(lambda d: tracks.mask_associate(d.where("instance_id IS NOT NULL"))),
    }


_CLASS = "rtrim(translate(lower(trim(class_name)), '- ', '__'), '.')"
_DET = f"""det AS (SELECT object_id AS ord, regexp_extract(sequence_name, '[^/]*$') AS sequence_name, frame_id, instance_id, {_CLASS} AS class_name, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2, coalesce(logit, 0.0) AS score FROM object_info),
tracked AS (SELECT * FROM det WHERE instance_id IS NOT NULL)"""
DETECTIONS_SQL = _DET
_UPD = r"""upd AS (SELECT * FROM (SELECT task_id AS ord, translate(regexp_extract(lower(source), '([^/\\]+)[/\\]([^/\\]+)_(\d+)_\d+\.\w+\s*$', 2), '- ', '__') AS sequence_name,
 try_cast(regexp_extract(lower(source), '([^/\\]+)[/\\]([^/\\]+)_(\d+)_\d+\.\w+\s*$', 3) AS BIGINT) AS instance_id, translate(regexp_extract(lower(source), '([^/\\]+)[/\\]([^/\\]+)_(\d+)_\d+\.\w+\s*$', 1), '- ', '__') AS class_name FROM file_tasks) WHERE sequence_name <> '' AND instance_id IS NOT NULL)"""
_WHOLE = "whole AS (SELECT ord, sequence_name, instance_id, trunc(x1)::INT AS x1, trunc(y1)::INT AS y1, trunc(x2)::INT AS x2, trunc(y2)::INT AS y2 FROM tracked)"
_VALID = "x2 > x1 AND y2 > y1 AND NOT (x1 = 0 AND y1 = 0 AND x2 = 0 AND y2 = 0)"
_WINDOWS = f"""{_WHOLE}, st AS (SELECT sequence_name, instance_id, CASE WHEN count(*) >= 5 THEN quantile_cont(x2 - x1, 0.8) ELSE max(x2 - x1) END AS pw, CASE WHEN count(*) >= 5 THEN quantile_cont(y2 - y1, 0.8) ELSE max(y2 - y1) END AS ph, max(x2 - x1) AS max_width, max(y2 - y1) AS max_height FROM whole WHERE {_VALID} GROUP BY ALL),
pd AS (SELECT *, CASE WHEN greatest(pw, ph) <= 150 THEN 50 WHEN greatest(pw, ph) >= 500 THEN 0 ELSE trunc(50 * (1 - (greatest(pw, ph) - 150) / 350.0::DOUBLE)) END AS pad FROM st),
win AS (SELECT sequence_name, instance_id, (floor((greatest(greatest(trunc(pw), trunc(max_width * 0.8::DOUBLE)), greatest(trunc(ph), trunc(max_height * 0.8::DOUBLE))) + 2 * pad + 1) / 2) * 2)::BIGINT AS side, max_width, max_height FROM pd)"""
_PIX = """mb AS (SELECT sequence_name, frame_id, instance_id, ord, floor(x1)::BIGINT AS x1, floor(y1)::BIGINT AS y1, floor(x2)::BIGINT + 1 AS x2, floor(y2)::BIGINT + 1 AS y2 FROM det WHERE instance_id IS NOT NULL AND frame_id IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL),
xs AS (SELECT sequence_name, frame_id, e AS xa, lead(e) OVER (PARTITION BY sequence_name, frame_id ORDER BY e) AS xb FROM (SELECT DISTINCT sequence_name, frame_id, unnest([x1, x2]) AS e FROM mb)),
ys AS (SELECT sequence_name, frame_id, e AS ya, lead(e) OVER (PARTITION BY sequence_name, frame_id ORDER BY e) AS yb FROM (SELECT DISTINCT sequence_name, frame_id, unnest([y1, y2]) AS e FROM mb)),
px AS (SELECT mb.sequence_name, mb.frame_id, xa, ya, xb, yb, arg_max(instance_id, ord) AS instance_id FROM mb JOIN xs ON xs.sequence_name = mb.sequence_name AND xs.frame_id = mb.frame_id AND xa >= x1 AND xb <= x2 JOIN ys ON ys.sequence_name = mb.sequence_name AND ys.frame_id = mb.frame_id AND ya >= y1 AND yb <= y2 GROUP BY 1, 2, 3, 4, 5, 6),
ar AS (SELECT sequence_name, frame_id, instance_id, sum((xb - xa) * (yb - ya))::BIGINT AS area, min(xa) AS x1, min(ya) AS y1, max(xb) - 1 AS x2, max(yb) - 1 AS y2 FROM px GROUP BY 1, 2, 3),
sh AS (SELECT a.sequence_name, a.frame_id, a.instance_id, b.instance_id AS other_id, sum((least(a.xb, b.xb) - greatest(a.xa, b.xa)) * (least(a.yb, b.yb) - greatest(a.ya, b.ya))) AS shared FROM px a JOIN px b ON a.sequence_name = b.sequence_name AND a.frame_id = b.frame_id + 1 AND a.xa < b.xb AND b.xa < a.xb AND a.ya < b.yb AND b.ya < a.yb GROUP BY 1, 2, 3, 4),
mi AS (SELECT sh.sequence_name, sh.frame_id, sh.instance_id, other_id, shared / (a.area + b.area - shared) AS iou FROM sh JOIN ar a ON a.sequence_name = sh.sequence_name AND a.frame_id = sh.frame_id AND a.instance_id = sh.instance_id JOIN ar b ON b.sequence_name = sh.sequence_name AND b.frame_id + 1 = sh.frame_id AND b.instance_id = sh.other_id)"""
_INTER = "greatest(least(d.x2, t.x2) - greatest(d.x1, t.x1), 0) * greatest(least(d.y2, t.y2) - greatest(d.y1, t.y1), 0)"
_MASK_IOU = f"{_INTER} / ((d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {_INTER})::DOUBLE"
#: The frames of each sequence in turn, with the tracked masks as the state.
_FOLD = f"""mb AS (SELECT sequence_name, frame_id, ord, floor(x1)::BIGINT AS x1, floor(y1)::BIGINT AS y1, floor(x2)::BIGINT + 1 AS x2, floor(y2)::BIGINT + 1 AS y2 FROM det WHERE instance_id IS NOT NULL AND frame_id IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL),
fr AS (SELECT sequence_name, frame_id, row_number() OVER (PARTITION BY sequence_name ORDER BY frame_id) AS r, list({{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY ord) AS ds FROM mb GROUP BY sequence_name, frame_id),
fold AS (SELECT sequence_name, 0::BIGINT AS r, 0::BIGINT AS n, []::STRUCT(id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS tr, []::STRUCT(ord BIGINT, id BIGINT)[] AS got, NULL::BIGINT AS frame_id FROM fr GROUP BY 1
 UNION ALL SELECT sequence_name, r, n + len(list_filter(m, lambda x: x IS NULL)), list_transform(list_filter(range(1, len(ids) + 1), lambda i: list_position(ids, ids[i]) = i),
  lambda i: struct_pack(id := ids[i], x1 := list_filter(who, lambda d: d.id = ids[i])[-1].x1, y1 := list_filter(who, lambda d: d.id = ids[i])[-1].y1, x2 := list_filter(who, lambda d: d.id = ids[i])[-1].x2, y2 := list_filter(who, lambda d: d.id = ids[i])[-1].y2)), list_transform(who, lambda d: struct_pack(ord := d.ord, id := d.id)), frame_id
 FROM (SELECT *, list_transform(list_zip(ds, ids), lambda z: struct_pack(ord := z[1].ord, id := z[2], x1 := z[1].x1, y1 := z[1].y1, x2 := z[1].x2, y2 := z[1].y2)) AS who
 FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: coalesce(m[i], n + len(list_filter(m[1:i], lambda x: x IS NULL)))) AS ids
 FROM (SELECT fold.sequence_name, fr.r, fr.frame_id, n, ds, list_transform(ds, lambda d: list_filter(tr, lambda t: {_MASK_IOU} > 0.65)[1].id) AS m FROM fold JOIN fr ON fr.sequence_name = fold.sequence_name AND fr.r = fold.r + 1))))"""
_RESULTS = f"{resolved_sql(empty=True)}, ru AS (SELECT result_id AS ord, CASE WHEN hit THEN regexp_extract(name, '(.+)_([0-9]+)\\.mp4$', 1, 'i') END AS sequence_name, CASE WHEN hit THEN try_cast(regexp_extract(name, '(.+)_([0-9]+)\\.mp4$', 2, 'i') AS BIGINT) END AS instance_id, species AS class_name FROM (SELECT result_id, string_split(video_path, '/')[-1] AS name, regexp_matches(string_split(video_path, '/')[-1], '^.+_[0-9]+\\.mp4$', 'i') AS hit FROM res) JOIN rs USING (result_id))"
_LAST = f"{_DET}, {_UPD}, lu AS (SELECT sequence_name, instance_id, arg_max(class_name, ord) AS new FROM upd GROUP BY 1, 2)"


def oracle_sql():
    return {
        "scan_detections_flat": f"WITH {_DET} SELECT * FROM det",
        "filter_boxes": f"WITH {_DET} SELECT ord, sequence_name, frame_id FROM det WHERE score >= 0.30 AND {_VALID} AND least(x2 - x1, y2 - y1) >= 20",
        "semi_join_gt_sequences": f"WITH {_DET}, {_UPD} SELECT sequence_name, count(*) AS boxes FROM det WHERE sequence_name IN (SELECT sequence_name FROM upd) GROUP BY 1",
        "coverage_anti": f"WITH {_DET} SELECT sequence_name FROM det GROUP BY 1 HAVING count(*) FILTER (class_name = 'moss_tench') = 0",
        "allowed_frames": f"WITH {_DET} SELECT sequence_name, count(*) AS boxes FROM det WHERE (sequence_name, frame_id) IN (SELECT (sequence_name, frame_id) FROM det WHERE class_name = 'moss_tench' AND frame_id IS NOT NULL) GROUP BY 1",
        "conversion_summary": f"WITH {_DET} SELECT sum(n)::BIGINT AS boxes, count(*) AS files, count(*) FILTER (n > 0) AS non_empty_files FROM (SELECT sequence_name, count(instance_id) AS n FROM det GROUP BY 1)",
        "normalize_names": f"SELECT {_CLASS} AS class_name, count(*) AS rows FROM object_info GROUP BY 1",
        "frame_range_filter": f"WITH {_DET}, r AS (SELECT sequence_name, min(frame_id) AS a, min(frame_id) + 400 AS b FROM det GROUP BY 1 HAVING sequence_name < 'n') SELECT sequence_name, count(*) AS boxes, max(frame_id) AS last_frame FROM det LEFT JOIN r USING (sequence_name) WHERE a IS NULL OR frame_id BETWEEN a AND b GROUP BY 1",
        "category_counts_rollup": f"WITH {_DET} SELECT sequence_name, class_name, count(*) AS boxes FROM det WHERE class_name IS NOT NULL GROUP BY ROLLUP (sequence_name, class_name)",
        "seqmap": f"WITH {_DET} SELECT sequence_name, min(frame_id) AS first_frame, max(frame_id) + 1 AS end_frame FROM det GROUP BY 1",
        "prediction_detail_export": f"WITH {_DET} SELECT sequence_name, frame_id, instance_id, class_name, printf('%.6f', score) AS score, concat_ws(' ', printf('%.2f', x1), printf('%.2f', y1), printf('%.2f', x2), printf('%.2f', y2)) AS box FROM det",
        "instance_occurrences": f"WITH {_DET} SELECT sequence_name, instance_id, count(*) AS rows FROM tracked GROUP BY 1, 2",
        "min_track_length": f"WITH {_DET} SELECT ord FROM tracked QUALIFY count(*) OVER (PARTITION BY sequence_name, instance_id) >= 60",
        "crop_windows": f"WITH {_DET}, {_WINDOWS} SELECT * FROM win",
        "crop_rectangles": f"""WITH {_DET}, {_WINDOWS}, c AS (SELECT ord, side, trunc(floor((x1 + x2) / 2) - side / 2) AS cx, trunc(floor((y1 + y2) / 2) - side / 2) AS cy FROM whole JOIN win USING (sequence_name, instance_id) WHERE {_VALID}),
m AS (SELECT ord, side, greatest(0, least(greatest(cx, 0), 1920 - side))::BIGINT AS x1, greatest(0, least(greatest(cy, 0), 1080 - side))::BIGINT AS y1 FROM c) SELECT ord, x1, y1, least(1920, x1 + side) AS x2, least(1080, y1 + side) AS y2 FROM m""",
        "keyframe_windows": f"WITH {_DET} SELECT sequence_name, (floor(frame_id / 10) * 10)::BIGINT AS key_frame, count(*) AS boxes, count(DISTINCT frame_id) AS frames FROM det GROUP BY 1, 2",
        "fill_forward": f"WITH {_DET} SELECT ord, sequence_name, instance_id, last_value(class_name IGNORE NULLS) OVER (PARTITION BY sequence_name, instance_id ORDER BY frame_id, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM tracked",
        "new_track_ids": f"WITH {_DET} SELECT sequence_name, instance_id, min(frame_id) AS first_frame, row_number() OVER (PARTITION BY sequence_name ORDER BY min(frame_id), instance_id) AS new_id FROM tracked GROUP BY 1, 2",
        "new_ids_per_keyframe": f"WITH {_DET}, n AS (SELECT sequence_name, instance_id, min(frame_id) AS f, row_number() OVER (PARTITION BY sequence_name ORDER BY min(frame_id), instance_id) AS new_id FROM tracked GROUP BY 1, 2) SELECT sequence_name, (floor(f / 10) * 10)::BIGINT AS key_frame, min(new_id) AS id_from, max(new_id) AS id_to FROM n GROUP BY 1, 2",
        "duplicate_boxes": f"WITH {_DET} SELECT sequence_name, frame_id, instance_id, x1, y1, x2, y2, count(*) AS copies FROM det GROUP BY ALL HAVING count(*) > 1",
        "update_labels_join": f"WITH {_LAST} SELECT ord, coalesce(new, class_name) AS class_name, new IS NOT NULL AND new IS DISTINCT FROM class_name AS updated FROM tracked LEFT JOIN lu USING (sequence_name, instance_id)",
        "update_conflicts": f"WITH {_UPD} SELECT sequence_name, instance_id, count(*) AS updates, count(*) FILTER (before <> class_name) AS conflicts FROM (SELECT *, lag(class_name) OVER (PARTITION BY sequence_name, instance_id ORDER BY ord) AS before FROM upd) GROUP BY 1, 2",
        "instance_videos": f"WITH {_RESULTS} SELECT ord, sequence_name, instance_id, class_name FROM ru WHERE sequence_name IS NOT NULL",
        "update_load_stats": f"WITH {_RESULTS}, v AS (SELECT *, lag(class_name) OVER (PARTITION BY sequence_name, instance_id ORDER BY ord) AS before FROM ru WHERE sequence_name IS NOT NULL AND class_name IS NOT NULL) SELECT (SELECT count(*) FROM ru) AS results_loaded, count(*) AS valid_predictions, (SELECT count(*) FROM ru) - count(*) AS skipped_results, count(*) FILTER (before <> class_name) AS conflicts FROM v",
        "update_stats": f"WITH {_LAST}, c AS (SELECT sequence_name, frame_id FROM tracked JOIN lu USING (sequence_name, instance_id) WHERE new IS DISTINCT FROM class_name) SELECT count(DISTINCT sequence_name) AS updated_sequences, (SELECT count(*) FROM (SELECT DISTINCT sequence_name, frame_id FROM c)) AS updated_frames, count(*) AS updated_labels FROM c",
        "update_unmatched": f"WITH {_DET}, {_RESULTS} SELECT DISTINCT sequence_name FROM ru WHERE sequence_name IS NOT NULL AND class_name IS NOT NULL AND sequence_name NOT IN (SELECT sequence_name FROM det WHERE sequence_name IS NOT NULL)",
        "fill_forward_bounded": f"WITH {_DET} SELECT ord, sequence_name, instance_id, CASE WHEN frame_id - last_value(CASE WHEN class_name IS NOT NULL THEN frame_id END IGNORE NULLS) OVER w <= 10 THEN last_value(class_name IGNORE NULLS) OVER w END AS filled FROM tracked WINDOW w AS (PARTITION BY sequence_name, instance_id ORDER BY frame_id, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        "mask_area_bbox": f"WITH {_DET}, {_PIX} SELECT * FROM ar",
        "mask_iou": f"WITH {_DET}, {_PIX} SELECT sequence_name, frame_id, instance_id, other_id, round(iou, 6) AS iou FROM mi",
        "mask_associate": f"WITH RECURSIVE {_DET}, {_FOLD} SELECT sequence_name, frame_id, g.ord AS ord, g.id AS track_id FROM (SELECT sequence_name, frame_id, unnest(got) AS g FROM fold)",
        "fill_backward": f"WITH {_DET} SELECT ord, sequence_name, instance_id, first_value(class_name ORDER BY frame_id IGNORE NULLS) OVER (PARTITION BY sequence_name, instance_id ORDER BY frame_id RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING) AS filled FROM tracked",
    }
