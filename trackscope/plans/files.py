"""Round trips through the file layouts: tables are written as the documents and lines that other tools exchange, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks
from ..session import work_folder
from ..sources import annotations, labels, listings, reports
from ..tables import table
from .tracks import det

#: Labels of the classes of raw label text, by their place.
LABELS = {str(i): name for i, name in enumerate("amber_dace broad_snaker copper_bream dusk_catlet gilt_rudder glass_gudgeon moss_tench mud_lantern pale_chublin reed_perchlet".split())}
#: Results of one document.
PER_DOCUMENT = 1000


def _boxes(spark, folder):
    """Detections that have all that a label needs; ``track_id`` is unique, so that a frame never holds a key twice."""
    return det(spark, folder).where("sequence_name IS NOT NULL AND frame_id IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL").withColumn("track_id", F.col("ord"))


def _annotations(spark, folder):
    """Nested documents, one for each sequence, and back to flat predictions."""
    path = work_folder(spark, "annotations")
    flat = _boxes(spark, folder).select(
        "sequence_name", F.format_string("%06d", F.col("frame_id")).alias("frame_key"), F.col("ord").cast("string").alias("label_key"), F.col("track_id").alias("instance_id"), "class_name", "x1", "y1", "x2", "y2", F.col("score").alias("logit")
    )
    annotations.to_documents(flat).select("value").write.text(path)
    documents = spark.read.schema(annotations.DOCUMENT).json(path).withColumn("path", F.lit("/"))
    return annotations.predictions(annotations.flat_labels(documents))


def _raw_labels(spark, folder):
    path = work_folder(spark, "labels")
    boxes = _boxes(spark, folder).select("sequence_name", "frame_id", "track_id", "class_name", *(F.round(c).alias(c) for c in ("x1", "y1", "x2", "y2")), "score")
    labels.write_lines(labels.raw_label_lines(boxes, LABELS), path)
    return labels.read_raw_labels(spark, path, LABELS)


def _tracks(predicted):
    def query(spark, folder):
        path = work_folder(spark, "tracks")
        labels.write_lines(labels.track_lines(_boxes(spark, folder), predicted), path)
        back = labels.read_tracks(spark, path, predicted)
        return back.select("sequence_name", "frame_id", "track_id", "class_name", "truncation", "occlusion", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")))

    return query


def _details(spark, folder):
    path = work_folder(spark, "details")
    rows = _boxes(spark, folder).withColumn("frame_key", F.format_string("%06d", F.col("frame_id")))
    reports.write_csv(rows, path, ["sequence_name", "frame_key", "frame_id", "track_id", "class_name", "x1", "y1", "x2", "y2", "score"])
    return reports.export_counts(spark.read.option("header", True).csv(path))


def _results(spark, folder):
    """Documents of results, and back."""
    path = work_folder(spark, "results")
    fields = ("benchmark_index", "video_path", "question", "model_raw_output", "prediction", "has_think", "has_rethink", "has_answer", "format_ok", "error", "source_item")
    rows = table(spark, folder, "res").select(F.floor(F.col("result_id") / PER_DOCUMENT).alias("_d"), F.struct(*fields).alias("_r"))
    rows.groupBy("_d").agg(F.to_json(F.struct(F.collect_list("_r").alias("results"))).alias("value")).select("value").write.text(path)
    return listings.read_results(spark, path).select("benchmark_index", "video_path", "prediction", "format_ok", F.coalesce(F.map_keys("source_item"), F.array().cast("array<string>")).alias("keys")).groupBy("format_ok").agg(
        F.count(F.lit(1)).alias("results"), F.countDistinct("benchmark_index").alias("items"), F.sum(F.length("prediction")).alias("letters"), F.sum(F.size("keys")).alias("keys")
    )


def queries():
    return {
        "annotation_documents": _annotations,
        "raw_label_lines": _raw_labels,
        "track_lines_truth": _tracks(False),
        "track_lines_predicted": _tracks(True),
        "sequence_map_lines": lambda spark, folder: labels.sequence_map_lines(tracks.sequence_map(det(spark, folder).where("sequence_name IS NOT NULL AND frame_id IS NOT NULL"))),
        "prediction_export_counts": _details,
        "result_documents": _results,
    }


def oracle_sql():
    from .tracks import DETECTIONS_SQL

    whole = f"WITH {DETECTIONS_SQL}, whole AS (SELECT * FROM det WHERE sequence_name IS NOT NULL AND frame_id IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL)"
    six = ", ".join(f"round({c}, 6) AS {c}" for c in ("x1", "y1", "x2", "y2", "score"))
    lines = f"{whole} SELECT sequence_name, frame_id, ord AS track_id, 'Fish' AS class_name, -1.0::DOUBLE AS truncation, -1.0::DOUBLE AS occlusion, {six} FROM whole"
    known = ", ".join(f"'{name}'" for name in LABELS.values())
    return {
        "annotation_documents": f"{whole} SELECT sequence_name, frame_id, ord AS track_id, class_name, x1, y1, x2, y2, score FROM whole",
        "raw_label_lines": f"{whole} SELECT sequence_name, frame_id, ord AS track_id, class_name, round(x1) AS x1, round(y1) AS y1, round(x2) AS x2, round(y2) AS y2, score FROM whole WHERE class_name IN ({known})",
        "track_lines_truth": lines,
        "track_lines_predicted": lines,
        "sequence_map_lines": f"{whole} SELECT sequence_name || ' empty ' || printf('%06d', min(frame_id)) || ' ' || printf('%06d', max(frame_id) + 1) AS value FROM det WHERE sequence_name IS NOT NULL AND frame_id IS NOT NULL GROUP BY sequence_name",
        "prediction_export_counts": f"{whole} SELECT count(*) AS row_count, count(DISTINCT sequence_name) AS non_empty_sequence_count FROM whole",
        "result_documents": "SELECT format_ok, count(*) AS results, count(DISTINCT benchmark_index) AS items, sum(length(prediction))::BIGINT AS letters, sum(coalesce(cardinality(source_item), 0))::BIGINT AS keys FROM res GROUP BY 1",
    }
