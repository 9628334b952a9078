"""Label text: comma-separated raw labels and space-separated track rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import xywh_to_corners

BOX = ("x1", "y1", "x2", "y2")

#: Class words of track lines: the one that is evaluated, the one that is written for it, and the one of regions that don't count.
EVALUATED, WRITTEN, IGNORED = "Fish", "Car", "DontCare"
#: The fields of track lines that are not known, between class and box and behind the box.
UNKNOWN_BEFORE, UNKNOWN_TRUTH, UNKNOWN_PREDICTED = "-1 -1 -1", "-1 -1 -1 -1000 -1000 -1000 -10", "-1 -1 -1 -1 -1 -1 -1"

#: The names under which evaluators look for the sequence map.
SEQUENCE_MAPS = ("evaluate_tracking.seqmap.training", "evaluate_tracking.seqmap.testing")


def _sequence(path: Column) -> Column:
    """The folder ``sequence_name=...`` of a partitioned table, else the file's name without its ending."""
    folder = F.try_url_decode(F.regexp_extract(path, "/sequence_name=([^/]*)/", 1))
    return F.coalesce(F.nullif(folder, F.lit("")), F.regexp_replace(F.try_url_decode(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", ""))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    return rows.where("trim(value) <> ''").select(_sequence(F.col("_metadata.file_path")).alias("sequence_name"), "value")


def _number(parts: Column, i: int, kind: str = "double") -> Column:
    return F.trim(F.get(parts, F.lit(i))).try_cast(kind)


def read_raw_labels(spark: SparkSession, path: str, classes: dict[str, str]) -> DataFrame:
    """frame, track, label, x, y, w, h, score, two more: rows with fewer than ten fields or an unknown label are dropped."""
    rows = _lines(spark, path).withColumn("p", F.split("value", ",")).where(F.size("p") >= 10)
    table = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    named = rows.withColumn("class_name", F.try_element_at(table, F.trim(F.get("p", F.lit(2))))).where("class_name IS NOT NULL")
    corners = xywh_to_corners(*(_number(F.col("p"), i) for i in (3, 4, 5, 6)))
    return named.select("sequence_name", _number(F.col("p"), 0, "bigint").alias("frame_id"), _number(F.col("p"), 1, "bigint").alias("track_id"), "class_name", *(c.alias(n) for n, c in zip(BOX, corners)), _number(F.col("p"), 7).alias("score"))


def read_lenient_labels(spark: SparkSession, path: str, classes: dict[str, str]) -> DataFrame:
    """Rows with eight fields or more, a known label and well-formed numbers, boxes rounded half to even; of equal frame and track the last in the file.

    Files are read whole, one a row, since only so a line has its place; a file is the labels of one video.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    rows = files.select(_sequence(F.col("_metadata.file_path")).alias("sequence_name"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).withColumn("p", F.split("value", ",")).where(F.size("p") >= 8)
    table = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    corners = xywh_to_corners(*(_number(F.col("p"), i) for i in (3, 4, 5, 6)))
    parsed = rows.select(
        "sequence_name", "line", _number(F.col("p"), 0, "bigint").alias("frame_id"), _number(F.col("p"), 1, "bigint").alias("track_id"), F.try_element_at(table, F.trim(F.get("p", F.lit(2)))).alias("class_name"), *(F.bround(c).cast("bigint").alias(n) for n, c in zip(BOX, corners))
    )
    last = parsed.dropna().groupBy("sequence_name", "frame_id", "track_id").agg(F.max_by(F.struct("class_name", *BOX), "line").alias("r"))
    return last.select("sequence_name", "frame_id", "track_id", "r.*")


def loaded_class(found: Column) -> Column:
    """The class of a predicted track line: the evaluated one for itself and for what is written for it, ``IGNORED`` for itself; others raise."""
    return F.when(found.isin(EVALUATED, WRITTEN), F.lit(EVALUATED)).when(found == IGNORED, found).otherwise(F.raise_error(F.concat(F.lit("unsupported class "), found)).cast("string"))


def read_tracks(spark: SparkSession, path: str, predicted: bool) -> DataFrame:
    """Track lines of 17 fields (18 with a score). The class of truth is always ``EVALUATED``, of predictions ``loaded_class``; a score that is absent or -1 counts 1."""
    rows = _lines(spark, path).withColumn("p", F.split(F.trim("value"), r"\s+"))
    score = F.when((F.size("p") <= 17) | (F.get("p", F.lit(17)) == "-1"), F.lit(1.0)).otherwise(_number(F.col("p"), 17))
    field = lambda i, kind="double": _number(F.col("p"), i, kind)
    return rows.select(
        "sequence_name", field(0, "bigint").alias("frame_id"), field(1, "bigint").alias("track_id"), (loaded_class(F.get("p", F.lit(2))) if predicted else F.lit(EVALUATED)).alias("class_name"),
        field(3).alias("truncation"), field(4).alias("occlusion"), field(5).alias("alpha"), *(field(6 + i).alias(n) for i, n in enumerate(BOX)),
        F.array(*(field(i) for i in (10, 11, 12))).alias("dimensions"), F.array(*(field(i) for i in (13, 14, 15))).alias("location"), score.alias("score"),
    )


def track_lines(boxes: DataFrame, predicted: bool) -> DataFrame:
    """(sequence_name, value): 18 fields a box; truth with six decimals, predictions with plain numbers; the class is ``WRITTEN`` for all."""
    number = lambda c: F.col(c).cast("string") if predicted else F.format_string("%.6f", F.col(c))
    behind = UNKNOWN_PREDICTED if predicted else UNKNOWN_TRUTH
    fields = [F.col("frame_id").cast("string"), F.col("track_id").cast("string"), F.lit(WRITTEN), F.lit(UNKNOWN_BEFORE), *(number(c) for c in BOX), F.lit(behind), number("score")]
    return boxes.select("sequence_name", F.concat_ws(" ", *fields).alias("value"))


def raw_label_lines(boxes: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(sequence_name, value): comma-separated raw labels of boxes whose class has a label."""
    table = F.create_map(*(F.lit(x) for k, v in classes.items() for x in (v, k)))
    fields = ["frame_id", "track_id", "_l", "x1", "y1", (F.col("x2") - F.col("x1")), (F.col("y2") - F.col("y1")), "score"]
    rows = boxes.withColumn("_l", F.try_element_at(table, F.col("class_name"))).where("_l IS NOT NULL")
    return rows.select("sequence_name", F.concat_ws(",", *(F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields), F.lit("-1"), F.lit("-1")).alias("value"))


def sequence_map_lines(spans: DataFrame) -> DataFrame:
    """(value): ``name empty first end`` with six digits, of a table sequence_name, first_frame, end_frame."""
    return spans.select(F.concat_ws(" ", "sequence_name", F.lit("empty"), F.format_string("%06d", F.col("first_frame")), F.format_string("%06d", F.col("end_frame"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder of text for each sequence. Lines go by sequence first, else each task would open a file for each of its sequences; a sequence too large for one task is divided."""
    lines.hint("rebalance", "sequence_name").write.mode("overwrite").partitionBy("sequence_name").text(path)


def write_sequence_maps(lines: DataFrame, folder: str) -> None:
    """The same lines under both names that evaluators look for."""
    for name in SEQUENCE_MAPS:
        lines.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
