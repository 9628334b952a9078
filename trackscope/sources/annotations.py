"""Annotation documents: nested JSON of sequences, frames and labels, as a flat table and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LABEL = "struct<instance_id:bigint,class_name:string,x1:double,y1:double,x2:double,y2:double,logit:double>"
_FRAME = f"struct<mask_name:string,mask_height:bigint,mask_width:bigint,promote_type:string,labels:map<string,{_LABEL}>>"
#: Both layouts in one: a dataset has ``videos``, a single sequence ``frames``.
DOCUMENT = f"video_name string, frame_count bigint, frames map<string,{_FRAME}>, videos map<string,struct<video_name:string,frame_count:bigint,frames:map<string,{_FRAME}>>>, sequence_count bigint"
#: Names of an aggregated document, the first that stands in a folder being read; none of them is a frame.
AGGREGATED = ("prediction.json", "annotations.json")

FLAT = "sequence_name, frame_key, label_key, instance_id, class_name, x1, y1, x2, y2, logit".split(", ")


def _flat(frames: DataFrame) -> DataFrame:
    """(sequence_name, frame_key, frame) to one row for each label."""
    labels = frames.select("sequence_name", "frame_key", F.explode("frame.labels").alias("label_key", "o"))
    return labels.select("sequence_name", "frame_key", "label_key", *(F.col("o." + f).alias(f) for f in FLAT[3:]))


def _frames(documents: DataFrame) -> DataFrame:
    parent = F.element_at(F.split("path", "/"), -2)
    single = documents.where("videos IS NULL AND frames IS NOT NULL").select(F.coalesce("video_name", parent).alias("sequence_name"), F.explode("frames").alias("frame_key", "frame"))
    many = documents.select(F.explode("videos").alias("sequence_name", "v")).select("sequence_name", F.explode("v.frames").alias("frame_key", "frame"))
    return many.unionByName(single)


def flat_labels(documents: DataFrame) -> DataFrame:
    """Flat labels of documents (columns of ``DOCUMENT``, path)."""
    return _flat(_frames(documents))


def aggregated_files(files: DataFrame) -> DataFrame:
    """(folder, path): the aggregated document of each folder of a listing (path), by the order of ``AGGREGATED``; folders without one are missing."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    rank = F.array_position(F.array(*(F.lit(n) for n in AGGREGATED)), name)
    return files.where(rank > 0).groupBy(folder.alias("folder")).agg(F.min_by("path", rank).alias("path"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Aggregated documents at ``path``, a file or a folder, with their path; below a folder only one document of each folder counts where it has one of the known names."""
    documents = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))
    if path.rstrip("/").endswith(".json"):
        return documents
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    chosen = aggregated_files(documents.select("path").distinct()).select("folder", F.col("path").alias("_chosen"))
    return documents.withColumn("folder", folder).join(F.broadcast(chosen), "folder", "left").where(F.col("_chosen").isNull() | ~name.isin(*AGGREGATED) | (F.col("path") == F.col("_chosen"))).drop("folder", "_chosen")


def read_annotations(spark: SparkSession, path: str, sequence: str | None = None) -> DataFrame:
    """Flat labels of aggregated documents (a dataset, or one sequence named by its video or folder) at or below ``path``; of one ``sequence`` only, if given."""
    flat = _flat(_frames(_documents(spark, path)))
    return flat if sequence is None else flat.where(F.col("sequence_name") == sequence)


def read_sequence(spark: SparkSession, path: str, sequence: str | None = None) -> DataFrame:
    """Flat labels of one sequence: that of a single-sequence document, whatever the key, or the named one of a dataset; a dataset without a key gives no row."""
    documents = _documents(spark, path)
    wanted = documents if sequence is None else documents.withColumn("videos", F.map_filter("videos", lambda k, v: k == sequence))
    return _flat(_frames(wanted.where("videos IS NULL") if sequence is None else wanted))


def read_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Flat labels of folders with one JSON file for each frame; files without a ``labels`` object and aggregated documents are skipped."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).withColumn("path", F.col("_metadata.file_path"))
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("sequence_name"), F.element_at(parts, -1).alias("file"), F.from_json("value", _FRAME).alias("frame"))
    kept = rows.where(~F.col("file").isin(*AGGREGATED) & F.col("frame.labels").isNotNull())
    return _flat(kept.select("sequence_name", F.regexp_replace("file", r"\.json$", "").alias("frame_key"), "frame"))


def frame_file_folders(files: DataFrame) -> DataFrame:
    """(folder, files): the folders of a listing that hold JSON files other than aggregated documents."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).endswith(".json") & ~name.isin(*AGGREGATED)).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def frame_number(key: Column) -> Column:
    """The number of a frame key (digits, with or without ``mask_``), null for others."""
    return F.nullif(F.regexp_extract(key, r"(?i)^(?:mask_)?(\d+)$", 1), F.lit("")).try_cast("bigint")


def frame_order(key: Column) -> list[Column]:
    """Numeric keys first by their number, others behind by their text."""
    return [F.coalesce(frame_number(key).isNull(), F.lit(True)).asc(), frame_number(key).asc(), key.asc()]


def predictions(flat: DataFrame) -> DataFrame:
    """Flat labels as predicted boxes: frame keys that are no number are skipped, a missing logit counts 0."""
    rows = flat.withColumn("frame_id", frame_number(F.col("frame_key"))).where("frame_id IS NOT NULL")
    return rows.select(F.element_at(F.split("sequence_name", "/"), -1).alias("sequence_name"), "frame_id", F.col("instance_id").alias("track_id"), "class_name", "x1", "y1", "x2", "y2", F.coalesce("logit", F.lit(0.0)).alias("score"))


def ground_truth(flat: DataFrame) -> DataFrame:
    """Flat labels as truth: null classes and instances are skipped, a missing logit counts 1."""
    return predictions(flat.where("class_name IS NOT NULL AND instance_id IS NOT NULL").withColumn("logit", F.coalesce("logit", F.lit(1.0))))


def duplicate_sequences(flat: DataFrame) -> DataFrame:
    """Sequence names (without folders) that stand for more than one key."""
    keys = flat.select("sequence_name").distinct()
    return keys.groupBy(F.element_at(F.split("sequence_name", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("keys")).where("keys > 1")


class TruthError(ValueError):
    """Truth that cannot be evaluated: none at all, or one name for several sequences."""


def read_truth(spark: SparkSession, path: str, classes: dict[str, str]) -> DataFrame:
    """Truth at ``path``: its label text where there is any, else its annotation documents. Raises ``TruthError`` where there is neither, and for repeated names."""
    from . import labels, listings

    files = listings.list_files(spark, path).select("path")
    if files.where(F.col("path").endswith(".txt")).head(1):
        return labels.read_raw_labels(spark, path, classes)
    flat = read_annotations(spark, path) if files.where(F.col("path").endswith(".json")).head(1) else None
    if flat is None or not flat.head(1):
        raise TruthError(f"no truth at {path}")
    if repeated := duplicate_sequences(flat).head(1):
        raise TruthError(f"{repeated[0]['name']} is the name of {repeated[0]['keys']} sequences")
    return ground_truth(flat)


def frame_counts(flat: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (sequence_name) with the number of frames with labels, 0 for unknown sequences."""
    counts = flat.groupBy("sequence_name").agg(F.countDistinct("frame_key").alias("frames"))
    return asked.join(counts, "sequence_name", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


def to_documents(flat: DataFrame) -> DataFrame:
    """(sequence_name, value): one JSON document for each sequence, frames and labels as objects."""
    label = F.struct(*(F.col(f) for f in FLAT[3:]))
    by_key = lambda a, b: F.when(a["frame_key"] < b["frame_key"], -1).when(a["frame_key"] > b["frame_key"], 1).otherwise(0)
    frames = flat.groupBy("sequence_name", "frame_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_key", label.alias("o"))))).alias("labels"))
    sequences = frames.groupBy("sequence_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_key", F.struct("labels"))), by_key)).alias("frames"), F.count(F.lit(1)).alias("frame_count"))
    return sequences.select("sequence_name", F.to_json(F.struct(F.col("sequence_name").alias("video_name"), "frame_count", "frames")).alias("value"))


def upsert_sequences(flat: DataFrame, path: str) -> None:
    """Writes flat labels by sequence; sequences that stand already are replaced, others stay."""
    flat.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sequence_name").parquet(path)
