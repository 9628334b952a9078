"""Files known by their paths: videos, frame folders, class folders; JSON results, benchmarks, thresholds and the knowledge base."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Endings by what looks for them: videos to extract, their frames, pictures of class folders, pictures of experiments, videos to annotate.
VIDEOS = ("mp4", "avi", "mov", "mkv", "mpeg", "mpg", "wmv", "m4v")
FRAMES = ("jpg", "jpeg", "png")
PICTURES = ("jpg", "jpeg", "png", "webp")
EXPERIMENT_PICTURES = (*PICTURES, "bmp")
#: Endings of an annotated video, the first that stands being taken.
ANNOTATED = ("mp4", "mov", "avi")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _below(path: Column, root: str) -> Column:
    """The path behind the folder ``root``."""
    plain = re.escape(root.rstrip("/").removeprefix("file://").removeprefix("file:"))
    return F.regexp_replace(path, f"^(?:[A-Za-z][A-Za-z0-9+.-]*:/*)?/?{plain.lstrip('/')}/", "")


def discover_videos(files: DataFrame, root: str, most_bytes: int | None = None) -> DataFrame:
    """(path, relative, kind), in order: videos (smaller than ``most_bytes``) and folders with pictures of their own, directly below ``root`` or one folder deeper.

    What lies below a folder that is one of these itself doesn't count.
    """
    rows = files.withColumn("relative", _below(F.col("path"), root))
    depth = F.size(F.split("relative", "/"))
    videos = rows.where(ending(F.col("path")).isin(*VIDEOS) & (F.lit(most_bytes is None) | (F.col("length") < (most_bytes or 0))) & (depth <= 2)).select("path", "relative", F.lit("video").alias("kind"))
    folders = rows.where(ending(F.col("path")).isin(*FRAMES) & depth.between(2, 3)).select(parent(F.col("path")).alias("path"), parent(F.col("relative")).alias("relative"), F.lit("frames").alias("kind")).distinct()
    tops = folders.where(~F.contains("relative", F.lit("/"))).select(F.col("relative").alias("_top"))
    every = videos.unionByName(folders).withColumn("_top", F.when(F.contains("relative", F.lit("/")), F.element_at(F.split("relative", "/"), 1)))
    return every.join(tops, "_top", "left_anti").select("path", "relative", "kind").orderBy("path")


def class_folders(files: DataFrame, root: str, any_case: bool = True, most: int | None = None, endings: tuple[str, ...] = PICTURES) -> DataFrame:
    """(path, class_name, class_idx): pictures in the folders directly below ``root``, the first ``most`` by path of each.

    The index is the folder's place by name among all that lies in ``root``, so files beside the folders leave gaps
    (empty folders, of which a listing of files does not know, leave none).
    """
    rows = files.withColumn("_r", F.split(_below(F.col("path"), root), "/")).withColumn("class_name", F.get("_r", F.lit(0)))
    entries = rows.select("class_name").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("class_name")) - 1)
    end = ending(F.col("path")) if any_case else F.regexp_extract("path", r"\.([^./]+)$", 1)
    pictures = rows.where(end.isin(*endings) & (F.size("_r") == 2)).select("path", "class_name")
    if most is not None:
        pictures = pictures.withColumn("_n", F.row_number().over(Window.partitionBy("class_name").orderBy("path"))).where(F.col("_n") <= most).drop("_n")
    return pictures.join(F.broadcast(entries), "class_name").select("path", "class_name", "class_idx")


def watchlist(files: DataFrame, root: str) -> list[str]:
    """The names of the folders below ``root`` whose names don't begin with a dot, in order; raises if there is none. Classes are few."""
    parts = F.split(_below(F.col("path"), root), "/")
    names = [r[0] for r in files.where((F.size(parts) >= 2) & (_below(F.col("path"), root) != F.col("path"))).select(F.get(parts, F.lit(0)).alias("n")).distinct().where(~F.col("n").startswith(".")).orderBy("n").collect()]
    if not names:
        raise FileNotFoundError(f"no class folders at {root}")
    return names


def video_layout(path: Column) -> Column:
    """struct<video_name, output, group>: the name (without a video's ending), the folder behind the first ``video`` part if two parts or more follow it, and both as a path."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "video")
    group = F.when((at > 0) & (F.size(parts) - at >= 2), F.try_element_at(parts, (at + 1).cast("int")))
    name = F.regexp_replace(F.element_at(parts, -1), rf"(?i)\.(?:{'|'.join(VIDEOS)})$", "")
    return F.struct(name.alias("video_name"), F.concat_ws("/", group, name).alias("output"), group.alias("group"))


def paired_files(left: DataFrame, right: DataFrame, holding: str | None = None) -> DataFrame:
    """(name, left_path, right_path): files of two listings by their names, a missing side null; only names that hold a text, if given."""
    named = lambda files, side: files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias(side))
    both = named(left, "left_path").join(named(right, "right_path"), "name", "full")
    return both if holding is None else both.where(F.contains("name", F.lit(holding)))


def locate_videos(asked: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``asked`` (video_id) with ``path``: the file of that name directly below ``root``, by the order of ``ANNOTATED``, else the first by path at any depth; null without one."""
    relative, end = _below(F.col("path"), root), ending(F.col("path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    direct = F.when(~F.contains(relative, F.lit("/")), F.nullif(F.array_position(F.array(*(F.lit(e) for e in ANNOTATED)), end), F.lit(0)))
    found = files.groupBy(stem.alias("video_id")).agg(F.min_by("path", F.struct(F.coalesce(direct, F.lit(9)), "path")).alias("path"))
    return asked.join(found, "video_id", "left")


def read_species_results(spark: SparkSession, path: str) -> DataFrame:
    """(fish_code, file, video_id, fish_type, annotation): ``<path>/<code>/*.json`` without an error and with a ``rethink_annotation``, in order."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).withColumn("file", F.col("_metadata.file_path"))
    doc = F.try_parse_json("value")
    text = lambda key: F.try_variant_get(doc, f"$.{key}", "string")
    rows = files.where(F.size(F.split(_below(F.col("file"), path), "/")) == 2).select(
        F.element_at(F.split("file", "/"), -2).alias("fish_code"), "file", text("video_id").alias("video_id"), text("fish_type").alias("fish_type"),
        F.to_json(F.try_variant_get(doc, "$.rethink_annotation", "variant")).alias("annotation"), F.try_variant_get(doc, "$.error", "variant").alias("_error"),
    )
    return rows.where("_error IS NULL AND annotation IS NOT NULL AND annotation NOT IN ('{}', 'null', '\"\"', '[]')").drop("_error").orderBy("file")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``{"results": [...]}`` documents."""
    schema = "results array<struct<benchmark_index:bigint,video_path:string,question:string,model_raw_output:string,prediction:string,has_think:boolean,has_rethink:boolean,has_answer:boolean,format_ok:boolean,error:string,source_item:map<string,string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("results"))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(benchmark_index, video_path, question, ground_truth, answer) of a JSON list, indexed by place."""
    text = spark.read.option("wholetext", True).text(path)
    items = F.from_json("value", "array<struct<video_path:string,question:string,ground_truth:string,answer:string>>")
    return text.select(F.posexplode(items).alias("benchmark_index", "i")).select("benchmark_index", "i.*")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, similarity_threshold, l2_distance_threshold) with ``default``; partial entries take the default's fields."""
    t = "struct<similarity_threshold:double,l2_distance_threshold:double>"
    doc = spark.read.schema(f"default {t}, classes map<string,{t}>").option("multiLine", True).json(path)
    fields = ("similarity_threshold", "l2_distance_threshold")
    every = doc.select(F.col("default").alias("d"), F.explode_outer("classes").alias("class_name", "t")).where("class_name IS NOT NULL").select("class_name", *(F.coalesce(f"t.{f}", f"d.{f}").alias(f) for f in fields))
    return every.unionByName(doc.select(F.lit("default").alias("class_name"), *(F.col(f"default.{f}").alias(f) for f in fields)))


def knowledge_lookup(asked: DataFrame, species: DataFrame) -> DataFrame:
    """``asked`` (name) with the first species (pos, name, aliases) whose name or alias it is, in any case; null without one."""
    keys = species.select(F.col("pos"), F.col("name").alias("species"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_k"))
    first = keys.groupBy(F.lower("_k").alias("_k")).agg(F.min_by("species", "pos").alias("species"))
    return asked.join(first, F.lower(F.trim("name")) == F.col("_k"), "left").drop("_k")
