"""Records that stand in an evaluation split and, exactly or almost, in a training split (problem 1).

Method: every record is a set of word sequences; the word n-grams of the evaluation records are hashed, the training
records are scanned for the same hashes, and each pair of records gets the containment of the evaluation record in the
training record. For clips the word sequence of a record is (site, batch, species, name) of each of its clips, in one
spelling, and an n-gram is the whole clip, so that two records share an n-gram if and only if they share a clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..session import cut_lineage
from ..skew import salted_join

#: Words that name a clip: three folders and the file.
CLIP_WORDS = 4

#: Between the words of a gram; no word holds it.
SEPARATOR = chr(1)


def clip_key(path: Column) -> Column:
    """site/batch/species/name of a clip in one spelling; '' for what is no path with three folders and a name."""
    tail = F.regexp_extract(names.plain_path(path), rf"(?:[^/]+/){{{CLIP_WORDS - 1}}}[^/]+$", 0)
    key = F.regexp_replace(names.file_stem(tail, names.VIDEO_ENDINGS), "_*/_*", "/")
    return names.without_copy_marks(F.regexp_replace(key, "/copy_of_", "/"))


def record_clips(records: DataFrame, record: str, videos: str) -> DataFrame:
    """(record, words): one row for each entry of the list ``videos``; no words for what is no clip."""
    entries = records.select(record, F.explode(videos).alias("_path"))
    return entries.select(record, F.filter(F.split(clip_key(F.col("_path")), "/"), lambda w: w != "").alias("words"))


def ngrams(words: Column, n: int) -> Column:
    """The word n-grams of a sequence as strings; a shorter sequence is one gram of all its words, an empty one none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), SEPARATOR)))


def record_grams(sequences: DataFrame, record: str, n: int) -> DataFrame:
    """(record, gram): the distinct n-grams of all sequences of each record."""
    return sequences.select(record, F.explode(ngrams(F.col("words"), n)).alias("gram")).distinct()


def cross_split_overlap(evaluation: DataFrame, training: DataFrame, record: str, n: int) -> DataFrame:
    """(eval_record, train_record, shared, containment) for every pair of records that share at least one word n-gram.

    Both inputs have one row (``record``, ``words`` array<string>) for each word sequence of a record. The join goes by
    a 64-bit hash of the gram and checks the gram itself, so a chance equality of hashes gives no pair. Grams of hot
    clips are salted on the training side; the evaluation side is repeated for these only. Null records and null or
    empty sequences give no row; a gram that a record holds twice counts once; other columns are not read.
    ``containment`` is shared / distinct grams of the evaluation record.
    """
    scan = _hashed_grams(training, record, n).withColumnRenamed(record, "train_record")
    sought = _hashed_grams(evaluation, record, n).select("_hash", F.col(record).alias("eval_record"), F.col("gram").alias("_sought"))
    hits = salted_join(scan, sought, "_hash", F.col("train_record")).where(F.col("gram") == F.col("_sought"))
    pairs = hits.groupBy("eval_record", "train_record").agg(F.count(F.lit(1)).alias("shared"))
    sizes = sought.groupBy("eval_record").agg(F.count(F.lit(1)).alias("_grams"))
    return pairs.join(sizes, "eval_record").select("eval_record", "train_record", "shared", (F.col("shared") / F.col("_grams")).alias("containment"))


def _hashed_grams(sequences: DataFrame, record: str, n: int) -> DataFrame:
    """(record, gram, _hash), cut once: the count of hot grams and the join both read it."""
    return cut_lineage(record_grams(sequences.where(F.col(record).isNotNull()), record, n).withColumn("_hash", F.xxhash64("gram")))


def shared_grams(evaluation: DataFrame, training: DataFrame, record: str, n: int) -> DataFrame:
    """(gram, eval_records, train_records) of every n-gram on both sides: the classes behind the pairs, whose number is the product, without any pair."""
    count = lambda df, name: record_grams(df.where(F.col(record).isNotNull()), record, n).groupBy("gram").agg(F.count(F.lit(1)).alias(name))
    return count(evaluation, "eval_records").join(count(training, "train_records"), "gram")


def training_records(sft_train: DataFrame, rl_train: DataFrame) -> DataFrame:
    columns = lambda df, split: df.select("sample_id", "videos", "source", F.lit(split).alias("split"))
    return columns(sft_train, "sft_train").unionByName(columns(rl_train, "rl_train"))


def clip_overlap(val: DataFrame, sft_train: DataFrame, rl_train: DataFrame) -> DataFrame:
    """``cross_split_overlap`` of val with both training tables by their clips."""
    training = training_records(sft_train, rl_train)
    return cross_split_overlap(record_clips(val, "sample_id", "videos"), record_clips(training, "sample_id", "videos"), "sample_id", CLIP_WORDS)


def overlap_report(val: DataFrame, sft_train: DataFrame, rl_train: DataFrame) -> DataFrame:
    """Per training split and source (null sources are one group): pairs, records on either side, evaluation records wholly contained in one."""
    training = training_records(sft_train, rl_train).select(F.col("sample_id").alias("train_record"), "split", names.slug(F.col("source")).alias("source"))
    return (
        clip_overlap(val, sft_train, rl_train)
        .join(training, "train_record")
        .groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.countDistinct("eval_record").alias("eval_records"),
            F.countDistinct("train_record").alias("train_records"),
            F.countDistinct(F.when(F.col("containment") >= 1, F.col("eval_record"))).alias("contained_records"),
        )
    )


def found(val: DataFrame, sft_train: DataFrame, rl_train: DataFrame) -> DataFrame:
    """(id_a, id_b) of p1_found."""
    pairs = clip_overlap(val, sft_train, rl_train)
    return pairs.select(F.least("eval_record", "train_record").alias("id_a"), F.greatest("eval_record", "train_record").alias("id_b"))
