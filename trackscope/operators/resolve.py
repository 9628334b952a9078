"""Finding the counterpart of a thing by several names, and laying lists against each other by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers


def resolve_tasks(tasks: DataFrame, sequences: DataFrame) -> DataFrame:
    """``tasks`` (sequence_key, video_name) with ``resolved``: the key itself where it is known, else the video's name, else the only key that ends in that name; null for none or several.

    ``sequences``: sequence_key. Repeated keys count once.
    """
    keys = sequences.select(F.col("sequence_key").alias("_k")).where("_k IS NOT NULL").distinct()
    base = F.element_at(F.split("_k", "/"), -1)
    only = keys.groupBy(base.alias("_base")).agg(F.min("_k").alias("_only"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    exact, named = (keys.select(F.col("_k").alias(c)) for c in ("_exact", "_named"))
    found = tasks.join(exact, F.col("sequence_key") == F.col("_exact"), "left").join(named, F.col("video_name") == F.col("_named"), "left").join(only, F.col("video_name") == F.col("_base"), "left")
    return found.withColumn("resolved", F.coalesce("_exact", "_named", "_only")).drop("_exact", "_named", "_base", "_only")


def padded_frame(name: Column) -> Column:
    """A frame's file name with its number in six digits at least; names without a number stay."""
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    number = F.trim(stem).try_cast("bigint")
    return F.when(number.isNotNull(), F.concat(F.format_string("%06d", number), end)).otherwise(name)


def frames_with_annotations(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    """``frames`` (sequence_name, file) with the annotation columns of their padded name (sequence_name, frame_key); null without one."""
    keyed = frames.withColumn("frame_key", F.regexp_replace(padded_frame(F.col("file")), r"\.[^.]*$", ""))
    return keyed.join(annotations, ["sequence_name", "frame_key"], "left")


def in_frame_order(frames: DataFrame, groups: list[str], name: str) -> DataFrame:
    """``frames`` with ``place`` columns (number, text) to sort by: by number where all names of the group are numbers, else all by text."""
    number = F.trim(F.regexp_replace(name, r"\.[^.]*$", "")).try_cast("bigint")
    whole = frames.groupBy(*groups).agg(F.bool_and(number.isNotNull()).alias("_whole"))
    return frames.join(whole, groups).withColumn("place_number", F.when(F.col("_whole"), number)).withColumn("place_text", F.col(name)).drop("_whole")


def first_existing(aliases: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, found): the first of each name's aliases (name, aliases array) that exists (``existing``: alias); null if none does."""
    each = aliases.select("name", F.posexplode_outer("aliases").alias("_p", "alias"))
    found = each.join(existing.select("alias").distinct().withColumn("_e", F.lit(True)), "alias", "left")
    return found.groupBy("name").agg(F.min_by(F.col("alias"), F.when(F.col("_e"), F.col("_p"))).alias("_a"), F.bool_or(F.coalesce("_e", F.lit(False))).alias("_any")).select("name", F.when(F.col("_any"), F.col("_a")).alias("found"))


def plan_actions(plan: DataFrame, present: DataFrame) -> DataFrame:
    """``plan`` (source, target, length) with ``action``: ``skipped`` where the target is present (path, length) with the same length, ``replaced`` where it differs, else ``created``."""
    held = present.select(F.col("path").alias("target"), F.col("length").alias("_held"))
    action = F.when(F.col("_held").isNull(), "created").when(F.col("_held").eqNullSafe(F.col("length")), "skipped").otherwise("replaced")
    return plan.join(held, "target", "left").withColumn("action", action).drop("_held")


def completed(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, done): whether as many outputs stand as are expected (``expected``: key, n; ``present``: one row for each output)."""
    counts = present.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return expected.join(counts, key, "left").select(key, (F.coalesce("_n", F.lit(0)) >= F.col("n")).alias("done"))


def reference_of(position: Column, references: Column, completions: Column) -> Column:
    """Which of ``references`` texts belongs to the completion at ``position`` (from 0) of ``completions``: each is repeated as often as it goes in evenly; null (no reference) for what is left."""
    times = F.greatest(F.floor(completions / F.greatest(references, F.lit(1))), F.lit(1))
    index = F.floor(position / times).cast("int")
    return F.when((references > 0) & (index < references), index)


def reward_references(groups: DataFrame, key: str) -> DataFrame:
    """(key, position, completion, reference): completions with their references, both arrays of a row of ``groups``.

    A reference is the reasoning, where that is empty the solution, at its place; arrays are ``completions``,
    ``reasoning`` and ``solutions``. Completions without a reference get ''.
    """
    longest = F.greatest(F.size(F.coalesce("reasoning", F.array().cast("array<string>"))), F.size(F.coalesce("solutions", F.array().cast("array<string>"))))
    at = lambda c, i: F.nullif(F.get(F.col(c), i), F.lit(""))
    texts = F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.coalesce(at("reasoning", i), at("solutions", i), F.lit("")))).otherwise(F.array().cast("array<string>"))
    rows = groups.select(key, texts.alias("_refs"), F.size("completions").alias("_n"), F.posexplode("completions").alias("position", "completion"))
    return rows.select(key, "position", "completion", F.coalesce(F.get("_refs", reference_of(F.col("position"), F.size("_refs"), F.col("_n"))), F.lit("")).alias("reference"))


def zipped_rewards(groups: DataFrame, key: str) -> DataFrame:
    """(key, position, reward): the answer reward of completions and solutions laid against each other; what is longer is cut."""
    pairs = F.filter(F.arrays_zip("completions", "solutions"), lambda p: F.lit(True))
    short = F.least(F.size("completions"), F.size("solutions"))
    rows = groups.where(F.col("completions").isNotNull() & F.col("solutions").isNotNull()).select(key, short.alias("_n"), F.posexplode(pairs).alias("position", "_p")).where("position < _n")
    return rows.select(key, "position", answers.answer_reward(F.col("_p.completions"), F.col("_p.solutions")).alias("reward"))
