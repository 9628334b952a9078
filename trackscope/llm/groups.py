"""Splits that keep related records together (problem 3).

Method: connected components by alternating large-star and small-star steps over the links between records' entities,
then the component's identifier is hashed into ranges as wide as the splits' proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..session import cut_lineage
from ..skew import salted_join

#: The hash of a component is one of so many equal parts.
HASH_PARTS = 1 << 30


def star_links(pairs: DataFrame, member: str, entity: str) -> DataFrame:
    """(a, b) with a > b: each member linked to the smallest member of each of its entities; as many links as pairs at most.

    Members of one entity are never paired with each other. Null members or entities link nothing. Hot entities are salted.
    """
    known = cut_lineage(pairs.select(F.col(member).alias("a"), F.col(entity).alias("_entity")).where("a IS NOT NULL AND _entity IS NOT NULL").distinct())
    centers = known.groupBy("_entity").agg(F.min("a").alias("b"))
    return salted_join(known, centers, "_entity", F.col("a")).where("a <> b").select("a", "b").distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("_least"))
    return salted_join(near.where("b > a"), least, "a", F.col("b")).select(F.col("b").alias("a"), F.least("a", "_least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = salted_join(links, least, "a", F.col("b")).where("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the links (a, b) the smallest node that it is connected with.

    Rounds of a large-star and a small-star step run until the links no longer change; their number grows with the
    logarithm of the number of nodes. After each round the links go to the checkpoint folder. Nothing but a count and a
    sum of hashes comes to the driver. A link from a node to itself is ignored; empty links give an empty table.
    """
    current = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seal = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = seal(current)
    for _ in range(most_rounds):
        current = cut_lineage(_small_star(_large_star(current)))
        after = seal(current)
        if after == before:
            roots = current.select("b").distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
        before = after
    raise RuntimeError(f"the components still change after {most_rounds} rounds")


def task_video(source: Column) -> Column:
    """The video that a crop file's name starts with (``<video>_<instance>_<frame>``), in one spelling; '' if there is none."""
    return F.regexp_extract(names.file_stem(names.file_name(source), names.IMAGE_ENDINGS), r"^(.+)_\d+_\d+$", 1)


def sequence_video(sequence: Column) -> Column:
    """The video of a sequence key, without folders, in one spelling."""
    return names.file_stem(names.file_name(sequence), names.VIDEO_ENDINGS)


def fish_tag(tag: Column) -> Column:
    """The number of a tag, '' for texts that name no fish (no number, or number zero)."""
    return F.regexp_extract(names.slug(tag), r"^pt_?0*([1-9]\d*)$", 1)


def video_components(objects: DataFrame) -> DataFrame:
    """(node, component) of videos that are linked by tags of fish; videos without such links are missing.

    Equal readings are dropped before their spellings are looked at, so the texts of most rows are never parsed.
    """
    raw = objects.select("sequence_name", "fish_tag").where("fish_tag IS NOT NULL AND sequence_name IS NOT NULL").distinct()
    read = raw.select(sequence_video(F.col("sequence_name")).alias("video"), fish_tag(F.col("fish_tag")).alias("tag"))
    return components(star_links(read.where("video <> '' AND tag <> ''"), "video", "tag"))


def task_groups(tasks: DataFrame, objects: DataFrame, alone: bool = False) -> DataFrame:
    """(task_id, group_task_id): each task whose source names a video, with the smallest task_id of its group.

    Tasks with a null id are missing; those with a null or empty source, or one that names no video, are missing too, or,
    with ``alone``, groups of their own. A file planned twice is two tasks of one group. The videos of one group need
    not all have tasks. Hot videos and a component that holds most videos are salted.
    """
    parsed = cut_lineage(tasks.where("task_id IS NOT NULL").select("task_id", task_video(F.col("source")).alias("video")))
    named = parsed.where("video <> ''")
    videos = named.groupBy("video").agg(F.min("task_id").alias("first_task"))
    joined = cut_lineage(videos.join(video_components(objects).withColumnRenamed("node", "video"), "video", "left").withColumn("component", F.coalesce("component", "video")))
    first = joined.groupBy("component").agg(F.min("first_task").alias("group_task_id"))
    by_video = salted_join(joined, first, "component", F.col("video")).select("video", "group_task_id")
    grouped = salted_join(named, by_video, "video", F.col("task_id")).select("task_id", "group_task_id")
    return grouped.unionByName(parsed.where("video IS NULL OR video = ''").select("task_id", F.col("task_id").alias("group_task_id"))) if alone else grouped


def split_of(group: Column, targets: list[tuple[str, float]], seed: int = 0) -> Column:
    """The split into whose range the hash of ``group`` falls; ranges are as wide as the proportions, in the order of names."""
    total = sum(share for _, share in targets)
    spot = F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(HASH_PARTS))
    bound, chosen = total, F.lit(None).cast("string")
    for name, share in sorted(targets, reverse=True):
        chosen = F.when(spot < round(bound / total * HASH_PARTS), F.lit(name)).otherwise(chosen)
        bound -= share
    return chosen


def assign_splits(tasks: DataFrame, objects: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(task_id, group_task_id, split_name): tasks of one group get one split, tasks without a video by themselves. ``targets`` is a fixed table of a few rows."""
    wanted = [(r["split_name"], r["proportion"]) for r in targets.where("split_name IS NOT NULL AND proportion > 0").select("split_name", "proportion").collect()]
    return task_groups(tasks, objects, alone=True).withColumn("split_name", split_of(F.col("group_task_id"), wanted, seed))


def split_report(tasks: DataFrame, objects: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: groups, tasks and their share, next to the wanted proportion. A group larger than a split's proportion shifts the shares."""
    assigned = assign_splits(tasks, objects, targets)
    counts = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("tasks"), F.countDistinct("group_task_id").alias("groups"))
    total = counts.agg(F.sum("tasks").alias("_all"))
    return (
        targets.select("split_name", "proportion")
        .join(counts, "split_name", "left")
        .crossJoin(total)
        .select("split_name", "proportion", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("tasks", F.lit(0)).alias("tasks"), F.expr("coalesce(try_divide(tasks, _all), 0D)").alias("share"))
    )


def found(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """(group_task_id, task_id) of p3_found."""
    return task_groups(tasks, objects).where("task_id <> group_task_id").select("group_task_id", "task_id")
