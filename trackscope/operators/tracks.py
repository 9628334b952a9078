"""Tracks: occurrences, crop windows, key frames, identities and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers, geometry
from ..functions.names import instance_video

TRACK = ["sequence_name", "instance_id"]


def class_name(c: Column) -> Column:
    """Trimmed, lower case, hyphens and blanks as underscores, without dots at the end."""
    return F.rtrim(F.translate(F.lower(F.trim(c)), "- ", "__"), F.lit("."))


def detections(objects: DataFrame) -> DataFrame:
    """Flat detections: sequence keys without folders, one spelling of classes, corners in order; a missing logit counts 0."""
    return objects.select(
        F.col("object_id").alias("ord"),
        F.regexp_extract("sequence_name", "[^/]*$", 0).alias("sequence_name"),
        "frame_id",
        "instance_id",
        class_name(F.col("class_name")).alias("class_name"),
        F.least("x1", "x2").alias("x1"),
        F.least("y1", "y2").alias("y1"),
        F.greatest("x1", "x2").alias("x2"),
        F.greatest("y1", "y2").alias("y2"),
        F.coalesce("logit", F.lit(0.0)).alias("score"),
    )


def filter_boxes(boxes: DataFrame, score: float = 0.30, edge: float = 20.0) -> DataFrame:
    """Valid boxes with at least that score and shorter edge."""
    b = geometry.box()
    return boxes.where((F.col("score") >= score) & geometry.is_valid(b) & (geometry.least_edge(b) >= edge))


def track_lengths(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("rows"))


def long_tracks(boxes: DataFrame, least: int = 10) -> DataFrame:
    """Rows of tracks with at least ``least`` rows; rows without an instance are in no track."""
    return boxes.join(track_lengths(boxes).where(F.col("rows") >= least), TRACK, "left_semi")


def crop_windows(boxes: DataFrame, percentile: float = 0.8, padding: int = 50, scale: float = 1.0) -> DataFrame:
    """(track, side, max_width, max_height): an even square that holds most boxes of the track.

    From five boxes on the percentile of width and height (linear), else the largest; padding by ``crop_padding``; never
    below 80 % of the largest box. Corners are cut to whole pixels first; boxes that are not valid are left out.
    """
    whole = boxes.select(*TRACK, *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))).where(geometry.is_valid(geometry.box()))
    edges = whole.select(*TRACK, (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    stats = edges.groupBy(*TRACK).agg(
        *(F.when(F.count(F.lit(1)) >= 5, F.percentile(e, F.lit(percentile))).otherwise(F.max(e)).alias("p_" + e) for e in "wh"), F.max("w").alias("max_width"), F.max("h").alias("max_height")
    ).withColumn("pad", geometry.crop_padding(F.greatest("p_w", "p_h"), padding))
    side = lambda p, m: F.greatest((F.col(p) * scale).cast("int"), (F.col(m) * 0.8).cast("int")) + F.col("pad") * 2
    return stats.select(*TRACK, geometry.even_up(F.greatest(side("p_w", "max_width"), side("p_h", "max_height"))).alias("side"), "max_width", "max_height")


def crop_rectangles(boxes: DataFrame, windows: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(ord, x1, y1, x2, y2): the crop of each valid box, its track's square around the box's center, inside the picture."""
    whole = boxes.select("ord", *TRACK, *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))).where(geometry.is_valid(geometry.box()))
    center = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    crop = geometry.centered_crop(center("x1", "x2"), center("y1", "y2"), F.col("side"), width, height)
    return whole.join(windows, TRACK).select("ord", *(c.alias(n) for n, c in crop.items()))


def keyframe_windows(boxes: DataFrame, step: int = 10) -> DataFrame:
    """(sequence_name, key_frame, boxes, frames) of the tumbling windows [k, k + step)."""
    return boxes.groupBy("sequence_name", (F.floor(F.col("frame_id") / step) * step).alias("key_frame")).agg(F.count(F.lit(1)).alias("boxes"), F.countDistinct("frame_id").alias("frames"))


def fill(boxes: DataFrame, value: str, backward_span: int | None = None, forward_span: int | None = None) -> DataFrame:
    """(ord, track, filled): a missing value is the last known before it in its track (within ``forward_span`` frames, if given), or, with ``backward_span``, the first known in so many following frames."""
    order = Window.partitionBy(*TRACK).orderBy("frame_id", "ord")
    if backward_span is None:
        before = order.rowsBetween(Window.unboundedPreceding, 0)
        filled = F.last(value, True).over(before)
        if forward_span is not None:
            seen = F.last(F.when(F.col(value).isNotNull(), F.col("frame_id")), True).over(before)
            filled = F.when(F.col("frame_id") - seen <= forward_span, filled)
    else:
        filled = F.first(value, True).over(Window.partitionBy(*TRACK).orderBy("frame_id").rangeBetween(0, backward_span))
    return boxes.select("ord", *TRACK, filled.alias("filled"))


def new_track_ids(boxes: DataFrame) -> DataFrame:
    """(track, first_frame, new_id): tracks of a sequence numbered from 1 in the order of their first frame."""
    first = boxes.groupBy(*TRACK).agg(F.min("frame_id").alias("first_frame"))
    return first.withColumn("new_id", F.row_number().over(Window.partitionBy("sequence_name").orderBy("first_frame", "instance_id")).cast("long"))


def new_ids_per_keyframe(numbered: DataFrame, step: int = 10) -> DataFrame:
    """(sequence_name, key_frame, id_from, id_to): the new ids that appear in each key frame's window."""
    return numbered.groupBy("sequence_name", (F.floor(F.col("first_frame") / step) * step).alias("key_frame")).agg(F.min("new_id").alias("id_from"), F.max("new_id").alias("id_to"))


def category_counts(boxes: DataFrame) -> DataFrame:
    """(sequence_name, class_name, boxes) by sequence and class, by sequence, and over all (nulls mark the totals)."""
    return boxes.where(F.col("class_name").isNotNull()).rollup("sequence_name", "class_name").agg(F.count(F.lit(1)).alias("boxes"))


def sequence_map(boxes: DataFrame) -> DataFrame:
    """(sequence_name, first_frame, end_frame), the end exclusive."""
    return boxes.groupBy("sequence_name").agg(F.min("frame_id").alias("first_frame"), (F.max("frame_id") + 1).alias("end_frame"))


def frame_range(boxes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Boxes whose frame lies in its sequence's range (a, b inclusive); a sequence without range keeps all."""
    return boxes.join(ranges.select("sequence_name", "a", "b"), "sequence_name", "left").where("a IS NULL OR frame_id BETWEEN a AND b").drop("a", "b")


def allowed_frames(boxes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Boxes in the frames of ``allowed`` (sequence_name, frame_id); a sequence that is missing there keeps none."""
    return boxes.join(allowed.select("sequence_name", "frame_id").distinct(), ["sequence_name", "frame_id"], "left_semi")


def sampled_frames(frames: DataFrame, most: int) -> DataFrame:
    """Frames (sequence_name, idx from 0) of a clip as they are uploaded: all of them up to ``most``, else every (n div most)-th, at most ``most``."""
    counts = frames.groupBy("sequence_name").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    return frames.join(counts, "sequence_name").where((F.col("_n") <= most) | ((F.col("idx") % step == 0) & (F.col("idx") / step < most))).drop("_n")


def conversion_summary(boxes: DataFrame) -> DataFrame:
    """(boxes, files, non_empty_files): files are sequences; those without an instance in any row are empty."""
    per = boxes.groupBy("sequence_name").agg(F.count("instance_id").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") > 0).alias("non_empty_files"))


def result_updates(results: DataFrame, names) -> DataFrame:
    """(ord, sequence_name, instance_id, class_name): what each result says of an instance's video; nulls where its path names none or its output no class. ``names``: answers.ClassNames."""
    video = instance_video(F.col("video_path"))
    return results.select(F.col("result_id").alias("ord"), video["video_name"].alias("sequence_name"), video["instance_id"].alias("instance_id"), answers.resolve_species(F.col("question"), F.coalesce("model_raw_output", F.lit("")), names).alias("class_name"))


def load_statistics(updates: DataFrame) -> DataFrame:
    """(results_loaded, valid_predictions, skipped_results, conflicts) of ``result_updates``."""
    valid = F.col("sequence_name").isNotNull() & F.col("class_name").isNotNull()
    counts = updates.agg(F.count(F.lit(1)).alias("results_loaded"), F.count_if(valid).alias("valid_predictions"), F.count_if(~valid).alias("skipped_results"))
    return counts.crossJoin(update_conflicts(updates.where(valid)).agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts")))


class NothingParsed(ValueError):
    """Results of which none names an instance's video and a class."""


def run_update(boxes: DataFrame, results: DataFrame, names) -> tuple[DataFrame, DataFrame]:
    """(boxes with updated classes, one row of statistics: sequences, frames and labels updated, update videos without a sequence). Raises ``NothingParsed`` where no result can be used."""
    updates = result_updates(results, names).where("sequence_name IS NOT NULL AND class_name IS NOT NULL")
    if not updates.head(1):
        raise NothingParsed("no result names an instance's video and a class")
    updated = update_labels(boxes, updates)
    return updated, update_statistics(updated).crossJoin(unmatched_updates(updates, boxes).agg(F.count(F.lit(1)).alias("unmatched_videos")))


def update_statistics(updated: DataFrame) -> DataFrame:
    """(updated_sequences, updated_frames, updated_labels) of ``update_labels``."""
    changed = updated.where("updated")
    frames = changed.groupBy("sequence_name", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    return frames.agg(F.countDistinct("sequence_name").alias("updated_sequences"), F.count(F.lit(1)).alias("updated_frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("updated_labels"))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``; aggregated before the shuffle, so a hot key costs no more."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def update_labels(boxes: DataFrame, updates: DataFrame) -> DataFrame:
    """Boxes with ``class_name`` overwritten by the last update (sequence_name, instance_id, class_name, ord) of their track, and ``updated`` where that changed it."""
    last = keep_last(updates.select(*TRACK, F.col("class_name").alias("_new"), F.col("ord").alias("_o")), TRACK, "_o").drop("_o")
    joined = boxes.join(last, TRACK, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("class_name"))
    return joined.withColumn("updated", changed).withColumn("class_name", F.coalesce("_new", "class_name")).drop("_new")


def update_conflicts(updates: DataFrame) -> DataFrame:
    """(track, updates, conflicts): how often an update differs from the one before it for the same track."""
    order = Window.partitionBy(*TRACK).orderBy("ord")
    changed = F.lag("class_name").over(order)
    return updates.withColumn("_before", changed).groupBy(*TRACK).agg(F.count(F.lit(1)).alias("updates"), F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col("class_name"))).alias("conflicts"))


def unmatched_updates(updates: DataFrame, boxes: DataFrame) -> DataFrame:
    return updates.select("sequence_name").distinct().join(boxes.select("sequence_name").distinct(), "sequence_name", "left_anti")


# ---- masks as pixels ----------------------------------------------------------------------------------------------


def mask_rectangles(boxes: DataFrame) -> DataFrame:
    """(sequence_name, frame_id, instance_id, x1, y1, x2, y2): the pixels of boxes in which they are seen, later boxes lying over earlier ones.

    Exact pixels, kept as rectangles that share none; ``x2`` and ``y2`` are exclusive. A box is cut at the edges of the
    later boxes of its frame that overlap it only, so that most stay one rectangle. Boxes without corners have no pixels.
    """
    frame, corners = ["sequence_name", "frame_id"], ["x1", "y1", "x2", "y2"]
    whole = boxes.select(*frame, "instance_id", "ord", *(F.floor(c).alias(c) for c in ("x1", "y1")), *((F.floor(c) + 1).alias(c) for c in ("x2", "y2"))).dropna(subset=corners)
    later = whole.select(*(F.col(c).alias("_" + c) for c in (*frame, "ord", *corners)))
    over = F.expr("sequence_name = _sequence_name AND frame_id = _frame_id AND _ord > ord AND _x1 < x2 AND x1 < _x2 AND _y1 < y2 AND y1 < _y2")
    covers = F.collect_set(F.when(F.col("_ord").isNotNull(), F.struct(*(F.col("_" + c).alias(c) for c in corners))))
    covered = whole.join(later, over, "left").groupBy(*frame, "instance_id", "ord", *corners).agg(covers.alias("_over"))

    def bands(a: str, b: str) -> Column:
        """The parts of [a, b) between the edges of ``_over``."""
        inner = F.flatten(F.transform("_over", lambda o: F.array(F.greatest(o[a], F.col(a)), F.least(o[b], F.col(b)))))
        edges = F.array_sort(F.array_distinct(F.concat(F.array(a, b), inner)))
        return F.arrays_zip(F.slice(edges, F.lit(1), F.size(edges) - 1).alias("a"), F.slice(edges, F.lit(2), F.size(edges) - 1).alias("b"))

    rows = covered.withColumn("_y", F.explode(bands("y1", "y2"))).withColumn("_over", F.filter("_over", lambda o: (o["y1"] <= F.col("_y.a")) & (o["y2"] >= F.col("_y.b"))))
    parts = rows.withColumn("_x", F.explode(bands("x1", "x2"))).where(~F.exists("_over", lambda o: (o["x1"] <= F.col("_x.a")) & (o["x2"] >= F.col("_x.b"))))
    return parts.select(*frame, "instance_id", F.col("_x.a").alias("x1"), F.col("_y.a").alias("y1"), F.col("_x.b").alias("x2"), F.col("_y.b").alias("y2"))


def mask_boxes(mask: DataFrame) -> DataFrame:
    """(sequence_name, frame_id, instance_id, area, x1, y1, x2, y2) of each mask in pixels, the corners inclusive."""
    return mask.groupBy("sequence_name", "frame_id", "instance_id").agg(
        F.sum(F.expr("(x2 - x1) * (y2 - y1)")).alias("area"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), (F.max("x2") - 1).alias("x2"), (F.max("y2") - 1).alias("y2")
    )


def mask_iou(mask: DataFrame, step: int = 1) -> DataFrame:
    """(sequence_name, frame_id, instance_id, other_id, iou) of masks of a frame and those of the frame ``step`` before that share pixels."""
    frame = ["sequence_name", "frame_id"]
    before = mask.select("sequence_name", (F.col("frame_id") + step).alias("frame_id"), F.col("instance_id").alias("other_id"), *(F.col(c).alias("_" + c) for c in ("x1", "y1", "x2", "y2")))
    meeting = mask.join(before, frame).where("_x1 < x2 AND x1 < _x2 AND _y1 < y2 AND y1 < _y2")
    common = F.expr("(least(x2, _x2) - greatest(x1, _x1)) * (least(y2, _y2) - greatest(y1, _y1))")
    shared = meeting.groupBy(*frame, "instance_id", "other_id").agg(F.sum(common).alias("shared"))
    area = mask_boxes(mask).select(*frame, "instance_id", "area")
    other = area.select("sequence_name", (F.col("frame_id") + step).alias("frame_id"), F.col("instance_id").alias("other_id"), F.col("area").alias("other_area"))
    joined = shared.join(area, [*frame, "instance_id"]).join(other, [*frame, "other_id"])
    return joined.select(*frame, "instance_id", "other_id", (F.col("shared") / (F.col("area") + F.col("other_area") - F.col("shared"))).alias("iou"))


def _boxes_in_order(boxes: DataFrame, order: Column) -> DataFrame:
    """Boxes of a sequence with ``_rank``, the number of their frame among the sequence's frames (from 1)."""
    frames = boxes.select("sequence_name", "frame_id").distinct()
    ranked = row_numbers(frames, ["sequence_name"], "frame_id", "_rank")
    pixel = {"x1": F.floor("x1"), "y1": F.floor("y1"), "x2": F.floor("x2") + 1, "y2": F.floor("y2") + 1}
    return boxes.select("sequence_name", "frame_id", order.alias("ord"), *(c.alias(n) for n, c in pixel.items())).join(ranked, ["sequence_name", "frame_id"])


def row_numbers(rows: DataFrame, groups: list[str], order: str, name: str, width: int = 4096) -> DataFrame:
    """``rows`` numbered from 1 in each group by ``order``, a whole number that is unique in its group.

    No group is sorted in one task: rows are numbered within ranges of ``width`` values, and a range's first number
    comes from the counts of the ranges before it. Null orders are left out.
    """
    ranged = rows.where(F.col(order).isNotNull()).withColumn("_range", F.floor(F.col(order) / width))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(order))
    return ranged.withColumn("_inside", inside).join(starts, [*groups, "_range"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def mask_candidates(boxes: DataFrame, least: float) -> DataFrame:
    """(sequence_name, _rank, ord, other): boxes of a frame and those of the frame before it in the sequence whose masks, whole rectangles in pixels, overlap by more than ``least``."""
    corners = ("x1", "y1", "x2", "y2")
    before = boxes.select("sequence_name", (F.col("_rank") + 1).alias("_rank"), F.col("ord").alias("other"), *(F.col(c).alias("_" + c) for c in corners))
    iou = geometry.overlap(geometry.box(), geometry.box(prefix="_"))
    return boxes.join(before, ["sequence_name", "_rank"]).where(iou > least).select("sequence_name", "_rank", "ord", "other")


def fold_identities(frames: list[tuple[list[int], dict[int, set[int]]]]) -> dict[int, int]:
    """box -> the box that first bore its identity, over consecutive frames, each (its boxes in order, candidates in the frame before by box).

    A box takes the identity of the first tracked mask among its candidates, else a new one. Of the boxes of a frame
    with one identity the last bears it on, in the place of the first.
    """
    first: dict[int, int] = {}
    tracked: dict[int, int] = {}
    for boxes, near in frames:
        held: dict[int, int] = {}
        for box in boxes:
            mine = near.get(box, ())
            identity = next((i for i, bearer in tracked.items() if bearer in mine), box)
            first[box] = identity
            held[identity] = box
        tracked = held
    return first


def mask_associate(boxes: DataFrame, least: float = 0.65, order: str = "ord") -> DataFrame:
    """(sequence_name, frame_id, ord, track_id): identities handed on from frame to frame of each sequence.

    In each frame, by ``order`` (unique in the table), a box takes the identity of the first mask tracked in the
    sequence's frame before it whose overlap in pixels is above ``least``, else a new one; frames without boxes pass the
    tracked masks on. Several boxes may take one identity: the last bears it on. Identities count from 1 in the order
    of their first boxes. Boxes without corners, frame or order are left out; they have no pixels.

    Frames that no candidate links to the frame before start a new run, so most boxes are settled by a join alone;
    only runs of linked frames are folded, one at a time, each box as a number with its candidates.
    """
    from ..session import cut_lineage

    known = boxes.dropna(subset=["sequence_name", "frame_id", order, "x1", "y1", "x2", "y2"])
    ranked = cut_lineage(_boxes_in_order(known, F.col(order)))
    near = cut_lineage(mask_candidates(ranked, least).groupBy("sequence_name", "_rank", "ord").agg(F.collect_set("other").alias("near")))
    linked = near.select("sequence_name", "_rank").distinct()
    # frames of runs: those linked backwards, numbered so that consecutive ones share the difference, and the frame before each run
    islands = row_numbers(linked, ["sequence_name"], "_rank", "_i").select("sequence_name", "_rank", (F.col("_rank") - F.col("_i")).alias("_run"))
    heads = islands.groupBy("sequence_name", "_run").agg((F.min("_rank") - 1).alias("_rank")).select("sequence_name", "_rank", "_run")
    chained = ranked.join(islands.unionByName(heads), ["sequence_name", "_rank"]).join(near, ["sequence_name", "_rank", "ord"], "left").select("sequence_name", "_run", "_rank", "ord", "near")

    def fold(rows):
        import pandas as pd

        frames: dict[int, tuple[list, dict]] = {}
        for rank, box, mine in sorted(zip(rows["_rank"], rows["ord"], rows["near"]), key=lambda r: r[:2]):
            held = frames.setdefault(rank, ([], {}))
            held[0].append(box)
            if mine is not None and len(mine):
                held[1][box] = set(mine)
        first = fold_identities([frames[r] for r in sorted(frames)])
        return pd.DataFrame({"sequence_name": rows["sequence_name"].iloc[0], "ord": list(first), "root": list(first.values())})

    roots = chained.groupBy("sequence_name", "_run").applyInPandas(fold, "sequence_name string, ord long, root long")
    settled = cut_lineage(ranked.join(roots, ["sequence_name", "ord"], "left").withColumn("root", F.coalesce("root", "ord")))
    # a new identity's number: the new ones of earlier frames, then those before it in its frame
    fresh = settled.where("root = ord")
    before = Window.partitionBy("sequence_name", "_part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    per_frame = fresh.groupBy("sequence_name", "_rank").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.floor(F.col("_rank") / 4096))
    parts = per_frame.groupBy("sequence_name", "_part").agg(F.sum("_n").alias("_m"))
    ahead = Window.partitionBy("sequence_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("sequence_name", "_part", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_a"))
    starts = per_frame.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(offsets, ["sequence_name", "_part"]).select("sequence_name", "_rank", (F.col("_a") + F.col("_b")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("sequence_name", "_rank").orderBy("ord"))
    numbered = fresh.withColumn("_place", place).join(starts, ["sequence_name", "_rank"]).select("sequence_name", F.col("ord").alias("root"), (F.col("_before") + F.col("_place")).alias("track_id"))
    return settled.join(numbered, ["sequence_name", "root"]).select("sequence_name", "frame_id", "ord", "track_id")
