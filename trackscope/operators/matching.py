"""Alignment of frames, greedy matching of boxes, and average precision.

Pairs and greedy assignments take the boxes of a frame as lists in Arrow batches and compute overlaps there (``greedy``):
pairs grow with the square of the boxes in a frame, so that lists of candidates would outgrow the boxes that they come from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from . import greedy
from .ranks import values_at_ranks



@dataclass(frozen=True)
class Level:
    """What counts at a difficulty: boxes at least so high, and truths with at most so much occlusion and truncation (where these are known, i.e. not negative)."""

    least_height: float
    most_occlusion: float = float("inf")
    most_truncation: float = float("inf")


#: Overlap above which boxes may match, recall points, limits by difficulty.
MATCH_IOU = 0.3
POINTS = 41
DIFFICULTIES = {"easy": Level(20.0, 0, 0.15), "moderate": Level(10.0, 1, 0.1), "hard": Level(10.0, 2, 0.1)}

BOX_FIELDS = ("ord", "x1", "y1", "x2", "y2", "score")
FRAME = ["sequence_name", "frame_id"]


def frames_of(boxes: DataFrame) -> DataFrame:
    return boxes.select(*FRAME).distinct()


def align_frames(truth: DataFrame, predicted: DataFrame, mode: str = "union") -> DataFrame:
    """(sequence_name, frame_id, in_truth, in_predicted) of the frames that count.

    ``union``: frames of either side; ``gt_present``: frames of the truth; ``gt_range``: every whole frame between the
    truth's first and last in a sequence.
    """
    t = frames_of(truth).withColumn("in_truth", F.lit(True))
    p = frames_of(predicted).withColumn("in_predicted", F.lit(True))
    if mode == "gt_range":
        spans = truth.groupBy("sequence_name").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b"))
        base = spans.select("sequence_name", F.explode(F.sequence("a", "b")).alias("frame_id")).join(t, FRAME, "left")
    else:
        base = t
    joined = base.join(p, FRAME, "full" if mode == "union" else "left")
    return joined.select(*FRAME, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_truth", "in_predicted")))


def alignment_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("sequence_name").agg(
        F.count_if(F.col("in_truth") & F.col("in_predicted")).alias("common"), F.count_if(F.col("in_truth") & ~F.col("in_predicted")).alias("truth_only"), F.count_if(~F.col("in_truth") & F.col("in_predicted")).alias("predicted_only")
    )


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by keys over all shuffle partitions. What follows grows (boxes to pairs, rows to folds), so partitions that look small before it must not be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _levels(truth: DataFrame, difficulties: dict[str, Level | float] | None) -> list[tuple[Level, list[str]]]:
    """The settings that differ on this truth, with the difficulties of each; occlusion and truncation count only where the truth has them."""
    known: dict[Level, list[str]] = {}
    for name, level in (difficulties or DIFFICULTIES).items():
        level = level if isinstance(level, Level) else Level(level)
        level = Level(level.least_height, level.most_occlusion if "occlusion" in truth.columns else float("inf"), level.most_truncation if "truncation" in truth.columns else float("inf"))
        known.setdefault(level, []).append(name)
    return list(known.items())


def _mask(boxes: DataFrame, levels: list[tuple[Level, list[str]]]) -> Column:
    """A bit for each level at which a box has flag 1: it may match, but counts nowhere."""
    height = F.col("y2") - F.col("y1")

    def flagged(level: Level) -> Column:
        rules = [(height > 0) & (height < level.least_height)]
        rules += [(F.col(c) >= 0) & (F.col(c) > most) for c, most in (("occlusion", level.most_occlusion), ("truncation", level.most_truncation)) if c in boxes.columns and most != float("inf")]
        return F.coalesce(rules[0], F.lit(False)) if len(rules) == 1 else F.greatest(*(F.coalesce(r, F.lit(False)) for r in rules))

    return sum((F.when(flagged(level), F.lit(1 << i)).otherwise(F.lit(0)) for i, (level, _) in enumerate(levels)), F.lit(0))


@dataclass(frozen=True)
class Groups:
    """Frames (and classes) with truth, ready to be matched: ``rows`` has keys and the boxes of both sides, a list for each field (``t_...``, ``p_...``) or packed.

    ``flat``: the boxes by a hash of their keys, if ``rows`` were not written.
    """

    rows: DataFrame
    keys: list[str]
    names: list[list[str]]
    flat: DataFrame | None = None

    def named(self, df: DataFrame) -> DataFrame:
        """``level`` replaced by a row for each ``difficulty`` that it stands for."""
        table = F.array(*(F.array(*(F.lit(n) for n in names)) for names in self.names))
        return df.withColumn("difficulty", F.explode(F.get(table, F.col("level")))).drop("level")


#: The lists of a group's row.
T_LISTS = [f"t_{c}" for c in (*BOX_FIELDS[:5], "mask")]
LISTS = [*T_LISTS, *(f"p_{c}" for c in (*BOX_FIELDS, "mask"))]
#: The same as bytes, which pass between Spark and Python as they are.
PACKED = ["t_boxes", "p_boxes"]


def matching_groups(truth: DataFrame, predicted: DataFrame, keys: list[str], difficulties: dict[str, Level | float] | None = None, cut: bool = True) -> Groups:
    """The groups of truth and predictions, for all difficulties, thresholds and passes (with ``cut`` they are written).

    A group is one frame (and class), so its lists stay small. ``truth`` may have ``occlusion`` and ``truncation``;
    difficulties that no column tells apart are matched once. Rows with null corners overlap nothing.
    """
    levels = _levels(truth, difficulties)
    box = [F.col("ord").cast("bigint").alias("ord"), *(F.col(c).cast("double").alias(c) for c in BOX_FIELDS[1:5])]
    t = truth.select(*keys, F.lit(False).alias("_p"), *box, F.lit(None).cast("double").alias("score"), _mask(truth, levels).alias("mask"))
    p = predicted.select(*keys, F.lit(True).alias("_p"), *box, F.col("score").cast("double").alias("score"), _mask(predicted.drop("occlusion", "truncation"), levels).alias("mask"))
    # One sort key that is a whole number is sorted by its digits; rows of one key then follow each other.
    flat = _spread(t.unionByName(p, True), keys).withColumn("_hash", F.xxhash64(*keys)).sortWithinPartitions("_hash")
    kinds = [f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} array<{flat.schema[c[2:]].dataType.simpleString()}>" for c in LISTS]
    rows = flat.mapInArrow(partial(_gathered, keys), ", ".join(kinds))
    return Groups(cut_lineage(rows) if cut else rows, keys, [names for _, names in levels], None if cut else flat)


#: Rows of boxes that are made lists at once, where a group has no more.
ROWS = 1 << 17


def _gathered(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes that come by ``_hash`` of their keys as a row for each group with truth, of lists by ``ord``."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        boxes = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        # The last hash may go on in the next batch.
        hashes = boxes.column("_hash").to_numpy()
        ready = int(np.searchsorted(hashes, hashes[-1]))
        if ready:
            yield from _group_lists(keys, boxes.slice(0, ready))
        held, rows = [boxes.slice(ready)], boxes.num_rows - ready
        enough = max(ROWS, 2 * rows)
    if rows:
        yield from _group_lists(keys, pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _group_lists(keys: list[str], boxes: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each group with truth among ``boxes``. Keys decide, so that hashes may be equal by chance."""
    codes = []
    for k in keys:
        coded = boxes.column(k).dictionary_encode("encode")
        codes.append(coded.indices.to_numpy(zero_copy_only=False))
    side, ords = boxes.column("_p").to_numpy(zero_copy_only=False).astype(np.int8), boxes.column("ord")
    place = np.lexsort((ords.fill_null(0).to_numpy(), side, *codes, boxes.column("_hash").to_numpy()))
    new = np.zeros(len(place), bool)
    new[0] = True
    for code in codes:
        new[1:] |= code[place[1:]] != code[place[:-1]]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    side = side[place]
    truths = np.bincount(group[side == 0], minlength=len(starts))
    some = np.flatnonzero(truths)
    if not len(some):
        return
    kept = truths[group] > 0
    columns = [boxes.column(k).take(pa.array(place[starts[some]])) for k in keys]
    for name, n in (("t", truths), ("p", np.bincount(group[side == 1], minlength=len(starts)))):
        at = pa.array(place[kept & (side == (name == "p"))])
        ends = pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32())
        columns += [pa.ListArray.from_arrays(ends, boxes.column(c[2:]).take(at)) for c in LISTS if c[0] == name]
    yield pa.RecordBatch.from_arrays(columns, names=[*keys, *LISTS])


def _lists(column: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ends of the lists of an Arrow column, their values, and which of these are not null."""
    values = column.values
    known = np.asarray(values.is_valid())
    filled = values.fill_null(float("nan") if pa.types.is_floating(values.type) else 0) if values.null_count else values
    return column.offsets.to_pylist(), filled.to_numpy(zero_copy_only=False), known


def _packed(boxes: greedy.Boxes) -> bytes:
    """``boxes`` as bytes; corners in single precision where that is exact."""
    corners = boxes.corners.astype(np.float32)
    corners = corners if np.array_equal(corners, boxes.corners) else boxes.corners
    return b"".join(a.tobytes() for a in (np.array([len(boxes.ord), corners.itemsize]), boxes.ord.astype(np.int64), boxes.score.astype(float), corners, boxes.mask.astype(np.int32), boxes.scored))


def _unpacked(packed: bytes) -> greedy.Boxes:
    n, size = np.frombuffer(packed, np.int64, 2).tolist()
    fields, at = [], 16
    for kind, times in ((np.int64, 1), (float, 1), (f"f{size}", 4), (np.int32, 1), (bool, 1)):
        fields.append(np.frombuffer(packed, kind, n * times, at))
        at += fields[-1].nbytes
    ord_, score, corners, mask, scored = fields
    return greedy.Boxes(ord_, corners.reshape(4, n).astype(float), mask, score, scored)


def _frames(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[greedy.Boxes, greedy.Boxes] | None]:
    """Truth and predictions of each row. Keys with a null match nothing (None)."""
    if PACKED[0] in batch.schema.names:
        for sides in zip(*(batch.column(c) for c in PACKED)):
            yield tuple(_unpacked(side.as_buffer()) for side in sides) if sides[0].is_valid else None
        return
    lists = {c: _lists(batch.column(c)) for c in LISTS}
    unkeyed = np.zeros(batch.num_rows, bool)
    for k in keys:
        unkeyed |= np.asarray(batch.column(k).is_null())
    for i in range(batch.num_rows):
        if unkeyed[i]:
            yield None
            continue
        sides = []
        for side in "tp":
            ends = lists[side + "_ord"][0]
            cut = slice(ends[i], ends[i + 1])
            corners = np.stack([lists[f"{side}_{c}"][1][cut] for c in BOX_FIELDS[1:5]])
            scores = [lists["p_score"][k][cut] for k in (1, 2)] if side == "p" else []
            sides.append(greedy.Boxes.of(lists[side + "_ord"][1][cut], corners, lists[side + "_mask"][1][cut], *scores))
        yield tuple(sides)


def iou_pairs(truth: DataFrame, predicted: DataFrame, keys: list[str], at_least: float = MATCH_IOU, places: int | None = None) -> DataFrame:
    """(keys, truth_ord, predicted_ord, iou) of boxes with one set of keys whose overlap is above ``at_least``, rounded to ``places``, halves up in double precision."""
    narrow = lambda boxes: boxes.select(*keys, *BOX_FIELDS[:5], F.lit(0.0).alias("score"))
    groups = matching_groups(narrow(truth), narrow(predicted), keys, {"all": 0.0}, cut=False)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for i, sides in enumerate(_frames(batch, keys)):
                for t, p, overlap in greedy.pairs(*sides, at_least) if sides else ():
                    held.append((np.full(len(t), i), sides[0].ord[t], sides[1].ord[p], overlap))
                    rows += len(t)
                    if rows >= ROWS:
                        yield _pair_rows(batch, keys, held, places)
                        held, rows = [], 0
            if rows:
                yield _pair_rows(batch, keys, held, places)

    kinds = ", ".join(f"`{k}` {groups.rows.schema[k].dataType.simpleString()}" for k in keys)
    return groups.rows.select(*keys, *LISTS).mapInArrow(fold, f"{kinds}, truth_ord long, predicted_ord long, iou double")


def _pair_rows(batch: pa.RecordBatch, keys: list[str], held: list[tuple[np.ndarray, ...]], places: int | None) -> pa.RecordBatch:
    at, truth, found, overlap = map(np.concatenate, zip(*held))
    if places is not None:
        scaled = overlap * 10.0**places
        floor = np.floor(scaled)
        overlap = (floor + (scaled - floor >= 0.5)) / 10.0**places
    at = pa.array(at)
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(truth), pa.array(found), pa.array(overlap)], names=[*keys, "truth_ord", "predicted_ord", "iou"])


def match_last(groups: Groups) -> DataFrame:
    """(keys, difficulty, eligible, tp, scores): first pass, in which a truth takes the last prediction that qualifies (score above 0)."""
    return groups.named(_first_pass(groups))


def _first_pass(groups: Groups, keep: bool = False) -> DataFrame:
    """(keys, level, eligible, tp, scores); with ``keep`` the boxes too, packed, in the row of level 0."""
    levels, keys, gather = len(groups.names), list(groups.keys), groups.flat is not None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(keys, batches) if gather else batches:
            eligible, found, none = [], [], np.empty(0)
            packed: list[list[bytes | None]] = [[], []]
            ends, masks, _ = _lists(batch.column("t_mask"))
            for i, sides in enumerate(_frames(batch, keys)):
                if sides:
                    truth, near = sides
                    t, p = greedy.take_last(truth, near, MATCH_IOU)
                    both, scores = truth.mask[t] | near.mask[p], near.score[p]
                if keep:
                    for side, boxes in zip(packed, sides or (None, None)):
                        side += [boxes and _packed(boxes), *[None] * (levels - 1)]
                for level in range(levels):
                    eligible.append(np.count_nonzero(masks[ends[i] : ends[i + 1]] & 1 << level == 0))
                    found.append(scores[both & 1 << level == 0] if sides else none)
            at = pa.array(np.repeat(np.arange(batch.num_rows), levels))
            sizes = [len(s) for s in found]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([none, *found]), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(list(range(levels)) * batch.num_rows, pa.int32()), pa.array(eligible, pa.int64()), pa.array(sizes, pa.int64()), lists, *(pa.array(side, pa.binary()) for side in packed[: 2 * keep])], names=[*keys, "level", "eligible", "tp", "scores", *PACKED[: 2 * keep]])

    kinds = ", ".join(f"`{k}` {groups.rows.schema[k].dataType.simpleString()}" for k in groups.keys)
    boxes = groups.flat if gather else groups.rows.select(*groups.keys, *LISTS)
    return boxes.mapInArrow(fold, f"{kinds}, level int, eligible long, tp long, scores array<double>" + "".join(f", {c} binary" for c in PACKED[: 2 * keep]))


def _first_and_packed(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> tuple[DataFrame, Groups]:
    """The first pass, written together with the boxes that it gathered, and these for the second."""
    groups = matching_groups(truth, predicted, keys, cut=False)
    first = cut_lineage(_first_pass(groups, True))
    return first.drop(*PACKED), replace(groups, rows=first.where("level = 0").select(*keys, *PACKED), flat=None)


def match_best(groups: Groups, thresholds: Column | DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, difficulty, idx, threshold, tp, fp, fn): second pass at each of the (few) thresholds of a row.

    ``thresholds``: an array for all groups, or a table (by, level, thresholds). Sums over the groups of a batch with
    equal ``by`` (the keys, unless given) come out as one row, so ``by`` may repeat: sum over it.
    Predictions below the threshold are left out; unused ones with flag 0 are false. A threshold has its place (``idx``)
    in the array, whose order is free.
    """
    by, keys, levels = by or groups.keys, list(groups.keys), len(groups.names)
    boxes = PACKED if PACKED[0] in groups.rows.columns else LISTS
    if isinstance(thresholds, Column):
        rows = groups.rows.withColumn("_th", F.array(*[thresholds.cast("array<double>")] * levels))
    else:
        lists = thresholds.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("level", "thresholds"))).alias("_m"))
        # A row for each class: by a shuffle all frames of a class would go to one task.
        lists = lists if set(FRAME) <= set(by) else F.broadcast(lists)
        rows = groups.rows.join(lists, by).withColumn("_th", F.array(*(F.try_element_at("_m", F.lit(i)) for i in range(levels))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, tuple[np.ndarray, list[float]]] = {}
            # Frames that go side by side should have about as many truths.
            truths = pc.binary_length(batch.column("t_boxes")).fill_null(0).to_numpy(zero_copy_only=False) if PACKED[0] in batch.schema.names else np.diff(batch.column("t_ord").offsets.to_numpy())
            batch = batch.take(pa.array(np.argsort(truths, kind="stable")))
            names = zip(*(batch.column(k).to_pylist() for k in by))
            frames = zip(names, batch.column("_th").to_pylist(), _frames(batch, keys))
            while some := list(islice(frames, greedy.SIDE)):
                parts = []
                for key, asked, sides in some:
                    asked = {level: np.array(th, float) for level, th in enumerate(asked) if th is not None}
                    rising = {level: np.argsort(th, kind="stable") for level, th in asked.items()}
                    for level, th in asked.items():
                        sums.setdefault((*key, level), (np.zeros((3, len(th)), np.int64), th))
                    for start in range(0, max(map(len, asked.values()), default=0) if sides else 0, greedy.BITS):
                        part = {level: order[start : start + greedy.BITS] for level, order in rising.items() if len(order) > start}
                        parts.append((key, part, (*sides, {1 << level: asked[level][order] for level, order in part.items()})))
                for (key, part, _), counts in zip(parts, greedy.take_best([frame for *_, frame in parts], MATCH_IOU)):
                    for level, order in part.items():
                        sums[*key, level][0][:, order] += counts[1 << level]
            flat = [(*key, i, t, *row) for key, (total, th) in sums.items() for i, (t, row) in enumerate(zip(th.tolist(), total.T.tolist()))]
            columns = list(zip(*flat)) or [()] * (len(by) + 6)
            kinds = [*(batch.schema.field(k).type for k in by), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*by, "level", "idx", "threshold", "tp", "fp", "fn"])

    kinds = ", ".join(f"`{k}` {groups.rows.schema[k].dataType.simpleString()}" for k in by)
    return groups.named(rows.select(*keys, *boxes, "_th").mapInArrow(fold, f"{kinds}, level int, idx int, threshold double, tp long, fp long, fn long"))


def threshold_ranks(found: Column, eligible: Column) -> Column:
    """Ranks (from 1, by falling score) of the scores that become recall thresholds, at most ``POINTS`` of them.

    Rank i is passed over while (i + 1) / n is nearer to the recall sought than i / n, the last rank never; after each
    choice the recall sought grows by 1 / 40 in double precision. Which ranks are chosen depends on the two counts
    alone, so no score is read; each step looks at the few ranks around its solution.
    """
    m, n = found.cast("long"), eligible.cast("double")
    start = F.struct(F.lit(0.0).alias("recall"), F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        recall = state["recall"]
        guess = F.floor(recall * n - 0.5).cast("long")
        tries = F.filter(F.sequence(guess - 2, guess + 3), lambda i: (i > state["last"]) & (i < m) & ~(((i + 1) / n - recall) < (recall - i / n)))
        first = F.coalesce(F.get(tries, F.lit(0)), m)
        first = F.when(guess - 2 <= state["last"] + 1, F.coalesce(F.get(F.filter(F.sequence(state["last"] + 1, F.greatest(state["last"] + 1, guess + 3)), lambda i: (i < m) & ~(((i + 1) / n - recall) < (recall - i / n))), F.lit(0)), m)).otherwise(first)
        next_state = lambda i: F.struct((recall + F.lit(1.0) / F.lit(POINTS - 1.0)).alias("recall"), i.alias("last"), F.concat(state["ranks"], F.array(i)).alias("ranks"))
        return F.when(state["last"] >= m, state).otherwise(F.get(F.transform(F.array(first), next_state), F.lit(0)))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(POINTS + 1)), start, step)["ranks"]
    return F.when((m > 0) & (n > 0), chosen).otherwise(F.array().cast("array<bigint>"))


def pr_thresholds(matched: DataFrame, by: list[str], level: str = "difficulty") -> DataFrame:
    """(by, difficulty, idx, threshold): recall thresholds of each group of frames from the first pass; idx counts from 0."""
    keys = [*by, level]
    counts = matched.groupBy(*keys).agg(F.sum("eligible").alias("eligible"), F.sum("tp").alias("found"))
    ranks = counts.select(*keys, F.posexplode(threshold_ranks(F.col("found"), F.col("eligible"))).alias("idx", "rank")).withColumn("rank", F.col("rank").cast("long"))
    scores = matched.select(*keys, F.explode("scores").alias("score"))
    return values_at_ranks(scores, ranks, keys).select(*keys, "idx", F.col("value").alias("threshold"))


def pr_curve(groups: Groups, by: list[str], thresholds: DataFrame) -> DataFrame:
    """(by, difficulty, idx, threshold, tp, fp, fn, precision, recall) at each threshold; ``thresholds``: by, level, idx, threshold."""
    lists = thresholds.groupBy(*by, "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "threshold"))), lambda x: x["threshold"]).alias("thresholds"))
    sums = match_best(groups, lists, by).groupBy(*by, "difficulty", "idx", "threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda part, rest: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(part) + F.col(rest)), F.lit(0.0))
    return sums.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def precision_envelope(curve: DataFrame, by: list[str]) -> DataFrame:
    """The curve with each precision replaced by the largest from there on (slots without a threshold count 0)."""
    onwards = Window.partitionBy(*by, "difficulty").orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    return curve.withColumn("envelope", F.max("precision").over(onwards))


def average_precision(curve: DataFrame, by: list[str], known: DataFrame, rounded: bool = True) -> DataFrame:
    """(by, difficulty, ap11, ap41) in percent, to six places if ``rounded``, for all of ``known`` (by, difficulty); without a curve 0."""
    ap = precision_envelope(curve, by).groupBy(*by, "difficulty").agg((F.sum("envelope") / POINTS * 100).alias("ap41"), (F.sum(F.when(F.col("idx") % 4 == 0, F.col("envelope"))) / 11 * 100).alias("ap11"))
    return known.join(ap, [*by, "difficulty"], "left").select(*by, "difficulty", *((F.round(F.coalesce(c, F.lit(0.0)), 6) if rounded else F.coalesce(c, F.lit(0.0))).alias(c) for c in ("ap11", "ap41")))


def detection_ap(truth: DataFrame, predicted: DataFrame, by: list[str], keys: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """(by, difficulty, ap11, ap41): both passes over the frames with truth (of the class, where ``by`` names the class)."""
    first, groups = _first_and_packed(truth, predicted, keys or list(dict.fromkeys([*FRAME, *by])))
    thresholds = cut_lineage(pr_thresholds(first, by, "level"))
    known = groups.named(first.select(*by, "level").distinct())
    return average_precision(pr_curve(groups, by, thresholds), by, known, rounded)


def detection_curve(truth: DataFrame, predicted: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """``pr_curve`` of both passes."""
    first, groups = _first_and_packed(truth, predicted, keys)
    return pr_curve(groups, by, cut_lineage(pr_thresholds(first, by, "level")))


def mean_ap(ap: DataFrame, by: list[str]) -> DataFrame:
    """(by, map11, map41): the means over the difficulties of ``ap``, which should not be rounded before."""
    return ap.groupBy(*by).agg(F.round(F.avg("ap11"), 6).alias("map11"), F.round(F.avg("ap41"), 6).alias("map41"))


def macro_ap(ap: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(difficulty, ap11, ap41, classes): means over the classes that completed; every difficulty has a row, of zeros where none did."""
    means = ap.groupBy("difficulty").agg(F.avg("ap11").alias("ap11"), F.avg("ap41").alias("ap41"), F.count(F.lit(1)).alias("classes"))
    every = ap.sparkSession.createDataFrame([(n,) for n in names or DIFFICULTIES], "difficulty string")
    return every.join(means, "difficulty", "left").select("difficulty", *(F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in ("ap11", "ap41")), F.coalesce("classes", F.lit(0)).alias("classes"))
