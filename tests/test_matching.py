"""Traps of matching and average precision, against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from trackscope.operators import matching
from trackscope.operators.ranks import values_at_ranks

KEYS = ["sequence_name", "frame_id", "class_name"]
SCHEMA = "sequence_name string, frame_id long, class_name string, ord long, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(spark, *rows):
    return spark.createDataFrame([("s", r[0], "fish", r[1], *map(float, r[2:6]), float(r[6])) for r in rows], SCHEMA)


def test_first_pass_keeps_last_and_second_keeps_best(spark):
    truth = boxes(spark, (1, 1, 0, 0, 40, 40, 1))
    found = boxes(spark, (1, 10, 0, 0, 40, 40, 0.9), (1, 11, 0, 0, 40, 30, 0.8))
    groups = matching.matching_groups(truth, found, KEYS, {"all": 0.0})
    assert matching.match_last(groups).first()["scores"] == [0.8]
    at = matching.match_best(groups, F.array(F.lit(0.0), F.lit(0.85))).orderBy("idx").collect()
    assert [(r["tp"], r["fp"], r["fn"]) for r in at] == [(1, 1, 0), (1, 0, 0)]


def test_low_truth_is_ignored_in_easy_only(spark):
    truth, found = boxes(spark, (1, 1, 0, 0, 40, 15, 1)), boxes(spark, (1, 10, 0, 0, 40, 15, 0.9))
    first = {r["difficulty"]: (r["eligible"], r["tp"]) for r in matching.match_last(matching.matching_groups(truth, found, KEYS)).collect()}
    assert first == {"easy": (0, 0), "moderate": (1, 1), "hard": (1, 1)}


def test_score_zero_matches_in_second_pass_only(spark):
    truth, found = boxes(spark, (1, 1, 0, 0, 40, 40, 1)), boxes(spark, (1, 10, 0, 0, 40, 40, 0.0))
    groups = matching.matching_groups(truth, found, KEYS, {"all": 0.0})
    assert matching.match_last(groups).first()["tp"] == 0
    assert matching.match_best(groups, F.array(F.lit(0.0))).first()["tp"] == 1


def sampled(m, n):
    """Plain restatement of the recall sampler, with the running sum in double precision."""
    out, recall = [], 0.0
    for i in range(1, m + 1):
        left, right = i / n, (i + 1) / n if i < m else i / n
        if right - recall < recall - left and i < m:
            continue
        out.append(i)
        recall += 1 / 40
    return out


def test_threshold_ranks_equal_the_running_sum(spark):
    pairs = [(m, n) for n in range(1, 130, 3) for m in range(1, n + 1, 2)] + [(36, 42), (5000, 7000), (0, 5), (3, 0), (399, 399)]
    rows = spark.createDataFrame(pairs, "m long, n long").select("m", "n", matching.threshold_ranks(F.col("m"), F.col("n")).alias("r")).collect()
    assert all(r["r"] == (sampled(r["m"], r["n"]) if r["m"] and r["n"] else []) for r in rows)
    assert max(len(r["r"]) for r in rows) <= matching.POINTS


def test_three_alignments(spark):
    truth, found = boxes(spark, (3, 1, 0, 0, 9, 9, 1), (7, 2, 0, 0, 9, 9, 1)), boxes(spark, (5, 3, 0, 0, 9, 9, 1))
    frames = lambda mode: sorted(r["frame_id"] for r in matching.align_frames(truth, found, mode).collect())
    assert (frames("union"), frames("gt_present"), frames("gt_range")) == ([3, 5, 7], [3, 7], [3, 4, 5, 6, 7])


def test_values_at_ranks_with_ties(spark):
    rng = random.Random(1)
    values = [round(rng.random(), 2) for _ in range(500)] + [1.5, -3.0]
    scores = spark.createDataFrame([("a", v) for v in values], "g string, score double")
    ranks = spark.createDataFrame([("a", r) for r in (1, 2, 77, 250, 502, 503)], "g string, rank long")
    got = {r["rank"]: r["value"] for r in values_at_ranks(scores, ranks, ["g"]).collect()}
    ordered = sorted(values, reverse=True)
    assert got == {r: ordered[r - 1] for r in (1, 2, 77, 250, 502)}


def test_no_truth_or_no_prediction(spark):
    none = boxes(spark, (1, 1, 0, 0, 9, 9, 1)).limit(0)
    some = boxes(spark, (1, 1, 0, 0, 30, 30, 1))
    assert matching.detection_ap(none, some, ["class_name"], KEYS).count() == 0
    assert {(r["ap11"], r["ap41"]) for r in matching.detection_ap(some, none, ["class_name"], KEYS).collect()} == {(0.0, 0.0)}


@pytest.mark.parametrize("second,iou", [((0, 0, 10, 10), 1.0), ((20, 20, 30, 30), 0.0), ((0, 0, 0, 0), 0.0)])
def test_overlap_guards(spark, second, iou):
    from trackscope.functions import geometry

    lits = lambda b: tuple(F.lit(float(x)) for x in b)
    assert spark.range(1).select(geometry.overlap(lits((0, 0, 10, 10)), lits(second))).first()[0] == iou


def test_occlusion_and_truncation_set_flags(spark):
    truth = boxes(spark, *((1, i, 100 * i, 0, 100 * i + 40, 40, 1) for i in range(5)))
    found = boxes(spark, *((1, 10 + i, 100 * i, 0, 100 * i + 40, 40, 0.9) for i in range(5)))
    marked = truth.withColumn("occlusion", F.when(F.col("ord") == 4, -1.0).otherwise(F.col("ord").cast("double"))).withColumn("truncation", F.when(F.col("ord") == 0, 0.12).otherwise(-1.0))
    first = {r["difficulty"]: (r["eligible"], r["tp"]) for r in matching.match_last(matching.matching_groups(marked, found, KEYS)).collect()}
    assert first == {"easy": (2, 2), "moderate": (2, 2), "hard": (3, 3)}


def plain_matches(truth, found, least, threshold):
    """The second pass box by box."""
    height = lambda b: b[5] - b[3]

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        shared = w * h if w > 0 and h > 0 else 0.0
        return shared / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - shared)

    tp = fn = 0
    used = set()
    for t in truth:
        best, most = None, 0.0
        for k, p in enumerate(found):
            if k in used or p[6] < threshold or not iou(t, p) > matching.MATCH_IOU:
                continue
            if height(p) >= least and iou(t, p) > most:
                best, most = k, iou(t, p)
            elif height(p) < least and best is None:
                best = k
        if best is None:
            fn += height(t) >= least
            continue
        used.add(best)
        tp += height(t) >= least and height(found[best]) >= least
    return tp, sum(k not in used and p[6] >= threshold and height(p) >= least for k, p in enumerate(found)), fn


def test_second_pass_equals_brute_force(spark):
    rng = random.Random(9)
    box = lambda i: (1, i, *(lambda x, y: (x, y, x + rng.randint(20, 60), y + rng.randint(8, 40)))(rng.randint(-40, 900), rng.randint(-20, 300)), rng.randint(0, 20) / 20)
    truth, found = [box(i) for i in range(150)], [box(1000 + i) for i in range(260)]
    groups = matching.matching_groups(boxes(spark, *truth), boxes(spark, *found), KEYS, {"low": 10.0, "high": 20.0})
    at = {(r["difficulty"], r["threshold"]): (r["tp"], r["fp"], r["fn"]) for r in matching.match_best(groups, F.array(*(F.lit(t) for t in (0.5, 0.0, 0.9)))).collect()}
    assert at == {(name, t): plain_matches(truth, found, least, t) for name, least in (("low", 10), ("high", 20)) for t in (0.0, 0.5, 0.9)}
    pairs = {(r["truth_ord"], r["predicted_ord"]) for r in matching.iou_pairs(boxes(spark, *truth), boxes(spark, *found), KEYS).collect()}
    assert len(pairs) > 50 and len(pairs) == matching.iou_pairs(boxes(spark, *truth), boxes(spark, *found), KEYS).count()


def test_groups_hold_boxes_and_not_their_pairs(spark):
    truth, found = boxes(spark, *((1, i, 0, 0, 40, 40, 1) for i in range(90))), boxes(spark, *((1, 1000 + i, 0, 0, 40, 40, 0.9) for i in range(70)))
    row = matching.matching_groups(truth, found, KEYS).rows.first()
    assert sum(len(v) for v in row if isinstance(v, list)) == 6 * 90 + 7 * 70


def test_frames_without_a_sequence_count_as_in_sql(spark):
    nameless = lambda b: b.withColumn("sequence_name", F.lit(None).cast("string"))
    groups = matching.matching_groups(nameless(boxes(spark, (1, 1, 0, 0, 40, 40, 1))), nameless(boxes(spark, (1, 10, 0, 0, 40, 40, 0.9))), KEYS, {"all": 0.0})
    first, at = matching.match_last(groups).first(), matching.match_best(groups, F.array(F.lit(0.0))).first()
    assert (first["eligible"], first["tp"], at["tp"], at["fp"], at["fn"]) == (1, 0, 0, 0, 0)


def test_truths_given_twice_match_one_prediction_each(spark):
    truth = boxes(spark, *[(1, 1, 0, 0, 40, 40, 1)] * 2)
    groups = matching.matching_groups(truth, boxes(spark, (1, 10, 0, 0, 40, 40, 0.9), (1, 11, 0, 0, 40, 39, 0.8)), KEYS, {"all": 0.0})
    at = matching.match_best(groups, F.array(F.lit(0.0))).first()
    assert (at["tp"], at["fp"], at["fn"], matching.match_last(groups).first()["tp"]) == (2, 0, 0, 2)


def test_second_pass_takes_a_score_that_is_not_a_number_as_the_largest(spark):
    groups = matching.matching_groups(boxes(spark, (1, 1, 0, 0, 40, 40, 1)), boxes(spark, (1, 10, 0, 0, 40, 40, "nan")), KEYS, {"all": 0.0})
    at = matching.match_best(groups, F.array(F.lit(0.0), F.lit(0.6))).collect()
    assert [(r["tp"], r["fp"], r["fn"]) for r in at] == [(1, 0, 0), (1, 0, 0)]


def test_curve_runs_the_first_pass_once(spark, monkeypatch):
    written, cut = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    matching.detection_curve(boxes(spark, (1, 1, 0, 0, 40, 40, 1)), boxes(spark, (1, 10, 0, 0, 40, 40, 0.9)), ["class_name"], KEYS)
    assert sum("scores" in columns for columns in written) == 1


def test_first_pass_takes_a_score_that_is_not_a_number_as_above_0(spark):
    groups = matching.matching_groups(boxes(spark, (1, 1, 0, 0, 40, 40, 1)), boxes(spark, (1, 10, 0, 0, 40, 40, "nan")), KEYS, {"all": 0.0})
    assert matching.match_last(groups).first()["tp"] == 1


def test_thresholds_read_the_first_pass_from_where_it_is_written(spark, folder):
    from trackscope.plans import boxes as plan

    assert "MapInArrow" not in plan._thresholds(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_frames_side_by_side_match_as_one_by_one():
    import numpy as np

    from trackscope.operators import greedy

    rng = random.Random(4)
    box = lambda i: (1, i, *(lambda x, y: (x, y, x + rng.randint(20, 60), y + rng.randint(8, 40)))(rng.randint(0, 200), rng.randint(0, 60)), rng.randint(0, 20) / 20)
    frames = [([box(i) for i in range(n)], [box(1000 + i) for i in range(m)]) for n, m in ((300, 200), (5, 90), (0, 3), (40, 0), (80, 120))]

    def side(rows):
        a = np.array(rows, float).reshape(-1, 7)
        height = a[:, 5] - a[:, 3]
        return greedy.Boxes.of(a[:, 1].astype(int), a[:, 2:6].T, (height < 10) * 1 + (height < 20) * 2, a[:, 6])

    at = np.array([0.0, 0.5, 0.9])
    got = greedy.take_best([(side(t), side(p), {1: at, 2: at}) for t, p in frames], matching.MATCH_IOU)
    for (truth, found), counts in zip(frames, got):
        for bit, least in ((1, 10), (2, 20)):
            assert [tuple(c) for c in counts[bit].T.tolist()] == [plain_matches(truth, found, least, t) for t in at]


def test_many_frames_go_side_by_side(monkeypatch):
    import numpy as np

    from trackscope.operators import greedy

    side = lambda score: greedy.Boxes.of(np.array([1]), np.array([[0.0], [0.0], [40.0], [40.0]]), np.array([0]), score)
    calls, together = [], greedy._together
    monkeypatch.setattr(greedy, "_together", lambda frames, at_least: calls.append(len(frames)) or together(frames, at_least))
    got = greedy.take_best([(side(None), side(np.array([0.5])), {1: np.array([0.2, 0.6])})] * 200, matching.MATCH_IOU)
    assert calls == [200] and all(counts[1].tolist() == [[1, 0], [0, 0], [0, 1]] for counts in got)


def test_boxes_become_lists_without_a_list_for_each_row(spark):
    one = boxes(spark, (1, 1, 0, 0, 40, 40, 1))
    assert "collect_list" not in matching.matching_groups(one, one, KEYS, cut=False).rows._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_boxes_over_batches_and_equal_hashes(monkeypatch):
    import pyarrow as pa

    # Hash, key, whether predicted, ord: a key over three batches, two keys with one hash, one without a name, one without truth.
    rows = [(1, "a", False, 3), (1, "a", True, 8), (1, "a", False, 2), (2, "b", False, 5), (2, "c", True, 6), (2, "b", True, 7), (2, "c", False, 9), (3, None, False, 1), (4, "d", True, 4)]
    names = ["_hash", "k", "_p", "ord", "x1", "y1", "x2", "y2", "score", "mask"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, (*r, 0.0, 0.0, 1.0, 1.0, 0.5, 0))) for r in rows[i : i + 2]], pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.bool_(), pa.int64(), *[pa.float64()] * 5, pa.int32()])))) for i in range(0, len(rows), 2)]
    monkeypatch.setattr(matching, "ROWS", 2)
    got = sorted((r["k"] or "", r["t_ord"], r["p_ord"]) for batch in matching._gathered(["k"], iter(batches)) for r in batch.to_pylist())
    assert got == [("", [1], []), ("a", [2, 3], [8]), ("b", [5], [7]), ("c", [9], [6])]


@pytest.mark.parametrize("step", [1.0, 0.37])
def test_passes_over_parts_and_blocks_choose_as_one_by_one(monkeypatch, step):
    import numpy as np

    from trackscope.operators import greedy

    for name, value in (("PART", 17), ("BLOCK", 8), ("CELLS", 200), ("FIRST", 2)):
        monkeypatch.setattr(greedy, name, value)
    rng = random.Random(6)
    box = lambda i: (1, i, *(lambda x, y: (x * step, y * step, (x + rng.randint(20, 60)) * step, (y + rng.randint(24, 90)) * step))(rng.randint(0, 90), rng.randint(0, 60)), rng.randint(0, 20) / 20)
    truth, found = [box(i) for i in range(120)], [box(1000 + i) for i in range(140)]
    truth_side, found_side = (greedy.Boxes.of(a[:, 1].astype(int), a[:, 2:6].T, (a[:, 5] - a[:, 3] < 20) * 1, a[:, 6]) for a in (np.array(truth, float), np.array(found, float)))
    at = np.array([0.0, 0.5, 0.9])
    counts = greedy.take_best([(truth_side, found_side, {1: at})], matching.MATCH_IOU)[0][1]
    assert [tuple(c) for c in counts.T.tolist()] == [plain_matches(truth, found, 20, t) for t in at]
    free, last = set(range(len(found))), []
    for k, t in enumerate(truth):
        area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
        shared = lambda a, b: max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
        near = [p for p in free if found[p][6] > 0 and shared(t, found[p]) / (area(t) + area(found[p]) - shared(t, found[p])) > matching.MATCH_IOU]
        if near:
            free.discard(max(near))
            last.append((k, max(near)))
    assert list(zip(*(x.tolist() for x in greedy.take_last(truth_side, found_side, matching.MATCH_IOU)))) == last


def test_pairs_round_halves_up_in_double_precision(spark):
    # 5 / 16 = 0.3125, a half at 3 places; 4 / 16 is below the limit.
    one, other = boxes(spark, (1, 1, 0, 0, 16, 1, 1)), boxes(spark, (1, 2, 0, 0, 5, 1, 1), (1, 3, 0, 0, 4, 1, 1))
    assert [tuple(r) for r in matching.iou_pairs(one, other, KEYS, places=3).collect()] == [("s", 1, "fish", 1, 2, 0.313)]
    assert matching.iou_pairs(one, other, KEYS).first()["iou"] == 0.3125
    plan = matching.iou_pairs(one, other, KEYS, places=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_pairs_are_whole_over_parts(spark, monkeypatch):
    import numpy as np

    from trackscope.operators import greedy

    monkeypatch.setattr(greedy, "PAIRS", 640)
    n = 45
    side = greedy.Boxes.of(np.arange(n), np.array([[0.0], [0.0], [40.0], [40.0]]) + np.zeros(n), np.zeros(n, int))
    got = [(a, b) for t, p, _ in greedy.pairs(side, side, 0.3) for a, b in zip(t.tolist(), p.tolist())]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(n)]


def test_first_pass_looks_at_few_overlaps(monkeypatch):
    import numpy as np

    from trackscope.operators import greedy

    # Boxes at three places, of which the last predictions take the first truths: most pairs need no look.
    n = 600
    left = np.arange(n) % 3 * 100.0
    side = greedy.Boxes.of(np.arange(n), np.stack([left, np.zeros(n), left + 40, np.full(n, 40.0)]), np.zeros(n, int), np.full(n, 0.5))
    seen, overlaps = [], greedy._shared_and_whole
    monkeypatch.setattr(greedy, "_shared_and_whole", lambda *a: seen.append(np.broadcast(a[0][0], a[1][0]).size) or overlaps(*a))
    t, p = greedy.take_last(side, side, matching.MATCH_IOU)
    assert [list(p[t % 3 == k]) for k in range(3)] == [list(range(n - 3 + k, -1, -3)) for k in range(3)]
    assert sum(seen) < n * n / 4


def test_first_pass_gathers_boxes_where_it_matches_them(spark):
    one = boxes(spark, (1, 1, 0, 0, 40, 40, 1))
    first = matching.match_last(matching.matching_groups(one, one, KEYS, cut=False))
    assert first._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and first.first()["tp"] == 1


def test_boxes_are_written_once_and_packed(spark, monkeypatch):
    written, cut = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    nameless = boxes(spark, (2, 5, 0, 0, 40, 40, 1)).withColumn("class_name", F.lit(None).cast("string"))
    truth = boxes(spark, (1, 1, 0, 0, 40, 40, 1), (1, 2, 100, 0, 140.1, 15, 1)).union(nameless)
    found = boxes(spark, (1, 10, 0, 0, 40, 40, 0.9), (1, 11, 100.1, 0, 140.1, 15, 0.8)).union(nameless)
    curve = matching.detection_curve(truth, found, ["sequence_name", "frame_id"], KEYS)
    at = {(r["difficulty"], r["idx"]): (r["tp"], r["fp"], r["fn"]) for r in curve.where("frame_id = 1").collect()}
    assert at == {("easy", 0): (1, 0, 0), **{(d, i): (1 + i, 0, 1 - i) for d in ("moderate", "hard") for i in (0, 1)}}
    assert sum("t_boxes" in columns for columns in written) == 1 and not any("t_ord" in columns for columns in written)


def test_packed_boxes_are_as_before():
    import numpy as np

    from trackscope.operators import greedy

    for corner in (3.0, 0.1, float("nan")):
        side = greedy.Boxes.of(np.array([7, 1 << 40]), np.array([[0.0, corner], [0.0, 1.0], [40.0, 50.0], [9.0, 8.0]]), np.array([0, 3]), np.array([0.3, float("nan")]), np.array([True, False]))
        back = matching._unpacked(matching._packed(side))
        assert all(np.array_equal(getattr(side, c), getattr(back, c), equal_nan=c in ("corners", "score")) for c in ("ord", "corners", "mask", "score", "scored"))
    assert len(matching._packed(greedy.Boxes.of(np.arange(9), np.zeros((4, 9)), np.zeros(9, int)))) == 16 + 9 * (8 + 8 + 4 * 4 + 4 + 1)
