"""Queries that do the whole job, against rows counted one by one."""

import json
import random
from collections import Counter
from math import floor

from pyspark.sql import functions as F

from trackscope.operators import traces, tracks
from trackscope.plans import traces as trace_plans
from trackscope.plans import tracks as track_plans


def drawn(rows):
    """{(sequence, frame): {(x, y): instance}}, pixel by pixel in the order of ``ord``."""
    frames = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        seen = frames.setdefault((r["sequence_name"], r["frame_id"]), {})
        seen.update({(x, y): r["instance_id"] for x in range(floor(r["x1"]), floor(r["x2"]) + 1) for y in range(floor(r["y1"]), floor(r["y2"]) + 1)})
    return frames


def test_masks_are_exact_pixels(spark, folder):
    made = spark.createDataFrame(
        [("s", 1, 1, 0, 0.0, 0.0, 9.5, 9.0), ("s", 1, 2, 1, 5.0, 5.0, 14.0, 12.0), ("s", 1, 1, 2, 7.0, 2.0, 8.0, 20.0), ("s", 1, 3, 3, 30.0, 0.0, 40.0, 5.0), ("s", 1, 4, 4, 30.0, 0.0, 40.0, 5.0)]
        + [("s", 2, 7, 5, 1.0, 0.0, 10.0, 9.0), ("s", 2, 8, 6, 41.0, 0.0, 50.0, 5.0), ("t", 2, 1, 7, 0.0, 0.0, 3.0, 3.0)],
        "sequence_name string, frame_id long, instance_id long, ord long, x1 double, y1 double, x2 double, y2 double",
    )
    real = track_plans.tracked(spark, folder).where("frame_id IS NOT NULL").where(F.col("sequence_name").isin([r[0] for r in track_plans.tracked(spark, folder).groupBy("sequence_name").count().orderBy("sequence_name").limit(2).collect()]))
    for boxes in (made, real.select(*made.columns)):
        frames, masks = drawn(boxes.collect()), tracks.mask_rectangles(boxes)
        area = Counter((*f, i) for f, seen in frames.items() for i in seen.values())
        corners = {}
        for f, seen in frames.items():
            for (x, y), i in seen.items():
                a = corners.setdefault((*f, i), [x, y, x, y])
                corners[(*f, i)] = [min(a[0], x), min(a[1], y), max(a[2], x), max(a[3], y)]
        assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in tracks.mask_boxes(masks).collect()} == {k: [n, *corners[k]] for k, n in area.items()}
        shared = Counter((s, f, i, before[p]) for (s, f), seen in frames.items() for before in [frames.get((s, f - 1), {})] for p, i in seen.items() if p in before)
        iou = {k: n / (area[k[:3]] + area[(k[0], k[1] - 1, k[3])] - n) for k, n in shared.items()}
        assert {tuple(r)[:4]: round(r["iou"], 9) for r in tracks.mask_iou(masks).collect()} == {k: round(v, 9) for k, v in iou.items()}


BOXES = "sequence_name string, frame_id long, ord long, x1 double, y1 double, x2 double, y2 double, track_id int"


def identities(rows, least):
    """The loop that hands identities on, with masks as sets of pixels."""
    got = {}
    for sequence in {r[0] for r in rows}:
        tracked, count = {}, 0
        for frame in sorted({r[1] for r in rows if r[0] == sequence}):
            held = {}
            for r in sorted((r for r in rows if r[:2] == (sequence, frame)), key=lambda r: r[2]):
                mask = {(x, y) for x in range(floor(r[3]), floor(r[5]) + 1) for y in range(floor(r[4]), floor(r[6]) + 1)}
                identity = next((i for i, m in tracked.items() if len(mask & m) / len(mask | m) > least), None)
                if identity is None:
                    count += 1
                    identity = count
                held[identity] = mask
                got[r[2]] = identity
            tracked = held
    return got


def test_identities_last_over_many_frames(spark):
    rng = random.Random(4)
    rows = [("s", f * 3, f, 10.0 + f, 0.0, 40.0 + f, 20.0, 0) for f in range(30)]
    rows += [("t", f, 1000 + 10 * f + k, *(float(v + rng.randint(-2, 2)) for v in (20 * (k // 2), 0, 20 * (k // 2) + 18, 15)), 0) for f in range(40) for k in range(rng.randint(0, 5))]
    rows += [("u", f, 5000 + f, 0.0, 0.0, 5.0, 5.0, 0) for f in (0, 5000, 9000)]
    frame = spark.createDataFrame([*rows, ("s", None, 9001, 0.0, 0.0, 1.0, 1.0, 0), ("s", 1, 9002, None, 0.0, 1.0, 1.0, 0), (None, 1, 9003, 0.0, 0.0, 1.0, 1.0, 0)], BOXES)
    for least in (0.5, 0.8):
        got = {r["ord"]: r["track_id"] for r in tracks.mask_associate(frame, least).collect()}
        assert got == identities(rows, least)
    assert {got[r[2]] for r in rows if r[0] == "s"} == {1} and {got[r[2]] for r in rows if r[0] == "u"} == {1}
    assert tracks.mask_associate(frame.limit(0)).count() == 0


def test_row_numbers_are_ranks(spark):
    values = [(g, v) for g in "ab" for v in random.Random(g).sample(range(-9000, 30000), 700)] + [("a", None)]
    got = {(r["g"], r["v"]): r["n"] for r in tracks.row_numbers(spark.createDataFrame(values, "g string, v long"), ["g"], "v", "n").collect()}
    assert got == {(g, v): i + 1 for g in "ab" for i, v in enumerate(sorted(v for h, v in values if h == g and v is not None))}


def stage2(spark, folder):
    """One record with columns, the same with its lists only in raw_json, and one that failed."""
    schema = spark.read.parquet(f"{folder}/stage2_cot.parquet").schema
    rubric = lambda a, b, c: {"evidence text quality": a, "definition alignment": b, "cross attribute consistency": c}
    seen = lambda *names: [{"name": n, "status": "clear"} for n in names]
    judged = lambda name, decision, reliability, *scores: {"name": name, "decision": decision, "rubric scores": rubric(*scores), "reliability": reliability}
    lists = {
        "extracted_appearance_attributes": {"appearance_attributes": seen("eye.ring_gold", "whisker.none", "no.such_name")},
        "extracted_behavior_attributes": {"behavior_attributes": [*seen("rest.on_gravel", "swim.circles_wall", None, "swim.circles_wall")]},
        "validated_appearance_attributes": {"validated_appearance": [judged("eye.ring_gold", "Keep", 1.0, 2, 2, 2), judged("whisker.none", "drop", 0.9, 1, 1, 1)]},
        "validated_behavior_attributes": {"validated_behavior": [judged("rest.on_gravel", None, 0.5, 1, 1, 1)]},
    }
    text = json.dumps(lists)
    rows = [{"record_id": 1, **lists, "raw_json": None}, {"record_id": 2, "raw_json": text}, {"record_id": 3, "error": "failed"}]
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_integrity_covers_both_lists_and_raw_json(spark, folder, tmp_path):
    stage2(spark, folder).write.parquet(str(tmp_path / "stage2_cot.parquet"))
    rows = trace_plans.queries()["validation_integrity"](spark, str(tmp_path)).collect()
    got = {(r["record_id"], r["list_name"]): tuple(r)[2:] for r in rows}
    whole = {"appearance": (3, 2, 1, 1, 1, 0, 1, 0), "behavior": (4, 1, 1, 0, 0, 0, 0, 1)}
    assert got == {(i, s): whole[s] if i < 3 else (0,) * 8 for i in (1, 2, 3) for s in whole} and len(rows) == 6


def test_chat_samples_keep_every_turn(spark, folder, tmp_path):
    schema = spark.read.parquet(f"{folder}/sft_train.parquet").select("sample_id", "messages", "videos").schema
    turns = [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")]
    rows = [(1, turns, ["v.mp4"]), (2, turns[1:3], None), (3, [turns[1], None, ("assistant", None), turns[0]], []), (4, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sft_train.parquet"))
    got = {r["sample_id"]: (r["turns"], list(zip(r["roles"], r["contents"]))) for r in trace_plans.queries()["chat_samples"](spark, str(tmp_path)).collect()}
    assert got == {1: (5, turns), 2: (2, turns[1:3]), 3: (2, [turns[0], turns[1]]), 4: (0, [])}


def test_truth_is_looked_up_among_all_rows(spark, tmp_path):
    rows = [
        (1, "a", {"ground_truth": "(A) x"}), (2, "a", {"ground_truth": "(B) y"}), (3, "a", {"site": "s"}), (4, "b", {"answer": "(C) z"}), (5, "b", {"ground_truth": "", "answer": "(D) w"}),
        (7, "c", {"ground_truth": "", "answer": "(E) v"}), (8, "d", {"answer": "(F) u"}), (10, "e", {"site": "s"}), (11, None, {"ground_truth": "(G) t"}),
    ]
    text = [(*r, "<answer>(B) y</answer>", "(B) y") for r in rows]
    spark.createDataFrame(text, "result_id long, video_path string, source_item map<string,string>, model_raw_output string, prediction string").write.parquet(str(tmp_path / "res.parquet"))
    run = lambda name: trace_plans.queries()[name](spark, str(tmp_path)).collect()
    truth = {r["result_id"]: r["truth"] for r in run("ground_truth_lookup")}
    assert truth == {1: "(B) y", 2: "(B) y", 3: "(B) y", 4: "", 5: "", 7: "", 8: "(F) u", 10: None, 11: "(G) t"}
    assert {tuple(r) for r in run("mc_accuracy_species")} == {("(b) y", 3, 3), ("(f) u", 1, 0), ("(g) t", 1, 0)}
    assert tuple(run("mc_accuracy")[0]) == (9, 5, 3, 0.333333, 0.333333)
    assert {r["result_id"] for r in run("answer_reward") if r["reward"] == 1.0} == {1, 2, 3}


def test_vocabulary_labels_both_lists(spark, folder, tmp_path):
    stage2(spark, folder).write.parquet(str(tmp_path / "stage2_cot.parquet"))
    got = sorted((r["record_id"], r["label"], r["name"], r["definition"]) for r in trace_plans.queries()["vocab_join"](spark, str(tmp_path)).collect())
    whole = [("A17", "whisker.none", "appearance: whisker.none"), ("A3", "eye.ring_gold", "appearance: eye.ring_gold"), ("B11", "rest.on_gravel", "behaviour: rest.on_gravel"), *[("B9", "swim.circles_wall", "behaviour: swim.circles_wall")] * 2]
    assert got == [(i, *w) for i in (1, 2) for w in whole]


def test_vocabulary_knows_every_name(spark, folder):
    lists = traces.attribute_lists(spark.read.parquet(f"{folder}/stage2_cot.parquet"))
    names = {(r[0], r[1]) for r in lists.select("list_name", F.explode("extracted")).distinct().collect() if r[1] is not None}
    assert names <= {("appearance", w) for w in trace_plans.APPEARANCE} | {("behavior", w) for w in trace_plans.BEHAVIOUR}
