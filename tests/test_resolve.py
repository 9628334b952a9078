"""Counterparts by several names, lists by position, and small text functions."""

import pytest
from pyspark.sql import functions as F

from trackscope.functions import answers, geometry, names
from trackscope.operators import resolve, tracks


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tasks_by_key_name_or_only_basename(spark):
    tasks = spark.createDataFrame([("g/a", "a"), ("h/b", "b"), ("x/c", "c"), ("y/d", "d"), ("z/e", "e"), (None, None)], "sequence_key string, video_name string")
    known = spark.createDataFrame([(k,) for k in ("g/a", "a", "b", "q/c", "r/d", "s/d", "g/a", None)], "sequence_key string")
    assert {r["sequence_key"]: r["resolved"] for r in resolve.resolve_tasks(tasks, known).collect()} == {"g/a": "g/a", "h/b": "b", "x/c": "q/c", "y/d": None, "z/e": None, None: None}


def test_frames(spark):
    assert [value(spark, resolve.padded_frame(F.lit(n))) for n in ("7.jpg", "1234567.png", "x1.jpg", "5")] == ["000007.jpg", "1234567.png", "x1.jpg", "000005"]
    frames = spark.createDataFrame([("s", "7.jpg"), ("s", "10.jpg"), ("t", "7.jpg"), ("t", "b.jpg"), ("t", "10.jpg")], "sequence_name string, file string")
    noted = spark.createDataFrame([("s", "000007", 1)], "sequence_name string, frame_key string, n int")
    assert sorted((r["file"], r["n"]) for r in resolve.frames_with_annotations(frames.where("sequence_name = 's'"), noted).collect()) == [("10.jpg", None), ("7.jpg", 1)]
    ordered = resolve.in_frame_order(frames, ["sequence_name"], "file").orderBy("sequence_name", "place_number", "place_text").collect()
    assert [r["file"] for r in ordered] == ["7.jpg", "10.jpg", "10.jpg", "7.jpg", "b.jpg"]
    clip = spark.range(23).select(F.lit("s").alias("sequence_name"), F.col("id").alias("idx"))
    assert [r["idx"] for r in tracks.sampled_frames(clip, 5).orderBy("idx").collect()] == [0, 4, 8, 12, 16] and tracks.sampled_frames(clip, 50).count() == 23


def test_aliases_plans_and_completion(spark):
    aliases = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["q"]), ("c", [])], "name string, aliases array<string>")
    there = spark.createDataFrame([("z",), ("y",), ("y",)], "alias string")
    assert {r["name"]: r["found"] for r in resolve.first_existing(aliases, there).collect()} == {"a": "y", "b": None, "c": None}
    plan = spark.createDataFrame([("s1", "t1", 5), ("s2", "t2", 5), ("s3", "t3", 5)], "source string, target string, length long")
    present = spark.createDataFrame([("t1", 5), ("t2", 6)], "path string, length long")
    assert {r["target"]: r["action"] for r in resolve.plan_actions(plan, present).collect()} == {"t1": "skipped", "t2": "replaced", "t3": "created"}
    expected = spark.createDataFrame([("v", 2), ("w", 1), ("u", 0)], "key string, n int")
    assert {r["key"]: r["done"] for r in resolve.completed(expected, spark.createDataFrame([("v",)], "key string"), "key").collect()} == {"v": False, "w": False, "u": True}


def test_references_repeat_and_pad(spark):
    rows = [(1, ["a", "b", "c", "d", "e"], ["r1", ""], ["s1", "s2"]), (2, ["a"], None, None), (3, ["a", "b"], ["x", "y", "z"], []), (4, [], ["x"], None)]
    groups = spark.createDataFrame(rows, "k int, completions array<string>, reasoning array<string>, solutions array<string>")
    got = {}
    for r in resolve.reward_references(groups, "k").orderBy("k", "position").collect():
        got.setdefault(r["k"], []).append(r["reference"])
    assert got == {1: ["r1", "r1", "s2", "s2", ""], 2: [""], 3: ["x", "y"]}
    zipped = spark.createDataFrame([(1, ["Answer: x", "y", "z"], ["x", "n"]), (2, None, ["x"])], "k int, completions array<string>, solutions array<string>")
    assert [(r["position"], r["reward"]) for r in resolve.zipped_rewards(zipped, "k").orderBy("position").collect()] == [(0, 1.0), (1, 0.0)]


def test_small_functions(spark):
    assert tuple(value(spark, names.instance_video(F.lit("/a/b_c_12.MP4")))) == ("b_c", 12) and value(spark, names.instance_video(F.lit("b.mp4"))) is None
    assert tuple(value(spark, names.crop_file(F.lit("v.1_3_40.webp"), F.lit("v.1")))) == (3, 40) and value(spark, names.crop_file(F.lit("vx1_3_40.webp"), F.lit("v.1"))) is None
    assert value(spark, names.replaced(F.lit("abc"), [("a", "b"), ("bb", "x")])) == "xc" and value(spark, names.class_label(F.lit("moss_tench"))) == "Moss Tench" and value(spark, names.class_label(F.lit(None), "none")) == "none"
    assert value(spark, names.distinct_items(F.array(F.lit(" a"), F.lit("b "), F.lit("a"), F.lit(" "), F.lit(None)))) == ["a", "b"]
    assert tuple(value(spark, names.bin_bounds(F.lit("0.2-0.3")))) == (0.2, 0.3) and value(spark, names.bin_bounds(F.lit("x"))) is None
    assert [value(spark, c) for c in geometry.free_crop_side(F.lit(30.9), F.lit(500.2), 25)] == [100, 550]
    item = F.struct(F.lit("fin").alias("name"), F.lit("dark").alias("reason"))
    assert value(spark, answers.evidence_line(item)) == "fin: dark" and value(spark, answers.evidence_line(F.struct(F.lit("fin").alias("name"), F.lit(None).cast("string").alias("reason")))) == "fin"


def test_update_run(spark):
    boxes = spark.createDataFrame([("v", 1, 1, 7, "a"), ("v", 2, 2, 7, "moss_tench"), ("w", 1, 3, 7, "a")], "sequence_name string, frame_id long, ord long, instance_id long, class_name string")
    known = answers.ClassNames(["moss_tench", "veil_minnow"])
    results = [(1, "/x/v_7.mp4", "q", "veil minnow"), (2, "/x/v_7.mp4", "q", "<answer>Moss-tench</answer>"), (3, "/x/zz_1.mp4", "q", "moss tench"), (4, "/x/v.mp4", "q", "moss tench"), (5, "/x/v_8.mp4", "q", None)]
    table = spark.createDataFrame(results, "result_id long, video_path string, question string, model_raw_output string")
    assert tuple(tracks.load_statistics(tracks.result_updates(table, known)).first()) == (5, 3, 2, 1)
    updated, stats = tracks.run_update(boxes, table, known)
    assert {r["ord"]: (r["class_name"], r["updated"]) for r in updated.collect()} == {1: ("moss_tench", True), 2: ("moss_tench", False), 3: ("a", False)} and tuple(stats.first()) == (1, 1, 1, 1)
    with pytest.raises(tracks.NothingParsed):
        tracks.run_update(boxes, table.where("result_id > 3"), known)


def test_asked_and_recorded_answers(spark):
    from trackscope.functions import plugins

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, prompt string").coalesce(1)
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [p.upper() for p in prompts]

    def broken(prompts):
        raise OSError

    assert {r["id"]: r["said"] for r in plugins.asked(rows, "prompt", "said", flaky).collect()} == {1: "A", 2: None, 3: "B"}
    assert {r["said"] for r in plugins.asked(rows, "prompt", "said", broken).collect()} == {None} and plugins.asked(rows.limit(0), "prompt", "said", broken).count() == 0
    table = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "prompt string, answer string")
    assert {r["id"]: r["said"] for r in plugins.recorded(rows, "prompt", "said", table).collect()} == {1: "y", 2: None, 3: None}
