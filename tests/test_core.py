"""Names, skewed joins, sources, plug-ins, streams and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from trackscope.functions import answers, names, plugins
from trackscope.operators import metrics, tracks, vectors
from trackscope.skew import hot_keys, salted_join
from trackscope.sources import annotations, labels, listings, reports


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path,plain", [
    (" D:\\capture\\A b\\X.MP4 ", "/capture/a b/x.mp4"), ("s3://bucket/raw//a/./b/../c.mov?x=1#t", "/bucket/raw/a/c.mov"), ("a%20b/100%.mp4", "a b/100%.mp4"), ("", ""), (None, None),
    ("/a/b/c/d/e/f/../../../../../x//../y.mp4", "/a/y.mp4"), ("../../a/../b", "../../b"), ("/../a", "/../a"),
])
def test_plain_path(spark, path, plain):
    assert value(spark, names.plain_path(F.lit(path).cast("string"))) == plain


def test_copy_marks_go_and_pieces_stay(spark):
    stem = lambda n: value(spark, names.without_copy_marks(names.file_stem(F.lit(n), names.VIDEO_ENDINGS)))
    assert [stem(n) for n in ("GX01 (1).MP4", "GX01 - Copy.mov", "gx01_h265-export.mkv", "GX01_1080p.mp4", "GX01_s02_x264.mp4", "x.y.mp4")] == ["gx01", "gx01", "gx01", "gx01", "gx01_s02", "x.y"]


def test_class_spellings(spark):
    rows = [value(spark, tracks.class_name(F.lit(t))) for t in ("Common Carp.", " common-carp ", "a mud carp..")]
    assert rows == ["common_carp", "common_carp", "a_mud_carp"]


def test_salted_join_gives_the_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(400)] + [(400, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k2", 3), (None, 4)], "k string, v int")
    assert hot_keys(left, "k") == ["hot"] and hot_keys(left.limit(0), "k") == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        ours, plain = salted_join(left, right, "k", F.col("id"), how), left.join(right, "k", how)
        assert sorted(map(repr, ours.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_annotations_both_layouts_and_round_trip(spark, tmp_path):
    label = {"instance_id": 4, "class_name": "carp", "x1": 1, "y1": 2, "x2": 3, "y2": 4, "logit": None}
    frames = {"mask_000002": {"labels": {"4": label}}, "000001": {"labels": {}}, "x": {"labels": {"5": label | {"instance_id": None}}}}
    (tmp_path / "many").mkdir()
    (tmp_path / "many/a.json").write_text(json.dumps({"videos": {"g/s1": {"frames": frames}}, "sequence_count": 1}))
    (tmp_path / "many/b.json").write_text(json.dumps({"video_name": "s2", "frames": frames}))
    flat = annotations.read_annotations(spark, str(tmp_path / "many"))
    assert flat.count() == 4
    assert [(r["sequence_name"], r["frame_id"], r["score"]) for r in annotations.predictions(flat).orderBy("sequence_name").collect()] == [("s1", 2, 0.0), ("s2", 2, 0.0)]
    assert {r["score"] for r in annotations.ground_truth(flat).collect()} == {1.0}
    keys = flat.select("frame_key").distinct().orderBy(*annotations.frame_order(F.col("frame_key"))).collect()
    assert [r[0] for r in keys] == ["mask_000002", "x"]
    annotations.to_documents(flat.where("sequence_name = 's2'")).select("value").write.text(str(tmp_path / "out"))
    back = spark.read.schema(annotations.DOCUMENT).json(str(tmp_path / "out")).selectExpr("size(frames)").first()[0]
    assert back == 2
    annotations.upsert_sequences(flat, str(tmp_path / "store"))
    annotations.upsert_sequences(flat.where("sequence_name = 's2'").withColumn("class_name", F.lit("new")), str(tmp_path / "store"))
    assert {(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "store")).groupBy("sequence_name", "class_name").count().select("sequence_name", "class_name").collect()} == {("g/s1", "carp"), ("s2", "new")}


def test_frame_files(spark, tmp_path):
    folder = tmp_path / "legacy/seq"
    folder.mkdir(parents=True)
    (folder / "000001.json").write_text(json.dumps({"labels": {"1": {"instance_id": 1, "class_name": "carp", "x1": 0, "y1": 0, "x2": 1, "y2": 1, "logit": 0.5}}}))
    (folder / "000002.json").write_text(json.dumps({"labels": []}))
    (folder / "metadata.json").write_text(json.dumps({"labels": {"1": {}}}))
    (folder / "prediction.json").write_text(json.dumps({"labels": {"1": {}}}))
    assert sorted((r["sequence_name"], r["frame_key"]) for r in annotations.read_frame_files(spark, str(tmp_path / "legacy")).collect()) == [("seq", "000001"), ("seq", "metadata")]
    files = listings.list_files(spark, str(tmp_path))
    assert [r["files"] for r in annotations.frame_file_folders(files).collect()] == [3] and annotations.aggregated_files(files).first()["path"].endswith("seq/prediction.json")


def test_one_sequence_and_truth(spark, tmp_path):
    label = {"instance_id": 4, "class_name": "carp", "x1": 1, "y1": 2, "x2": 3, "y2": 4}
    frames = {"1": {"labels": {"4": label}}}
    for name in ("data", "single", "twice", "text", "none"):
        (tmp_path / name).mkdir()
    (tmp_path / "data/prediction.json").write_text(json.dumps({"videos": {"g/a": {"frames": frames}, "b": {"frames": frames}}}))
    (tmp_path / "data/annotations.json").write_text(json.dumps({"videos": {"old": {"frames": frames}}}))
    (tmp_path / "single/prediction.json").write_text(json.dumps({"frames": frames}))
    (tmp_path / "twice/prediction.json").write_text(json.dumps({"videos": {"g/a": {"frames": frames}, "h/a": {"frames": frames}}}))
    (tmp_path / "text/v.txt").write_text("1,7,3,10,20,5,6,0.9,-1,-1\n")
    (tmp_path / "text/prediction.json").write_text("{}")
    names = lambda df: sorted(r["sequence_name"] for r in df.collect())
    path = lambda name: str(tmp_path / name)
    assert names(annotations.read_annotations(spark, path("data"))) == ["b", "g/a"] and names(annotations.read_annotations(spark, path("single"))) == ["single"]
    assert names(annotations.read_sequence(spark, path("data"), "b")) == ["b"] and names(annotations.read_sequence(spark, path("data"))) == [] and names(annotations.read_sequence(spark, path("single"))) == ["single"]
    assert names(annotations.read_truth(spark, path("data"), {})) == ["a", "b"] and names(annotations.read_truth(spark, path("text"), {"3": "carp"})) == ["v"]
    for name in ("twice", "none"):
        with pytest.raises(annotations.TruthError):
            annotations.read_truth(spark, path(name), {})
    asked = spark.createDataFrame([("b",), ("zz",)], "sequence_name string")
    assert {tuple(r) for r in annotations.frame_counts(annotations.read_annotations(spark, path("data")), asked).collect()} == {("b", 1), ("zz", 0)}


def test_label_text(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "v.txt").write_text("1,7,3,10,20,5,6,0.9,-1,-1\n1,7,9,0,0,1,1,1,-1,-1\n2,7,3,1\n1,7,3,10.5,20.5,5,6,0.8,-1,-1\nx,7,3,1,1,1,1,1\n")
    strict = labels.read_raw_labels(spark, str(raw), {"3": "carp"}).collect()
    assert [(r["x2"], r["y2"], r["score"]) for r in strict] == [(15.0, 26.0, 0.9), (15.5, 26.5, 0.8)]
    assert [(r["x1"], r["y1"], r["x2"]) for r in labels.read_lenient_labels(spark, str(raw), {"3": "carp"}).collect()] == [(10, 20, 16)]
    assert labels.read_lenient_labels(spark, str(raw), {"4": "carp"}).count() == 0
    boxes = spark.createDataFrame([("a b", 3, 1, "carp", 1.0, 2.0, 3.0, 4.5, 0.25)], "sequence_name string, frame_id long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double, score double")
    assert labels.track_lines(boxes, True).first()["value"] == "3 1 Car -1 -1 -1 1.0 2.0 3.0 4.5 -1 -1 -1 -1 -1 -1 -1 0.25"
    assert labels.track_lines(boxes, False).first()["value"] == "3 1 Car -1 -1 -1 1.000000 2.000000 3.000000 4.500000 -1 -1 -1 -1000 -1000 -1000 -10 0.250000"
    for predicted in (True, False):
        labels.write_lines(labels.track_lines(boxes, predicted), str(tmp_path / f"lines{predicted}"))
        back = labels.read_tracks(spark, str(tmp_path / f"lines{predicted}"), predicted).first()
        assert (back["sequence_name"], back["frame_id"], back["class_name"], back["y2"], back["score"], back["occlusion"]) == ("a b", 3, "Fish", 4.5, 0.25, -1.0) and back["location"][0] == (-1.0 if predicted else -1000.0)
    (raw / "t.txt").write_text("1 2 Carp 0 1 -1 0 0 1 1 -1 -1 -1 -1 -1 -1 -10\n")
    assert [(r["class_name"], r["score"], r["occlusion"]) for r in labels.read_tracks(spark, str(raw / "t.txt"), False).collect()] == [("Fish", 1.0, 1.0)]
    with pytest.raises(Exception, match="unsupported class Carp"):
        labels.read_tracks(spark, str(raw / "t.txt"), True).collect()


def test_listings(spark, tmp_path):
    for p in ("in/g/a.MP4", "in/b.mpeg", "in/f/1.jpg", "in/f/deep/2.PNG", "in/h/k/1.png", "in/h/k/l/1.png", "in/w/1.webp", "cls/b/1.JPG", "cls/a.txt", "cls/c/2.webp", "cls/c/3.bmp", "cls/.x/1.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    files, root = listings.list_files(spark, str(tmp_path)), str(tmp_path)
    assert files.count() == 11  # hidden folders are not listed
    assert [(r["relative"], r["kind"]) for r in listings.discover_videos(files, root + "/in").collect()] == [("b.mpeg", "video"), ("f", "frames"), ("g/a.MP4", "video"), ("h/k", "frames")]
    inside = files.where(F.contains("path", F.lit("/cls/")))
    assert {(r["class_name"], r["class_idx"]) for r in listings.class_folders(inside, root + "/cls").collect()} == {("b", 1), ("c", 2)}
    assert listings.class_folders(inside, root + "/cls", any_case=False).count() == 1 and listings.class_folders(inside, root + "/cls", endings=listings.EXPERIMENT_PICTURES).count() == 3
    assert listings.watchlist(inside, root + "/cls") == ["b", "c"]
    with pytest.raises(FileNotFoundError):
        listings.watchlist(inside, root + "/none")
    pairs = {(r["name"], r["left_path"] is None, r["right_path"] is None) for r in listings.paired_files(files.where(F.contains("path", F.lit("/in/h/k/1"))), files.where(F.contains("path", F.lit("/in/f/1"))), "1").collect()}
    assert pairs == {("1.png", False, True), ("1.jpg", True, False)}
    (tmp_path / "in/a.mov").write_bytes(b"1")
    asked = spark.createDataFrame([("a",), ("2",), ("none",)], "video_id string")
    assert {r["video_id"]: r["path"] and r["path"].split("/in/")[-1] for r in listings.locate_videos(asked, listings.list_files(spark, root + "/in"), root + "/in").collect()} == {"a": "a.mov", "2": "f/deep/2.PNG", "none": None}
    layout = value(spark, listings.video_layout(F.lit("/d/video/g/a.v1.mp4")))
    assert tuple(layout) == ("a.v1", "g/a.v1", "g") and tuple(value(spark, listings.video_layout(F.lit("/d/video/b.x")))) == ("b.x", "b.x", None)
    for name, doc in {"c1/a": {"video_id": "v", "fish_type": "t", "rethink_annotation": {"summary": "s"}}, "c1/b": {"error": "x", "rethink_annotation": {"summary": "s"}}, "c2/c": {"video_id": "w", "rethink_annotation": {}}, "c2/d/e": {"video_id": "u", "rethink_annotation": {"summary": "s"}}}.items():
        (tmp_path / f"res/{name}.json").parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"res/{name}.json").write_text(json.dumps(doc))
    assert [(r["fish_code"], r["video_id"], r["annotation"]) for r in listings.read_species_results(spark, root + "/res").collect()] == [("c1", "v", '{"summary":"s"}')]
    (tmp_path / "t.json").write_text(json.dumps({"default": {"similarity_threshold": 0.9, "l2_distance_threshold": 0.1}, "classes": {"a": {"similarity_threshold": 0.5}}}))
    assert {tuple(r) for r in listings.read_thresholds(spark, str(tmp_path / "t.json")).collect()} == {("a", 0.5, 0.1), ("default", 0.9, 0.1)}
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"benchmark_index": 0, "video_path": "v", "source_item": {"answer": "x"}}]}))
    assert listings.read_results(spark, str(tmp_path / "r.json")).first()["source_item"] == {"answer": "x"}
    (tmp_path / "b.json").write_text(json.dumps([{"video_path": "v", "question": "q"}, {"video_path": "w", "question": "q", "answer": "a"}]))
    assert [(r["benchmark_index"], r["answer"]) for r in listings.read_benchmark(spark, str(tmp_path / "b.json")).collect()] == [(0, None), (1, "a")]
    species = spark.createDataFrame([(0, "Carp", ["common"]), (1, "Other", ["CARP", "x"])], "pos int, name string, aliases array<string>")
    asked = spark.createDataFrame([("carp",), ("X",), ("none",), (None,)], "name string")
    assert {(r["name"], r["species"]) for r in listings.knowledge_lookup(asked, species).collect()} == {("carp", "Carp"), ("X", "Other"), ("none", None), (None, None)}


def test_accept_rules_at_equality_and_nan(spark):
    t = spark.createDataFrame([("default", 0.9, 0.2), ("a", 0.5, None)], "class_name string, similarity_threshold double, l2_distance_threshold double")
    r = spark.createDataFrame([(1, "A", 0.5, 0.2), (2, "b", 0.5, 0.1), (3, "b", 0.9, 0.2), (4, "b", float("nan"), 0.1), (5, None, 0.95, 0.1)], "result_id int, predicted_class string, similarity double, l2_distance double")
    known = {x["result_id"]: x["known_class"] for x in metrics.class_thresholds_join(r, t).collect()}
    assert known == {1: "A", 2: "unknown", 3: "b", 4: "unknown", 5: None}


def test_empty_ratios_are_null(spark):
    none = spark.createDataFrame([], "true_class string, predicted_class string, similarity double")
    row = metrics.screening_summary(none, ["a"]).first()
    assert row["tp"] == 0 and row["out_of_scope_rejection"] is None
    only_known = spark.createDataFrame([("a", "a", 1.0)], "true_class string, predicted_class string, similarity double")
    assert metrics.screening_summary(only_known, ["a"]).first()["out_of_scope_rejection"] is None


def test_best_class_breaks_ties(spark):
    m = spark.createDataFrame([(1, "t", "b", 0.5, 0.1), (1, "t", "a", 0.5, 0.1), (1, "t", "c", 0.4, 0.1)], "id int, true_class string, class_name string, max double, l2_min double")
    assert vectors.best_class(m, "id").first()["best"] == "a"
    one = spark.createDataFrame([("a", [1.0, 0.0])], "label string, v array<double>")
    assert vectors.center_distance_loss(one, "label", "v", 1.0).first()[0] == 0.0


def test_bare_truth_is_never_met(spark):
    right = lambda p, t: value(spark, answers.is_correct_option(F.lit(p), F.lit(t)))
    assert right("(A) carp", "carp") is False and right("(a) x", "(A) Carp") and right("carp", "(B) Carp")


def test_rewards_and_table_function(spark):
    plugins.register_rewards(spark)
    rows = spark.createDataFrame([("<answer>The answer is (A) Carp.</answer>", "(a) carp"), (None, None), ("x", "y")], "c string, s string")
    assert [r[0] for r in rows.selectExpr("answer_accuracy(c, s)").collect()] == [1.0, 0.0, 0.0]
    plugins.register_table_functions(spark)
    assert spark.sql("SELECT * FROM question_options('(A) x\n(b) y z')").collect()[1]["species"] == "y z"


def test_stream_counts_and_repeats(spark, folder, tmp_path):
    from trackscope.streaming import detections as stream

    objects = spark.read.parquet(f"{folder}/object_info.parquet").select("object_id", "sequence_name", "frame_id", "instance_id", "class_name", "x1", "y1", "x2", "y2", "captured_at")
    objects.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_detections(spark, str(tmp_path / "in"), objects)
    stream.write_once(stream.without_repeats(source, "400 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    distinct = objects.dropDuplicates(["sequence_name", "frame_id", "instance_id", "x1", "y1", "x2", "y2"]).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == distinct
    stream.write_once(stream.window_counts(source, "400 days"), str(tmp_path / "counts"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "counts")).columns == ["window_start", "class_name", "boxes", "videos"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("bb", None)], "k string, v double")
    assert reports.text_table(df) == "k   v\na   1.000\nbb  N/A" and reports.text_table(df, 1) == "k  v\na  1.000\nand 1 more rows"
    reports.write_csv(df, str(tmp_path / "c"), ["v", "k"])
    reports.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "k"] and spark.read.json(str(tmp_path / "j")).count() == 2


def test_answers_lose_only_the_three_prefixes(spark):
    from trackscope.functions import plugins

    cases = {"answers vary": "answers vary", "The answer: x": "the answer: x", "Answer: X.": "x", "the answer is x": "x", "answer is: x": ": x", "<answer> Answer is Y，</answer>": "y，", "": "", " . ": ""}
    rows = spark.createDataFrame(list(cases.items()), "text string, want string")
    got = rows.select("text", answers.answer_for_reward(F.col("text")).alias("a"), answers.answer_reward(F.col("text"), F.col("text")).alias("r")).collect()
    assert {r["text"]: r["a"] for r in got} == cases
    assert {r["text"]: r["r"] for r in got} == {t: float(bool(a)) for t, a in cases.items()}
    assert {t: plugins._plain(t) for t in cases} == cases
    assert rows.select(answers.answer_reward(F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0] == 0.0


def test_classes_by_alias_and_order(spark):
    names = answers.ClassNames(["carp", "mud_carp"], [("common_carp", "carp"), ("common carp", "carp"), ("carp", "carp"), ("mud_carp", "mud_carp"), ("mud carp", "mud_carp")])
    question = "Q\n(A) Common carp\n(D) Common-carp\n(B) mud carp\n(b) Carp\n(C) other"
    cases = [("<ANSWER>(b)</ANSWER>", "carp"), ("(A)", "carp"), ("(C) mud carp", "carp"), ("(D)", None), ("Mud Carp", "mud_carp"), ("common_carp", "carp"), ("a mud carp", "carp"), ("nothing", None), (None, None)]
    rows = spark.createDataFrame([(i, question, t) for i, (t, _) in enumerate(cases)], "i int, q string, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", answers.resolve_species(F.col("q"), F.col("t"), names).alias("c")).collect()}
    assert got == {i: c for i, (_, c) in enumerate(cases)}
    assert answers.option_lines(["a", "b"]) == "(A) a\n(B) b"
    assert [r[0] for r in rows.limit(1).select(answers.correct_label(F.lit("b"), ["a", "b"])).union(rows.limit(1).select(answers.correct_label(F.lit("z"), ["a"]))).collect()] == ["(B) b", "z"]


def test_json_in_answers(spark):
    texts = ["x ```json\n{\"a\": 1}\n``` {\"a\": 2}", "see {\"a\": {\"b\": 1}} end", "none", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(answers.json_in_text(F.col("t")))).collect()]
    assert got == ['{"a":1}', '{"a":{"b":1}}', None, None]
    judged = [tuple(r[0]) for r in spark.createDataFrame([('ok {"R_think": 0.5} {"R_think": 1}',), ("no",)], "t string").select(answers.judge_scores(F.col("t"))).collect()]
    assert judged == [(0.5, 0.0), (0.0, 0.0)]


def test_lines_of_a_sequence_go_to_one_file(spark, tmp_path):
    from trackscope.sources import labels

    lines = spark.range(4000).repartition(8).selectExpr("'s' || id % 5 AS sequence_name", "CAST(id AS STRING) AS value")
    labels.write_lines(lines, str(tmp_path / "lines"))
    assert len(list((tmp_path / "lines").rglob("*.txt"))) == 5
    assert spark.read.text(str(tmp_path / "lines")).count() == 4000
