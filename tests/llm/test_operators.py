"""The operators of the llm problems on small cases: definitions, nulls, ties, empty tables, clashing columns."""

import random
import re
from collections import defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackscope.llm import cutoffs, groups, leaks, levels, mixing, overlap, pairs, plaintext
from trackscope.llm import queries as llm

from ..parity import connect, same
from .refusals import PLAIN, REFUSALS

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        same(df, connect(folder), SQL[name])
    else:
        rows = df.collect()
        assert rows and (not name.endswith("_found") or len(set(rows)) == len(rows))


# ---- 1 ------------------------------------------------------------------------------------------------------------

SAMPLES = "sample_id long, videos array<string>, source string, words string, gram int"


def samples(spark, *rows):
    return spark.createDataFrame([(i, v, s, "clash", 0) for i, v, s in rows], SAMPLES)


def test_clips_under_other_spellings(spark):
    a = "/data/videos/osier_cut/b00001/moss_tench/"
    val = samples(spark, (1, [a + "GX01.mp4", None, "", a + "GX01.mp4"], "s"), (2, None, None), (3, [a + "GX01_s01.mp4"], "s"), (9, ["GX01.mp4"], "s"))
    sft = samples(spark, (4, ["D:\\c\\Osier-Cut\\B00001\\Moss%20Tench\\gx01_1080p (1).MOV?x=1"], None), (5, ["/d/osier_cut/b00002/moss_tench/GX01.mp4"], "s"))
    rl = samples(spark, (0, [a + "GX01 - Copy.avi", a + "GX01_S01.mp4"], "t"), (10, ["GX01.mp4"], "s"))
    assert {tuple(r) for r in overlap.found(val, sft, rl).collect()} == {(1, 4), (0, 1), (0, 3)}
    report = {(r["split"], r["source"]): r["pairs"] for r in overlap.overlap_report(val, sft, rl).collect()}
    assert report == {("sft_train", None): 1, ("rl_train", "t"): 2}
    assert overlap.found(val.limit(0), sft, rl).count() == 0 and overlap.found(val, sft.limit(0), rl.limit(0)).count() == 0


def test_overlap_of_words_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    left, right = [(i, text()) for i in range(30)], [(100 + i, text()) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>")
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    want = {(i, j): len(grams(a) & grams(b)) / len(grams(a)) for i, a in left for j, b in right if grams(a) & grams(b)}
    got = {(r["eval_record"], r["train_record"]): r["containment"] for r in overlap.cross_split_overlap(frame(left), frame(right), "id", 3).collect()}
    assert got == want
    classes = {r["gram"]: (r["eval_records"], r["train_records"]) for r in overlap.shared_grams(frame(left), frame(right), "id", 3).collect()}
    count = lambda rows, g: sum(g in grams(w) for _, w in rows)
    assert classes == {overlap.SEPARATOR.join(g): (count(left, g), count(right, g)) for _, w in left for g in grams(w) if count(right, g)}


# ---- 2 ------------------------------------------------------------------------------------------------------------

PROMPT = "Which fish does this clip show?\nOptions:\n(A) Moss tench\n(B) Veil minnow"
GOOD = "<think>The tail is dark in most of the frames and it is not in doubt.</think><rethink>I cannot see the whiskers, yet the outline is clear enough to go on.</rethink><answer>(A) Moss tench</answer>"


@pytest.mark.parametrize("response,defect", [
    (GOOD, None), ("(A) Moss tench", None), ("Moss tench", None), (GOOD.upper(), None),
    (None, "empty"), (" \t\u00a0", "empty"), ("\u200b", "empty"), ("N/A", "empty"), ("...", "empty"), ("<think></think><rethink> </rethink><answer></answer>", "empty"),
    (PROMPT, "copy"), (PROMPT.upper(), "copy"), ("You asked: Which fish does clip show?\nOptions:\n(A) Moss tench\n(B) Veil minnow", "copy"), ("Which fish does this clip show?", "copy"), (f"<think>{PROMPT}</think><answer>{PROMPT}</answer>", "copy"),
    (PROMPT + " The tail is dark in most frames, so it is the moss tench. Moss tench", None),
    (GOOD[:40], "truncated"), (GOOD[:-9], "truncated"), (GOOD[:-3], "truncated"), ("The tail is dark. The fin is lit from behind and (", "truncated"),
    ("I'm sorry, but I can't help with identifying this.", "refusal"), ("<think>This goes against the rules I follow.</think><answer></answer>", "refusal"), ("Es tut mir leid, dabei kann ich nicht helfen.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"),
    ("I cannot see every fin and I am not able to judge the colour. It is the moss tench.", None),
    ("<think>Das Wasser war trüb und der Fisch ist nicht gut zu sehen.</think><answer>Moss tench</answer>", "other_language"),
])
def test_one_pair(response, defect):
    assert pairs.Judge()(PROMPT, [response], True)[0] == defect


def test_refusals_and_plain_sentences():
    missed, flagged = [t for t in REFUSALS if not pairs.declines(t)], [t for t in PLAIN if pairs.declines(t)]
    assert len(missed) <= 0.02 * len(REFUSALS) and len(flagged) <= 0.05 * len(PLAIN), (missed, flagged)


@pytest.mark.parametrize("words", [1, 100, 400, 4000])
def test_refusals_at_any_length_of_a_sentence(words):
    between = " ".join(["very"] * words)
    assert pairs.declines(f"I'm sorry, but {between} I can't help with naming this fish") and not pairs.declines(f"We see {between} and the tail of the fish")


def test_common_words_equal_the_table_at_all_sizes():
    rng = random.Random(1)
    for n, m in ((0, 3), (3, 0), (1, 1), (40, 60), (300, 200)):
        a, b = [rng.choice("abcdefg") for _ in range(n)], [rng.choice("abcdefg") for _ in range(m)]
        row = [0] * (m + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert pairs.common_words(a, b) == row[-1]
    long = [str(rng.randint(0, 900)) for _ in range(5000)]
    assert pairs.common_words(long, long) == 5000 and pairs.common_words(long, long[1::2]) == 2500


@pytest.mark.parametrize("text,found", [
    ("Рыба держится у самого дна и почти не двигается, поэтому видна хорошо.", "cyrillic"), ("この魚は川の底で静かに泳いでいます。", "ja"), ("이 물고기는 강바닥 근처에서 천천히 헤엄칩니다.", "ko"), ("这条鱼在石头旁边慢慢游动，偶尔停下来觅食。", "zh"), ("السمكة تسبح ببطء قرب القاع طوال اليوم", "arabic"),
    ("Fisken är nära botten och syns inte så bra eftersom vattnet är grumligt.", "sv"), ("Ryba nie jest widoczna, ponieważ woda przez cały dzień jest mętna.", "pl"), ("Moss tench", None),
])
def test_languages(text, found):
    assert pairs.language(text) == found


def test_pairs_with_nulls_errors_and_unmarked_ends(spark):
    ends = ["<think>It is here. We go on the bank.</think><answer>Moss tench</answer>"] * 6
    rows = [(i, None, PROMPT, t, None) for i, t in enumerate(ends)] + [
        (10, None, PROMPT, "It is clear. The fish swims on the", None), (11, None, PROMPT, "It is clear. Moss tench", None), (12, "timeout", PROMPT, None, None), (13, "", None, None, "Moss tench"), (14, None, None, None, None), (15, None, PROMPT, "It is clear. " * 30000 + "The fish swims on the", None),
    ]
    res = spark.createDataFrame(rows, "result_id long, error string, question string, model_raw_output string, prediction string").withColumn("word", F.lit(1))
    got = {r["record_id"]: r["defect"] for r in pairs.broken_pairs(pairs.res_pairs(res)).collect()}
    assert got == {10: "truncated", 14: "empty", 15: "truncated"}
    assert pairs.broken_pairs(pairs.res_pairs(res.limit(0))).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(150)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_tasks(spark):
    t = lambda i, s: (i, s, "clash")
    tasks = spark.createDataFrame([t(5, "/a/v_1_2_3.webp"), t(2, "\\x\\V-1_9_9.PNG"), t(7, "w_2_1_1.jpg"), t(9, "w_2_1_1.jpg"), t(1, None), t(3, " "), t(4, "alone_1_1.jpg"), t(8, "zz.jpg")], "task_id long, source string, video string")
    objects = spark.createDataFrame([("t/v_1", "PT-0000007", 1), ("mid", "pt7", 1), ("mid", "PT 8", None), ("w_2", " pt_008 ", 1), ("alone", "PT-0000000", 1), ("v_1", "PT-0000000", 1), ("alone", "?", 1), (None, "PT-7", 1), ("alone", None, 1)], "sequence_name string, fish_tag string, instance_id long")
    assert {tuple(r) for r in groups.found(tasks, objects).collect()} == {(2, 5), (2, 7), (2, 9)}
    assert {tuple(r) for r in groups.found(tasks, objects.limit(0)).collect()} == {(2, 5), (7, 9)}
    assert groups.found(tasks.limit(0), objects).count() == 0
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, proportion double")
    split = groups.assign_splits(tasks, objects, targets).collect()
    assert {r["task_id"]: r["group_task_id"] for r in split} == {5: 2, 2: 2, 7: 2, 9: 2, 4: 4, 1: 1, 3: 3, 8: 8} and len({(r["group_task_id"], r["split_name"]) for r in split}) == 5
    many = spark.range(20000).select(groups.split_of(F.col("id"), [("train", 0.8), ("test", 0.2)]).alias("s")).groupBy("s").count().collect()
    assert abs({r["s"]: r["count"] for r in many}["test"] - 4000) < 300


# ---- 5 ------------------------------------------------------------------------------------------------------------


def results(spark, rows):
    return spark.createDataFrame(rows, "result_id long, image_path string, experiment string, source string, true_class string, similarity double, l2_distance double, evaluated_at timestamp").withColumn("measure", F.lit("clash"))


def test_cutoffs_with_ties_dirt_and_extremes(spark):
    rng = random.Random(2)
    inf, nan = float("inf"), float("nan")
    values = [rng.choice([0.5, 0.9, 0.25, -1.0, 1.0, rng.random(), 1e-300, nan, inf, -2.0, 1.5]) for _ in range(400)]
    far = [rng.choice([0.0, 1e-12, 3.0, 1e300, 1e17, 1e17 + 16, rng.random(), nan, inf, -1.0]) for _ in range(400)]
    rows = [(i, f"p{i % 350}", "e", rng.choice(["A b", "a-B", "c", None, "zz"]), "x", s, d, None) for i, (s, d) in enumerate(zip(values, far))]
    targets = spark.createDataFrame([("a_b", 0.375), ("C", 0.0), ("none", 0.5), (None, 0.5)], "source string, target_fraction double")
    df = results(spark, rows)
    got = {tuple(r) for r in cutoffs.found(df, targets).collect()}
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r, key=lambda x: x[0])
    want = set()
    for name, f in (("a_b", 0.375), ("c", 0.0)):
        mine = [r for r in last.values() if (r[3] or "").lower().replace(" ", "_").replace("-", "_") == name]
        for measure, usable in (("similarity", [(-r[5], r[0]) for r in mine if -1 <= r[5] <= 1]), ("l2_distance", [(r[6], r[0]) for r in mine if 0 <= r[6] < inf])):
            if usable:
                cut = sorted(v for v, _ in usable)[max(int(np.ceil(f * len(usable))), 1) - 1]
                want |= {(measure, i) for v, i in usable if v <= cut}
    assert got == want
    assert cutoffs.found(df.limit(0), targets).count() == 0 and cutoffs.found(df, targets.limit(0)).count() == 0


def test_tree_of_batches_is_the_tree_of_all(spark, tmp_path):
    scores = spark.range(500).select(F.lit("similarity").alias("measure"), F.lit("s").alias("source"), (F.col("id") % 97 / 97).alias("score"), F.col("id"))
    parts = [scores.where("id < 200"), scores.where("id >= 200")]
    both = cutoffs.add_batch(*map(cutoffs.tree_nodes, parts))
    for part in parts:
        cutoffs.store_batch(part, str(tmp_path / "tree"))
    stored = cutoffs.stored_tree(spark, str(tmp_path / "tree"))
    assert sorted(both.collect()) == sorted(cutoffs.tree_nodes(scores).select(*both.columns).collect()) == sorted(stored.select(*both.columns).collect())
    targets = spark.createDataFrame([("s", 0.25)], "source string, target_fraction double")
    assert cutoffs.cutoffs(scores, targets, stored).collect() == cutoffs.cutoffs(scores, targets).collect()


# ---- 6 ------------------------------------------------------------------------------------------------------------

ITEM = "At mark 448 it hovered tail-first, yawned and sank, and lastly lunged at bubbles under a bent survey pole near two tiles."


def leaked(text, item=ITEM):
    return [(k, n) for _, k, n, _ in leaks.ItemIndex([("i", item)]).search([text], leaks.WordCodes())]


@pytest.mark.parametrize("text,found", [
    (ITEM, True), ("Before. " + ITEM.upper() + " After.", True), (ITEM.replace(" ", "\u00a0\n> "), True), ("<b>At</b> mark <i>448</i> " + ITEM[12:].replace("sank", "**sank**"), True), (ITEM.replace("o", "\u043e").replace("e", "é"), True),
    (ITEM.replace("448", "４４８"), True), (ITEM.replace("sank,", f'sank <img src="data:{"A" * 5000}"> ,'), True), (ITEM.replace("sank,", f"sank [a](https://x.org/{'b' * 900}),"), True), (ITEM.replace("sank,", "sank <!-- " + "z " * 400 + "-->,"), True), (ITEM.replace("lastly", "then"), True), (ITEM.replace("lastly ", ""), True), (ITEM.replace("lastly", "lastly so"), True), (" ".join(ITEM.split()[:15]), True), (" ".join(ITEM.split()[3:18]), True),
    (" ".join(ITEM.split()[:14]), False), (" ".join(ITEM.split()[:10]) + " other words here now " + " ".join(ITEM.split()[10:]), False), (ITEM.replace("yawned", "x").replace("and lastly", "y lastly").replace("lunged", "z").replace("survey", "w"), False), (" ".join(reversed(ITEM.split())), False), ("", False), (None, False),
])
def test_one_passage(text, found):
    assert bool(leaked(text)) is found


def plain_stretch(item, text):
    """Brute force over all starts and changes."""
    best = 0

    def run(i, j):
        n = 0
        while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
            n += 1
        return n

    def go(i, j, first, total):
        nonlocal best
        n = run(i, j)
        best = max(best, total + n)
        for m in range(n, 0, -1) if first else ([n] if n >= leaks.BETWEEN else []):
            if m == n:
                for di, dj in ((1, 1), (0, 1), (1, 0)):
                    go(i + m + di, j + m + dj, False, total + m)

    for i, j in product(range(len(item)), range(len(text))):
        if item[i] == text[j]:
            go(i, j, True, 0)
    return best


def test_stretches_equal_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        item = [rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(30)]
        text = item[rng.randint(0, 8) : rng.randint(16, 30)]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(text) - 1)
            text = rng.choice([text[:at] + ["x"] + text[at + 1 :], text[:at] + text[at + 1 :], text[:at] + ["x"] + text[at:]])
        want = plain_stretch(item, text)
        got = max([n for _, n in leaked(" ".join(text), " ".join(item))], default=0)
        assert got == (want if want >= leaks.STRETCH else 0)


def test_multi_index_misses_nothing_within_its_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, 3, replace=False)]) for _ in range(300)], np.uint64)
    for radius in (0, 1, 3):
        pieces = leaks.HammingIndex(prints, radius).near(prints ^ (flips if radius == 3 else np.uint64(0)))
        assert {(i, i) for i in range(300)} <= {pair for at, hit in pieces for pair in zip(at.tolist(), hit.tolist())}


def test_windows_with_a_changed_word_reach_the_verifier():
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(4000)]
    codes = leaks.WordCodes()
    prints = leaks.simhash_windows(codes.hashed(words), leaks.WINDOW)
    changed = words[:]
    for at in range(3, 4000, leaks.WINDOW):
        changed[at] = "x" + str(at)
    at, hit = (np.concatenate(x) for x in zip(*leaks.HammingIndex(prints, leaks.RADIUS).near(leaks.simhash_windows(codes.hashed(changed), leaks.WINDOW))))
    alike = [(i, j) for i, j in zip(hit.tolist(), at.tolist()) if i == j and words[i : i + leaks.WINDOW] != changed[j : j + leaks.WINDOW]]
    assert alike
    i, j = alike[0]
    assert leaks.longest_stretch(words, changed, [(i, j)]) >= 1 and leaks.weighted_similarity(leaks.shingle_weights(words[:50]), words[:50], changed[:50], [(0, 0)]) < 1


def test_weighted_similarity_is_exact():
    item = "aa b ccc d e ff g".split()
    weights = leaks.shingle_weights(item)
    assert weights == {("aa", "b", "ccc", "d", "e"): 8, ("b", "ccc", "d", "e", "ff"): 8, ("ccc", "d", "e", "ff", "g"): 8}
    assert leaks.weighted_similarity(weights, item, ["x"] * 9 + item[1:] + ["y"], [(1, 9)]) == 2 / 3
    assert leaks.weighted_similarity(weights, item, ["x"] * 40, [(0, 0)]) == 0 and leaks.verified(weights, item, item, [(0, 0)]) is None


def test_leaks_on_tables(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (1, ITEM), (4, "word " * 200000 + ITEM)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, ITEM)], "item_id int, text string").withColumn("doc_id", F.lit("clash"))
    want = [(1, 7), (1, 7), (1, 10), (1, 10), (4, 7), (4, 10)]
    for words in (leaks.INDEX_WORDS, 5):
        assert sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items, index_words=words).collect()) == want
    assert leaks.found(docs, items.limit(0)).count() == 0 and leaks.found(docs.limit(0), items).count() == 0


def test_words_of_dirty_text():
    assert plaintext.words("Caf\u00c3\u00a9 &amp; <p class='x'>smoke-grey</p>\u200b \u0430b\u00adc 0.5 — “Ｑ”") == ["cafe", "smokegrey", "abc", "05", "q"]
    assert plaintext.words(None) == [] == plaintext.words("<br/> -- ** ")


# ---- 7 ------------------------------------------------------------------------------------------------------------


def test_budgets_fill_what_caps_leave():
    given = mixing.budgets({"a": 100, "b": 1000, "c": 1000}, {"a": (0.5, 2), "b": (0.25, 1), "c": (0.25, 3), "d": (0.5, 9)}, 2100)
    assert given == {"a": 200.0, "b": 950.0, "c": 950.0, "d": 0.0}
    assert mixing.budgets({"a": 10}, {"a": (1.0, 1)}, 100) == {"a": 10.0} and mixing.budgets({}, {}, 5) == {}


def test_mixture_keeps_budgets_and_caps(spark):
    sized = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "big").when(F.col("id") < 2100, "small").otherwise("rest").alias("source"), (F.col("id") % 7).alias("tokens"), F.lit(0.5).alias("quality")).withColumn("key", F.lit("clash"))
    targets = {"big": (0.3, 1), "small": (0.2, 3), "absent": (0.1, 1)}
    rows = mixing.mix(sized, targets).collect()
    sums, total = defaultdict(int), sized.agg(F.sum("tokens")).first()[0]
    for r in rows:
        sums[r["source"]] += r["tokens"] * r["repeats"]
    size = lambda s: sized.where(F.col("source") == s).agg(F.sum("tokens")).first()[0]
    want = mixing.budgets({s: size(s) for s in ("big", "small")}, targets, total)
    assert all(abs(sums[s] - want[s]) <= 4 for s in ("big", "small")) and max(r["repeats"] for r in rows) <= 3 and all(r["tokens"] > 0 for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert sorted(rows) == sorted(mixing.mix(sized.repartition(5), targets).collect())
    assert mixing.mix(sized, {}).count() == 0 and mixing.mix(sized.limit(0), targets).count() == 0


def test_weights_raise_the_chance(spark):
    sized = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("tokens"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("quality"))
    sized = sized.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("t").alias("source"), F.lit(1).cast("long").alias("tokens"), F.lit(1.0).alias("quality")))
    used = mixing.mix(sized, {"s": (0.2, 1), "t": (0.8, 50000)}).where("source = 's'").select("doc_id").collect()
    even = sum(r["doc_id"] % 2 == 0 for r in used)
    assert 3900 < len(used) < 4100 and even > 3 * (len(used) - even)


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "S a", "two words"), (2, None, None), (3, "b", ""), (4, "b", "<|endoftext|>")], "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.token_sizes(docs).collect()}
    assert got[1] == ("s_a", 2) and got[2] == (None, 0) and got[3] == ("b", 0) and got[4][1] > 1


# ---- 8 ------------------------------------------------------------------------------------------------------------


def test_ranker_on_held_out_texts(spark, folder):
    rows = spark.read.parquet(f"{folder}/level_samples.parquet").orderBy("sample_id").collect()
    grade = lambda r: (levels.BANDS.index(r["band_a"]) + levels.BANDS.index(r["band_b"])) / 2
    model = levels.fit([r["text"] for r in rows if r["sample_id"] % 3], [grade(r) for r in rows if r["sample_id"] % 3])
    held = [r for r in rows if not r["sample_id"] % 3 and r["band_a"] == r["band_b"]]
    right = sum(model.band(model.score(levels.clean(r["text"]))) == r["band_a"] for r in held)
    assert right >= 0.9 * len(held) > 40


def test_isotonic_is_the_nearest_monotone_fit():
    rng = np.random.default_rng(0)
    scores, grades = rng.random(60), rng.integers(0, 3, 60).astype(float)
    knots, values = levels.isotonic(scores, grades)
    assert (np.diff(values) >= 0).all() and abs(np.interp(scores, knots, values).mean() - grades.mean()) < 1e-9


def test_only_english_prose_has_a_level(spark, folder):
    prose = "The fish is near the bank and it stays there for most of the day because the water is warm. " * 4
    texts = {1: prose, 2: None, 3: "", 4: prose[:60], 5: "frame 000001; id 3; moss_tench; 0.5\n" * 20, 6: "Der Fisch ist nicht weit von dem Ufer und wir haben ihn heute mit der Kamera gesehen. " * 5, 7: "这条鱼在石头旁边慢慢游动，偶尔停下来觅食。" * 20, 8: f"<p>{prose}</p>", 9: prose}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("band", F.lit("clash"))
    samples = spark.read.parquet(f"{folder}/level_samples.parquet")
    got = {r["doc_id"]: r["band"] for r in levels.found(docs, samples).collect()}
    assert set(got) == {1, 8, 9} and got[1] == got[8] == got[9]
    assert levels.found(docs.limit(0), samples).count() == 0
    assert {r["band"] for r in levels.found(docs, samples.limit(0)).collect()} == {"easy"}


def test_sql_runs_on_duckdb(folder):
    con = connect(folder)
    assert all(len(con.sql(sql).fetchall()) for sql in SQL.values()) and duckdb.__version__ and re.match(r"\w+", "x")
