"""Inference results, chat samples and validated attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from . import nested


def format_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, rows with each tag in the output, with all three, and with an error."""
    tags = {t: F.coalesce(answers.has_tag(F.col("model_raw_output"), t), F.lit(False)) for t in ("think", "rethink", "answer")}
    every = tags["think"] & tags["rethink"] & tags["answer"]
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(f"has_{t}") for t, c in tags.items()), F.count_if(every).alias("format_ok"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors")
    )


def ground_truth(results: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``results`` with ``truth``: the truth of the video path's last benchmark row that has one, else the item's own truth, else its answer.

    ``benchmark``: video_path, ground_truth, answer, ord; a row's truth is its ground_truth, where that is null its
    answer. An empty text found in the benchmark stands; an empty one of the item does not.
    """
    own = F.coalesce("ground_truth", "answer")
    last = benchmark.where(own.isNotNull()).groupBy("video_path").agg(F.max_by(own, "ord").alias("_found"))
    item = F.col("source_item")
    filled = lambda key: F.nullif(F.try_element_at(item, F.lit(key)), F.lit(""))
    return results.join(last, "video_path", "left").withColumn("truth", F.coalesce("_found", filled("ground_truth"), filled("answer"))).drop("_found")


def scored(results: DataFrame) -> DataFrame:
    """(result_id, species, right) of rows with a prediction and a truth; errors are not scored."""
    fine = results.where("prediction IS NOT NULL AND prediction NOT IN ('', 'ERROR') AND truth IS NOT NULL AND truth <> ''")
    return fine.select("result_id", F.lower("truth").alias("species"), answers.is_correct_option(F.col("prediction"), F.col("truth")).alias("right"))


def mc_accuracy(results: DataFrame) -> DataFrame:
    """(total, scored, correct, micro, macro): micro over all rows, macro over the species of scored rows."""
    per = scored(results).groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("ok"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"), F.coalesce(F.avg(F.col("ok") / F.col("n")), F.lit(0.0)).alias("macro"))
    total = results.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(sums).select("total", "scored", "correct", F.round(F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0)), 6).alias("micro"), F.round("macro", 6).alias("macro"))


def combined_reward(think: Column, rethink: Column, completion: Column, reference: Column, solution: Column) -> Column:
    """0.5 times the judge's mix plus the accuracy of the answer; the judge counts 0 where completion or reference has neither part."""
    tagged = lambda c: (answers.tag_text(F.coalesce(c, F.lit("")), "think") != "") | (answers.tag_text(F.coalesce(c, F.lit("")), "rethink") != "")
    judged = F.when(tagged(completion) & tagged(reference), answers.reward_mix(think, rethink)).otherwise(F.lit(0.0))
    return 0.5 * judged + answers.answer_reward(completion, solution)


def attribute_lists(records: DataFrame) -> DataFrame:
    """(record_id, list_name, extracted, validated): two rows for each record, ``appearance`` and ``behavior``.

    ``extracted``: names of the list's objects; ``validated``: (name, decision, reliability, total), the total null unless all
    three rubric scores are known. The lists stand in the four columns, or, where these are all null, in ``raw_json``.
    """
    sides = ("appearance", "behavior")
    rubrics = ("evidence text quality", "definition alignment", "cross attribute consistency")
    in_columns = F.greatest(*(F.col(outer).isNotNull() for _, outer, _ in nested.LISTS))
    text_only = ~in_columns & F.col("raw_json").isNotNull()
    place = {name: F.col(f"{outer}.{inner}") for name, outer, inner in nested.LISTS}
    objects = lambda name: F.filter(F.coalesce(place[name], F.array()), lambda a: a.isNotNull())
    judged = lambda a: F.struct(a["name"].alias("name"), a["decision"].alias("decision"), a["reliability"].alias("reliability"), sum((a["rubric scores"][r] for r in rubrics[1:]), a["rubric scores"][rubrics[0]]).alias("total"))
    columns = records.where(~text_only).select(
        "record_id", *(F.transform(objects("extracted_" + s), lambda a: a["name"]).alias("extracted_" + s) for s in sides), *(F.transform(objects("validated_" + s), judged).alias("validated_" + s) for s in sides)
    )

    nodes = nested.nested_nodes(records.where(text_only)).where("node_type IN ('record', 'attribute', 'rubric')")
    own = F.col("node_type") != "rubric"
    score = lambda r: F.max_by(F.when(~own & (F.col("name") == r), F.col("score")), F.when(~own & (F.col("name") == r), F.col("pre")))
    one = nodes.groupBy("record_id", F.when(own, F.col("pre")).otherwise(F.col("parent_pre")).alias("_node")).agg(
        F.max("list_name").alias("_list"), *(F.max(F.when(own, F.col(c))).alias(c) for c in ("name", "decision", "reliability")), sum((score(r) for r in rubrics[1:]), score(rubrics[0])).alias("total")
    )
    of = lambda name, value: F.collect_list(F.when(F.col("_list") == name, value))
    texts = one.groupBy("record_id").agg(
        *(F.transform(of("extracted_" + s, F.struct("name")), lambda a: a["name"]).alias("extracted_" + s) for s in sides),
        *(of("validated_" + s, F.struct("name", "decision", "reliability", "total")).alias("validated_" + s) for s in sides),
    )
    both = F.array(*(F.struct(F.lit(s).alias("list_name"), F.col("extracted_" + s).alias("extracted"), F.col("validated_" + s).alias("validated")) for s in sides))
    return columns.unionByName(texts).select("record_id", F.explode(both).alias("_l")).select("record_id", "_l.*")


def validation_integrity(records: DataFrame) -> DataFrame:
    """(record_id, list_name, extracted, validated, missing, wrong_reliability, keep, downgrade, drop, undecided) of ``attribute_lists``: whether each extracted attribute was judged, reliabilities are the rubric sum by six, and how often each decision was taken.

    ``missing``: distinct names extracted but not judged. Null lists are empty; null elements are left out. Decisions count
    whatever their case; ``undecided`` are null and unknown ones, so that the four sum to ``validated``.
    """
    known = ("keep", "downgrade", "drop")
    names = lambda c: F.array_distinct(F.filter(c, lambda n: n.isNotNull()))
    judged = F.transform("validated", lambda a: a["name"])
    wrong = lambda a: F.coalesce(F.abs(a["reliability"] - a["total"] / 6) > 0.001, F.lit(False))
    decision = lambda a: F.coalesce(F.lower(F.trim(a["decision"])), F.lit(""))
    taken = lambda d: F.size(F.filter("validated", lambda a: decision(a) == d))
    return attribute_lists(records).select(
        "record_id", "list_name", F.size("extracted").alias("extracted"), F.size("validated").alias("validated"), F.size(F.array_except(names(F.col("extracted")), names(judged))).alias("missing"),
        F.size(F.filter("validated", wrong)).alias("wrong_reliability"), *(taken(d).alias(d) for d in known), F.size(F.filter("validated", lambda a: ~decision(a).isin(*known))).alias("undecided"),
    )


def vocabulary_join(observed: DataFrame, vocabulary: DataFrame, prefix: str) -> DataFrame:
    """(record_id, label, name, definition): attributes that the vocabulary (key, pos, definition) knows, labelled ``prefix`` and number by its order."""
    return observed.join(vocabulary, F.col("name") == F.col("key")).select("record_id", F.concat(F.lit(prefix), (F.col("pos") + 1).cast("string")).alias("label"), "name", "definition")


def chat_sample(system: Column, prompt: Column, answer: Column) -> Column:
    """array of turns; the system's and the assistant's are left out where null."""
    turn = lambda role, c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.filter(F.array(turn("system", system), turn("user", prompt), turn("assistant", answer)), lambda t: t.isNotNull())


def chat_turns(messages: Column) -> Column:
    """array of turns (role, content): the system's first, then all others in their order; those without content are left out."""
    known = F.filter(F.coalesce(messages, F.array()), lambda m: m["content"].isNotNull())
    system = lambda m: F.coalesce(m["role"] == "system", F.lit(False))
    return F.transform(F.concat(F.filter(known, system), F.filter(known, lambda m: ~system(m))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def with_video_root(videos: Column, root: str, old: str) -> Column:
    """Paths under ``old`` moved under ``root``, other absolute ones kept, relative ones put under ``root``."""
    under = F.lit(root.rstrip("/") + "/")
    return F.transform(videos, lambda v: F.when(v.startswith(old), F.concat(under, F.ltrim(F.substr(v, F.lit(len(old) + 1)), F.lit("/")))).when(v.startswith("/"), v).otherwise(F.concat(under, v)))
