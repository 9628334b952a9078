"""Queries over res, the training samples and stage2_cot: answers, accuracy, rewards, traces and chat samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import traces
from ..tables import table
from .nested import ATTRIBUTES_SQL

SPECIES = "amber_dace broad_snaker copper_bream dusk_catlet gilt_rudder glass_gudgeon moss_tench mud_lantern pale_chublin reed_perchlet river_tassel silver_ridgeling slate_barbel stone_sucklet thorn_loach veil_minnow".split()
#: Names of classes; the short name of one stands before the long names of others that hold it.
NAMES = answers.ClassNames(SPECIES, [(alias, c) for c in SPECIES for alias in (c, c.replace("_", " "))] + [("tench", "moss_tench"), ("lantern", "mud_lantern")])

#: The vocabularies: every attribute name of stage2_cot, in the order of their labels. Null names and names not listed get no label, as in the reference.
APPEARANCE = "body.deep_oval body.pencil_thin eye.ring_gold fin.anal_long fin.caudal_notched fin.dorsal_low_sail fin.pelvic_orange_rim gill.cover_blotch mouth.turned_down mouth.wide_slit scale.coarse_diamond scale.row_pearled spot.peduncle_dark stripe.back_broken stripe.flank_single tail.base_saddle whisker.none whisker.two_pairs".split()
BEHAVIOUR = "feed.surface_sip feed.tilts_down fin.flicks_pectoral group.alone group.loose_shoal rest.under_cover swim.burst_stop swim.slow_glide swim.circles_wall turn.sharp_left_right rest.on_gravel".split()


def res(spark, folder):
    return table(spark, folder, "res")


def _truth(spark, folder):
    r = res(spark, folder)
    bench = r.select("video_path", *(F.try_element_at("source_item", F.lit(k)).alias(k) for k in ("ground_truth", "answer")), F.col("result_id").alias("ord"))
    return traces.ground_truth(r, bench)


def _options(spark, folder):
    rows = res(spark, folder).select("result_id", F.posexplode(answers.options(F.col("question"), NAMES)).alias("pos", "o"))
    return rows.select("result_id", F.col("pos").cast("int").alias("pos"), "o.letter", "o.species")


def _resolve(spark, folder):
    return res(spark, folder).select("result_id", answers.resolve_species(F.col("question"), F.col("model_raw_output"), NAMES).alias("species"))


def _reward(spark, folder):
    rl = table(spark, folder, "rl_train").where("reasoning_content IS NOT NULL")
    half = (F.col("sample_id") % 5 / 4).cast("double")
    completion, solution = F.col("reasoning_content"), F.get("solution", F.lit(0))
    return rl.select("sample_id", F.round(traces.combined_reward(half, F.lit(1.5), completion, completion, solution), 6).alias("reward"))


def _trace(spark, folder):
    a = "rethink_annotation."
    rows = table(spark, folder, "stage2_cot").where("rethink_annotation IS NOT NULL")
    return rows.select("record_id", answers.trace(F.col(a + "evidence_selection"), F.col(a + "supporting_reasoning"), F.col(a + "exclusion_counterfactual"), F.col(a + "`uncertainty reasoning`"), F.col(a + "summary")).alias("trace"))


def _chat(spark, folder):
    rows = table(spark, folder, "sft_train")
    sample = traces.chat_turns(F.col("messages"))
    return rows.select("sample_id", F.size(sample).alias("turns"), F.transform(sample, lambda t: t["role"]).alias("roles"), F.transform(sample, lambda t: t["content"]).alias("contents"), F.size(traces.with_video_root(F.coalesce("videos", F.array().cast("array<string>")), "/mnt/clips", "/data/videos")).alias("videos"))


def _integrity(spark, folder):
    return traces.validation_integrity(table(spark, folder, "stage2_cot"))


def _vocabulary(spark, folder):
    lists = traces.attribute_lists(table(spark, folder, "stage2_cot"))
    seen = lists.select("record_id", "list_name", F.explode("extracted").alias("name"))

    def labelled(side, words, kind, prefix):
        vocabulary = spark.createDataFrame([(w, i, f"{kind}: {w}") for i, w in enumerate(words)], "key string, pos int, definition string")
        return traces.vocabulary_join(seen.where(F.col("list_name") == side), vocabulary, prefix)

    return labelled("appearance", APPEARANCE, "appearance", "A").unionByName(labelled("behavior", BEHAVIOUR, "behaviour", "B"))


def queries():
    answer = lambda f: lambda spark, folder: res(spark, folder).select("result_id", f(F.col("model_raw_output")).alias("answer"))
    return {
        "extract_answer_any_case": answer(answers.answer_any_case),
        "extract_answer_or_rest": answer(answers.answer_or_rest),
        "extract_answer_for_reward": answer(answers.answer_for_reward),
        "check_format": lambda spark, folder: res(spark, folder).select("result_id", *(F.coalesce(answers.has_tag(F.col("model_raw_output"), t), F.lit(False)).alias("has_" + t) for t in ("think", "rethink", "answer"))),
        "format_summary": lambda spark, folder: traces.format_summary(res(spark, folder), ["checkpoint"]),
        "parse_options": _options,
        "resolve_class": _resolve,
        "ground_truth_lookup": lambda spark, folder: _truth(spark, folder).select("result_id", "truth"),
        "mc_accuracy": lambda spark, folder: traces.mc_accuracy(_truth(spark, folder)),
        "mc_accuracy_species": lambda spark, folder: traces.scored(_truth(spark, folder)).groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("ok")),
        "answer_reward": lambda spark, folder: _truth(spark, folder).select("result_id", answers.answer_reward(F.col("model_raw_output"), F.col("truth")).alias("reward")),
        "combined_reward": _reward,
        "trace_build": _trace,
        "chat_samples": _chat,
        "validation_integrity": _integrity,
        "vocab_join": _vocabulary,
    }


_B = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _tag(c, tag):
    return f"trim(regexp_extract({c}, '<{tag}>(.*?)</{tag}>', 1, 's'), {_B})"


def _has(c, tag):
    return f"regexp_matches({c}, '<{tag}>.*?</{tag}>', 's')"


def _any(c):
    return f"CASE WHEN regexp_matches({c}, '<answer>.*?</answer>', 'si') THEN trim(regexp_extract({c}, '<answer>(.*?)</answer>', 1, 'si'), {_B}) ELSE trim({c}, {_B}) END"


def _for_reward(c):
    return f"trim(regexp_replace(lower(CASE WHEN {_has(c, 'answer')} THEN {_tag(c, 'answer')} ELSE trim({c}, {_B}) END), '^(answer is|answer:|the answer is)\\s*', ''), '.。 ,' || chr(10) || chr(9))"


def rewarded_sql(completion, solution):
    return f"coalesce(({_for_reward(completion)} <> '' AND {_for_reward(completion)} = {_for_reward(solution)})::INT::DOUBLE, 0)"


def _class_of(c):
    """The class that a text is, by the names of ``NAMES``."""
    low = f"lower(trim({c}, {_B}))"
    known = "MAP {" + ", ".join(f"'{a}': '{n}'" for a, n in NAMES.aliases) + "}"
    return f"coalesce(CASE WHEN list_contains({NAMES.canonical}, translate({low}, '- ', '__')) THEN translate({low}, '- ', '__') END, ({known})[{low}], ({known})[replace({low}, '_', ' ')])"


def _letter(c):
    return f"regexp_extract(lower(trim({c}, {_B})), '\\(([a-z])\\)\\s*(.*)', 1)"


def _species(c):
    return f"CASE WHEN regexp_matches(lower(trim({c}, {_B})), '\\([a-z]\\)') THEN trim(regexp_extract(lower(trim({c}, {_B})), '\\(([a-z])\\)\\s*(.*)', 2), {_B}) ELSE lower(trim({c}, {_B})) END"


def resolved_sql(empty: bool = False) -> str:
    """CTEs up to ``rs`` (result_id, species), the class that each output of res means; with ``empty`` a null output is an empty text."""
    pattern = r"'\(([A-Ja-j])\)\s*([^\n]+)'"
    answer = _any("coalesce(model_raw_output, '')" if empty else "model_raw_output")
    table = [{"alias": x, "name": n} for x, n in NAMES.aliases]
    return f"""op AS (SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY place)::INT - 1 AS pos, letter, species FROM (SELECT result_id, place, letter, {_class_of('species')} AS species FROM (SELECT result_id, unnest(range(len(regexp_extract_all(question, {pattern}, 1)))) AS place, upper(unnest(regexp_extract_all(question, {pattern}, 1))) AS letter, unnest(regexp_extract_all(question, {pattern}, 2)) AS species FROM res)) WHERE species IS NOT NULL),
an AS (SELECT result_id, {answer} AS answer FROM res), bl AS (SELECT an.result_id, arg_max(species, pos) AS by_letter FROM an JOIN op ON op.result_id = an.result_id AND op.letter = upper(regexp_extract(answer, '\\(([A-Ja-j])\\)', 1)) GROUP BY 1),
rs AS (SELECT result_id, coalesce(by_letter, {_class_of('answer')}, list_filter({table}, lambda x: contains(lower(answer), x.alias))[1].name) AS species FROM an LEFT JOIN bl USING (result_id))"""


def oracle_sql():
    o = "model_raw_output"
    truth = "bm AS (SELECT video_path, arg_max(gt, result_id) AS found FROM (SELECT *, coalesce(source_item['ground_truth'], source_item['answer']) AS gt FROM res) WHERE gt IS NOT NULL GROUP BY 1), tr AS (SELECT r.*, coalesce(found, nullif(source_item['ground_truth'], ''), nullif(source_item['answer'], '')) AS truth FROM res r LEFT JOIN bm USING (video_path))"
    right = f"{_letter('truth')} <> '' AND {_species('truth')} <> '' AND ({_letter('prediction')} = {_letter('truth')} OR {_species('prediction')} = {_species('truth')})"
    scored = f"WITH {truth}, sc AS (SELECT lower(truth) AS species, coalesce({right}, false) AS ok FROM tr WHERE prediction NOT IN ('', 'ERROR') AND truth <> ''), ps AS (SELECT species, count(*) AS n, count(*) FILTER (ok) AS ok FROM sc GROUP BY 1)"
    tags = ("think", "rethink", "answer")
    a = "rethink_annotation"
    lines = f"array_to_string(list_transform(list_filter(coalesce({a}.evidence_selection, []), lambda e: e IS NOT NULL), lambda e: '- ' || e), chr(10))"
    nl = "chr(10) || chr(10)"
    both = f"({_tag('c', 'think')} <> '' OR {_tag('c', 'rethink')} <> '')"
    total = " + ".join(f"try_cast(json_extract(r, '$.\"{k}\"') ->> '$' AS INT)" for k in ("evidence text quality", "definition alignment", "cross attribute consistency"))
    sides = f"WITH {ATTRIBUTES_SQL}, sided AS (SELECT record_id, split_part(list_name, '_', 2) AS side, starts_with(list_name, 'extracted') AS seen, name, lower(trim(a ->> 'decision')) AS decision, try_cast(a ->> 'reliability' AS DOUBLE) AS reliability, {total} AS total FROM (SELECT *, json_extract(a, '$.\"rubric scores\"') AS r FROM attribute))"
    words = ", ".join(f"('{side}', '{w}', '{prefix}{i + 1}', '{kind}: {w}')" for side, prefix, kind, ws in (("appearance", "A", "appearance", APPEARANCE), ("behavior", "B", "behaviour", BEHAVIOUR)) for i, w in enumerate(ws))
    return {
        "extract_answer_any_case": f"SELECT result_id, {_any(o)} AS answer FROM res",
        "extract_answer_or_rest": f"SELECT result_id, CASE WHEN {_has(o, 'answer')} THEN {_tag(o, 'answer')} ELSE trim(string_split({o}, '</rethink>')[-1], {_B}) END AS answer FROM res",
        "extract_answer_for_reward": f"SELECT result_id, {_for_reward(o)} AS answer FROM res",
        "check_format": f"SELECT result_id, {', '.join(f'coalesce({_has(o, t)}, false) AS has_{t}' for t in tags)} FROM res",
        "format_summary": f"SELECT checkpoint, count(*) AS total, {', '.join(f'count(*) FILTER ({_has(o, t)}) AS has_{t}' for t in tags)}, count(*) FILTER ({' AND '.join(_has(o, t) for t in tags)}) AS format_ok, count(*) FILTER (error <> '') AS errors FROM res GROUP BY 1",
        "parse_options": f"WITH {resolved_sql()} SELECT * FROM op",
        "resolve_class": f"WITH {resolved_sql()} SELECT result_id, species FROM rs",
        "ground_truth_lookup": f"WITH {truth} SELECT result_id, truth FROM tr",
        "mc_accuracy": f"{scored} SELECT (SELECT count(*) FROM res) AS total, coalesce(sum(n), 0)::BIGINT AS scored, coalesce(sum(ok), 0)::BIGINT AS correct, round(sum(ok) / (SELECT count(*) FROM res), 6) AS micro, round(avg(ok / n), 6) AS macro FROM ps",
        "mc_accuracy_species": f"{scored} SELECT * FROM ps",
        "answer_reward": f"WITH {truth} SELECT result_id, {rewarded_sql(o, 'truth')} AS reward FROM tr",
        "combined_reward": f"SELECT sample_id, round(0.5::DOUBLE * CASE WHEN {both} THEN 0.5::DOUBLE * (sample_id % 5 / 4) + 0.5::DOUBLE ELSE 0 END + {rewarded_sql('c', 's')}, 6) AS reward FROM (SELECT sample_id, reasoning_content AS c, solution[1] AS s FROM rl_train WHERE reasoning_content IS NOT NULL)",
        "trace_build": f"""SELECT record_id, '<think>' || CASE WHEN {lines} = '' THEN 'Observations: (none)' ELSE 'Observations:' || chr(10) || {lines} END || '</think>' || {nl} || '<rethink>' || CASE WHEN coalesce({a}.supporting_reasoning, '') = '' THEN '' ELSE 'Supporting Reasoning: ' || {a}.supporting_reasoning || {nl} || 'Exclusion/Counterfactual: ' || coalesce({a}.exclusion_counterfactual, '') || {nl} || 'Uncertainty: ' || coalesce({a}."uncertainty reasoning", '') END || '</rethink><answer>' || coalesce({a}.summary, '') || '</answer>' AS trace FROM stage2_cot WHERE {a} IS NOT NULL""",
        "validation_integrity": f"""{sides}, counted AS (SELECT record_id, side, count(*) FILTER (seen) AS extracted, count(*) FILTER (NOT seen) AS validated, count(*) FILTER (NOT seen AND abs(reliability - total / 6) > 0.001) AS wrong, count(*) FILTER (NOT seen AND decision = 'keep') AS k, count(*) FILTER (NOT seen AND decision = 'downgrade') AS w, count(*) FILTER (NOT seen AND decision = 'drop') AS d,
 len(list_filter(coalesce(list(DISTINCT name) FILTER (seen AND name IS NOT NULL), []), lambda n: NOT list_contains(coalesce(list(name) FILTER (NOT seen AND name IS NOT NULL), []), n))) AS missing FROM sided GROUP BY 1, 2)
SELECT record_id, side AS list_name, coalesce(extracted, 0)::INT AS extracted, coalesce(validated, 0)::INT AS validated, coalesce(missing, 0)::INT AS missing, coalesce(wrong, 0)::INT AS wrong_reliability, coalesce(k, 0)::INT AS keep, coalesce(w, 0)::INT AS downgrade, coalesce(d, 0)::INT AS drop, coalesce(validated - k - w - d, 0)::INT AS undecided
FROM (SELECT record_id, unnest(['appearance', 'behavior']) AS side FROM stage2_cot) LEFT JOIN counted USING (record_id, side)""",
        "vocab_join": f"{sides} SELECT record_id, label, name, definition FROM sided JOIN (VALUES {words}) v(side, name, label, definition) USING (side, name) WHERE seen",
        "chat_samples": """WITH t AS (SELECT sample_id, list_filter(coalesce(messages, []), lambda m: m IS NOT NULL AND m.content IS NOT NULL) AS m, len(coalesce(videos, []))::INT AS videos FROM sft_train),
o AS (SELECT *, list_concat(list_filter(m, lambda x: coalesce(x.role = 'system', false)), list_filter(m, lambda x: NOT coalesce(x.role = 'system', false))) AS turns FROM t)
SELECT sample_id, len(turns)::INT AS turns, list_transform(turns, lambda x: x.role) AS roles, list_transform(turns, lambda x: x.content) AS contents, videos FROM o""",
    }
