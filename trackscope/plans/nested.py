"""Queries over the nested records of stage2_cot (problem 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested
from ..tables import table


def queries():
    nodes = lambda spark, folder: nested.nested_nodes(table(spark, folder, "stage2_cot"))
    return {
        "p4_found": lambda spark, folder: nested.found(table(spark, folder, "stage2_cot")),
        "p4_records": lambda spark, folder: nested.record_table(nodes(spark, folder)),
        "p4_attributes": lambda spark, folder: nested.attribute_table(nodes(spark, folder)),
        "p4_rubric": lambda spark, folder: nested.rubric_table(nodes(spark, folder)),
        "p4_flags": lambda spark, folder: nested.flag_table(nodes(spark, folder)),
        "p4_rubric_by_decision": _rubric_by_decision,
    }


def _rubric_by_decision(spark, folder):
    """Mean rubric score by list, decision and rubric."""
    nodes = nested.nested_nodes(table(spark, folder, "stage2_cot"), kinds=("attribute", "rubric"))
    scores = nested.children_of(nested.attribute_table(nodes).select("record_id", "pre", "post", "decision"), nested.rubric_table(nodes))
    return scores.groupBy("list_name", F.col("parent_decision").alias("decision"), F.col("name").alias("rubric")).agg(F.count("score").alias("scores"), F.round(F.avg("score"), 6).alias("mean_score"))


def _opened_sql(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN coalesce(try_cast({x} ->> '$' AS JSON), {x}) ELSE {x} END"


def _attributes_sql() -> str:
    """CTEs up to ``attribute`` (record_id, list_name, pos, name, a): every attribute object, from columns or raw_json, as JSON."""
    outer = [name for _, name, _ in nested.LISTS]
    lists = " UNION ALL ".join(f"SELECT record_id, '{name}' AS list_name, json_extract(doc, '$.\"{o}\"') AS l, '{i}' AS inner_key FROM doc" for name, o, i in nested.LISTS)
    fields = "[" + ", ".join(f"'{f}'" for f in nested.ATTRIBUTE_FIELDS) + "]"
    columns = "to_json({" + ", ".join(f"'{c}': {c}" for c in outer) + "})"
    return f"""doc AS (SELECT record_id, CASE WHEN coalesce({', '.join(f'to_json({c})' for c in outer)}) IS NOT NULL THEN {columns}
 WHEN trim(raw_json)[1] = '"' THEN try_cast(json_extract_string(try_cast(raw_json AS JSON), '$') AS JSON) ELSE try_cast(regexp_extract(raw_json, '\\{{.*\\}}', 0, 's') AS JSON) END AS doc FROM stage2_cot),
held AS (SELECT record_id, list_name, inner_key, {_opened_sql('l')} AS h FROM ({lists}) WHERE l IS NOT NULL AND json_type(l) <> 'NULL'),
body AS (SELECT record_id, list_name, h, wrapped, CASE WHEN wrapped THEN {_opened_sql('i')} WHEN json_type(h) = 'OBJECT' AND len(list_filter(json_keys(h), lambda k: k NOT IN ('quality_flags', 'notes'))) = 0 THEN '[]'::JSON ELSE h END AS b
 FROM (SELECT *, json_type(h) = 'OBJECT' AND list_contains(json_keys(h), inner_key) AS wrapped, CASE WHEN json_type(h) = 'OBJECT' THEN json_extract(h, '$."' || inner_key || '"') END AS i FROM held)),
element AS (SELECT record_id, list_name, unnest(range(len(e))) AS pos, unnest(e) AS e FROM (SELECT record_id, list_name, CASE json_type(b) WHEN 'ARRAY' THEN list_transform(json_extract(b, '$[*]'), lambda x: {{'k': NULL::VARCHAR, 'v': x}})
 WHEN 'OBJECT' THEN CASE WHEN len(list_filter(json_keys(b), lambda k: list_contains({fields}, k))) > 0 THEN [{{'k': NULL::VARCHAR, 'v': b}}] ELSE list_transform(list_zip(json_keys(b), json_extract(b, '$.*')), lambda x: {{'k': x[1], 'v': x[2]}}) END END AS e FROM body)),
attribute AS (SELECT record_id, list_name, pos::INT AS pos, CASE WHEN list_contains(json_keys(a), 'name') THEN a ->> 'name' ELSE k END AS name, a FROM (SELECT record_id, list_name, pos, e.k AS k, {_opened_sql('e.v')} AS a FROM element) WHERE json_type(a) = 'OBJECT'),
rubric AS (SELECT record_id, list_name, pos, a ->> 'decision' AS decision, unnest(json_keys(r)) AS rubric, try_cast(unnest(json_extract(r, '$.*')) ->> '$' AS DOUBLE) AS score FROM (SELECT *, {_opened_sql("json_extract(a, '$.\"rubric scores\"')")} AS r FROM attribute) WHERE json_type(r) = 'OBJECT')"""


ATTRIBUTES_SQL = _attributes_sql()


def oracle_sql():
    return {
        "p4_found": f"WITH {ATTRIBUTES_SQL} SELECT record_id, list_name, pos FROM attribute",
        "p4_rubric_by_decision": f"WITH {ATTRIBUTES_SQL} SELECT list_name, decision, rubric, count(score) AS scores, round(avg(score), 6) AS mean_score FROM rubric GROUP BY 1, 2, 3",
    }
