"""Queries over boxes: alignment, matching and average precision on boxes derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from ..session import cut_lineage
from ..tables import table

_BOX = """event_id AS ord, 'seq_' || lpad(CAST(user_id % 20 AS STRING), 2, '0') AS sequence_name, CAST(floor(({seconds}) / 21600) AS BIGINT) AS frame_id, event_id AS track_id, 'class_' || CAST(event_id % 10 AS STRING) AS class_name,
CAST((event_id % 3) * 60 + (event_id * 7) % 23 + {dx} AS DOUBLE) AS x1, CAST((event_id * 11) % 17 + {dy} AS DOUBLE) AS y1,
CAST((event_id % 3) * 60 + (event_id * 7) % 23 + 40 + event_id % 25 + {dx} AS DOUBLE) AS x2, CAST((event_id * 11) % 17 + 8 + (event_id * 13) % 40 + {dy} AS DOUBLE) AS y2, {score} AS score"""
_SHIFT = {"dx": "(event_id * 5) % 15 - 7", "dy": "(event_id * 3) % 9 - 4", "score": "value / 500"}
_PLACE = {"dx": "0", "dy": "0", "score": "CAST(1.0 AS DOUBLE)"}
_SPARK_S, _DUCK_S = "unix_timestamp(ts) - 1704067200", "epoch(ts) - 1704067200"


def truth_boxes(spark, folder):
    return _boxes(spark, folder, "event_type <> 'error'", _PLACE)


def predicted_boxes(spark, folder):
    return _boxes(spark, folder, "event_type <> 'signup'", _SHIFT)


def _boxes(spark, folder, where, parts):
    events = table(spark, folder, "events").where(where)
    return events.select(*(F.expr(e) for e in _split(_BOX.format(seconds=_SPARK_S, **parts))))


def _split(text: str) -> list[str]:
    """The expressions of a select list, cut at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


#: The last common table of ``match_sql``.
_THRESHOLDS_CTE = "thr AS (SELECT th.cls, th.difficulty, idx, sc.score AS threshold FROM th JOIN sc ON sc.cls = th.cls AND sc.difficulty = th.difficulty AND sc.i = th.i)"

BOXES_SQL = f"""gt AS (SELECT {_BOX.format(seconds=_DUCK_S, **_PLACE)} FROM events WHERE event_type <> 'error'),
pr AS (SELECT {_BOX.format(seconds=_DUCK_S, **_SHIFT)} FROM events WHERE event_type <> 'signup')"""

_IOU = """CASE WHEN least(g.x2, p.x2) > greatest(g.x1, p.x1) AND least(g.y2, p.y2) > greatest(g.y1, p.y1)
 THEN (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))
 / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))) ELSE 0.0 END"""


def match_sql(by: str) -> str:
    """CTEs up to ``first_pass`` (keys, difficulty, eligible, scores) and ``curve``; ``by`` is an expression over a box."""
    return f"""{BOXES_SQL},
lv AS (SELECT * FROM (VALUES ('easy', 20.0::DOUBLE), ('moderate', 10.0::DOUBLE), ('hard', 10.0::DOUBLE)) v(difficulty, least_h)),
g AS (SELECT gt.*, {by} AS cls FROM gt), p AS (SELECT pr.*, {by} AS cls FROM pr),
cand AS (SELECT g.sequence_name, g.frame_id, g.cls, g.ord AS gord, p.ord AS pid, p.score, p.y2 - p.y1 AS ph, {_IOU} AS iou FROM g JOIN p USING (sequence_name, frame_id, cls)),
cl AS (SELECT gord, difficulty, list({{'k0': (ph < least_h)::INT, 'k1': CASE WHEN ph < least_h THEN 0.0 ELSE -iou END, 'pid': pid, 'score': score, 'flag': (ph < least_h)::INT}} ORDER BY (ph < least_h)::INT, CASE WHEN ph < least_h THEN 0.0 ELSE -iou END, pid) AS best,
 list({{'pid': pid, 'score': score, 'flag': (ph < least_h)::INT}} ORDER BY pid DESC) FILTER (score > 0) AS lasts FROM cand CROSS JOIN lv WHERE iou > 0.3 GROUP BY gord, difficulty),
gl AS (SELECT g.sequence_name, g.frame_id, g.cls, lv.difficulty, row_number() OVER (PARTITION BY g.sequence_name, g.frame_id, g.cls, lv.difficulty ORDER BY g.ord) AS rn, (g.y2 - g.y1 < least_h)::INT AS flag, coalesce(best, []) AS best, coalesce(lasts, []) AS lasts
 FROM g CROSS JOIN lv LEFT JOIN cl ON cl.gord = g.ord AND cl.difficulty = lv.difficulty),
one AS (SELECT sequence_name, frame_id, cls, difficulty, 0::BIGINT AS rn, []::BIGINT[] AS used, []::DOUBLE[] AS scores FROM gl GROUP BY ALL
 UNION ALL SELECT s.sequence_name, s.frame_id, s.cls, s.difficulty, n.rn, CASE WHEN n.ch IS NULL THEN s.used ELSE list_append(s.used, n.ch.pid) END, CASE WHEN n.ch IS NOT NULL AND n.flag = 0 AND n.ch.flag = 0 THEN list_append(s.scores, n.ch.score) ELSE s.scores END
 FROM (SELECT s.sequence_name, s.frame_id, s.cls, s.difficulty, gl.rn, gl.flag, list_filter(gl.lasts, lambda x: NOT list_contains(s.used, x.pid))[1] AS ch FROM one s JOIN gl ON gl.sequence_name = s.sequence_name AND gl.frame_id = s.frame_id AND gl.cls = s.cls AND gl.difficulty = s.difficulty AND gl.rn = s.rn + 1) n
 JOIN one s ON n.sequence_name = s.sequence_name AND n.frame_id = s.frame_id AND n.cls = s.cls AND n.difficulty = s.difficulty AND n.rn = s.rn + 1),
first_pass AS (SELECT sequence_name, frame_id, cls, difficulty, rn AS truths, scores FROM one QUALIFY row_number() OVER (PARTITION BY sequence_name, frame_id, cls, difficulty ORDER BY rn DESC) = 1),
n AS (SELECT cls, difficulty, count(*) FILTER (flag = 0) AS n FROM gl GROUP BY ALL),
sc AS (SELECT cls, difficulty, score, row_number() OVER (PARTITION BY cls, difficulty ORDER BY score DESC) AS i, count(*) OVER (PARTITION BY cls, difficulty) AS m FROM (SELECT cls, difficulty, unnest(scores) AS score FROM first_pass)),
th AS (SELECT n.cls, n.difficulty, n.n::DOUBLE AS n, count(sc.i) AS m, 0::BIGINT AS i, 0.0::DOUBLE AS cur, -1 AS idx FROM n JOIN sc USING (cls, difficulty) GROUP BY ALL
 UNION ALL SELECT cls, difficulty, n, m, list_filter(range(i + 1, m + 1), lambda x: x = m OR NOT ((x + 1) / n - cur < cur - x / n))[1], cur + 1.0::DOUBLE / 40.0::DOUBLE, idx + 1 FROM th WHERE i < m),
thr AS (SELECT th.cls, th.difficulty, idx, sc.score AS threshold FROM th JOIN sc ON sc.cls = th.cls AND sc.difficulty = th.difficulty AND sc.i = th.i)"""


def curve_sql(by: str) -> str:
    return f"""{match_sql(by)},
fr AS (SELECT DISTINCT sequence_name, frame_id, cls, difficulty FROM gl),
two AS (SELECT fr.*, thr.idx, thr.threshold, 0::BIGINT AS rn, []::BIGINT[] AS used, 0 AS tp, 0 AS fn, 0 AS pu FROM fr JOIN thr USING (cls, difficulty)
 UNION ALL SELECT sequence_name, frame_id, cls, difficulty, idx, threshold, rn, CASE WHEN ch IS NULL THEN used ELSE list_append(used, ch.pid) END, tp + coalesce((flag = 0 AND ch.flag = 0)::INT, 0), fn + (flag = 0 AND ch IS NULL)::INT, pu + coalesce((ch.flag = 0)::INT, 0)
 FROM (SELECT s.* EXCLUDE (rn), gl.rn, gl.flag, list_filter(gl.best, lambda x: x.score >= s.threshold AND NOT list_contains(s.used, x.pid))[1] AS ch FROM two s JOIN gl ON gl.sequence_name = s.sequence_name AND gl.frame_id = s.frame_id AND gl.cls = s.cls AND gl.difficulty = s.difficulty AND gl.rn = s.rn + 1)),
done AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY sequence_name, frame_id, cls, difficulty, idx ORDER BY rn DESC) = 1),
above AS (SELECT d.sequence_name, d.frame_id, d.cls, d.difficulty, d.idx, count(p.ord) FILTER (p.score >= d.threshold AND p.y2 - p.y1 >= least_h) AS n FROM done d JOIN lv USING (difficulty) LEFT JOIN p ON p.sequence_name = d.sequence_name AND p.frame_id = d.frame_id AND p.cls = d.cls GROUP BY ALL),
curve AS (SELECT cls, difficulty, idx, threshold, sum(tp)::BIGINT AS tp, sum(above.n - pu)::BIGINT AS fp, sum(fn)::BIGINT AS fn, CASE WHEN sum(tp) + sum(above.n - pu) = 0 THEN 0 ELSE sum(tp) / (sum(tp) + sum(above.n - pu)) END AS prec
 FROM done JOIN above USING (sequence_name, frame_id, cls, difficulty, idx) GROUP BY ALL),
ap AS (SELECT cls, difficulty, sum(env) / 41 * 100 AS ap41, sum(env) FILTER (idx % 4 = 0) / 11 * 100 AS ap11 FROM (SELECT *, max(prec) OVER (PARTITION BY cls, difficulty ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM curve) GROUP BY ALL),
aps AS (SELECT n.cls, n.difficulty, round(coalesce(ap11, 0), 6) AS ap11, round(coalesce(ap41, 0), 6) AS ap41 FROM n LEFT JOIN ap USING (cls, difficulty))"""


KEYS = [*matching.FRAME, "class_name"]


def _coarse(boxes):
    return boxes.withColumn("class_name", F.lit("fish"))


def _pair(spark, folder, coarse):
    pair = truth_boxes(spark, folder), predicted_boxes(spark, folder)
    return tuple(map(_coarse, pair)) if coarse else pair


def _groups(spark, folder):
    return matching.matching_groups(*_pair(spark, folder, True), KEYS, cut=False)


def _ap(spark, folder, coarse, rounded=True):
    return matching.detection_ap(*_pair(spark, folder, coarse), ["class_name"], KEYS, rounded)


def _thresholds(spark, folder):
    return matching.pr_thresholds(cut_lineage(matching.match_last(_groups(spark, folder))), ["class_name"])


def _curve(spark, folder):
    return matching.detection_curve(*_pair(spark, folder, True), ["class_name"], KEYS)


def _envelope(spark, folder):
    curve = matching.precision_envelope(_curve(spark, folder), ["class_name"])
    return curve.select("difficulty", "idx", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("envelope", 6).alias("envelope"))


def _best(spark, folder):
    at = matching.match_best(_groups(spark, folder), F.array(F.lit(0.0), F.lit(0.3), F.lit(0.6)), ["class_name"])
    return at.groupBy("difficulty", "threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def _frame_ap(spark, folder):
    t, p = truth_boxes(spark, folder), predicted_boxes(spark, folder)
    return matching.detection_ap(t, p, matching.FRAME, matching.FRAME)


def queries():
    both = lambda f: lambda spark, folder: f(truth_boxes(spark, folder), predicted_boxes(spark, folder))
    align = lambda mode: both(lambda t, p: matching.align_frames(t, p, mode))
    return {
        "frame_align_union": align("union"),
        "frame_align_gt_present": align("gt_present"),
        "frame_align_gt_range": align("gt_range"),
        "alignment_counts": both(lambda t, p: matching.alignment_counts(matching.align_frames(t, p))),
        "iou_pairs": both(lambda t, p: matching.iou_pairs(t, p, matching.FRAME, places=6)),
        "greedy_match_last": lambda spark, folder: matching.match_last(_groups(spark, folder)).groupBy("difficulty").agg(F.sum("eligible").alias("eligible"), F.sum("tp").alias("tp"), F.round(F.sum(F.expr("aggregate(scores, 0D, (a, x) -> a + x)")), 6).alias("score_sum")),
        "greedy_match_best": _best,
        "pr_thresholds": lambda spark, folder: _thresholds(spark, folder).select("difficulty", "idx", F.round("threshold", 9).alias("threshold")),
        "pr_curve": lambda spark, folder: _curve(spark, folder).select("difficulty", "idx", *(F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall"))),
        "precision_envelope": _envelope,
        "detection_ap_coarse": lambda spark, folder: _ap(spark, folder, True),
        "detection_ap_fine": lambda spark, folder: _ap(spark, folder, False),
        "macro_ap": lambda spark, folder: matching.macro_ap(_ap(spark, folder, False)),
        "mean_ap": lambda spark, folder: matching.mean_ap(_ap(spark, folder, False, False), ["class_name"]),
        "frame_ap": _frame_ap,
    }


def oracle_sql():
    tf = "SELECT DISTINCT sequence_name, frame_id, true AS in_truth FROM gt"
    pf = "SELECT DISTINCT sequence_name, frame_id, true AS in_predicted FROM pr"
    flags = "sequence_name, frame_id, coalesce(in_truth, false) AS in_truth, coalesce(in_predicted, false) AS in_predicted"
    union = f"SELECT {flags} FROM ({tf}) FULL JOIN ({pf}) USING (sequence_name, frame_id)"
    coarse, fine = "'fish'", "class_name"
    per_frame = "sequence_name || '|' || frame_id"
    return {
        "frame_align_union": f"WITH {BOXES_SQL} {union}",
        "frame_align_gt_present": f"WITH {BOXES_SQL} SELECT {flags} FROM ({tf}) LEFT JOIN ({pf}) USING (sequence_name, frame_id)",
        "frame_align_gt_range": f"WITH {BOXES_SQL}, r AS (SELECT sequence_name, unnest(generate_series(min(frame_id), max(frame_id))) AS frame_id FROM gt GROUP BY 1) SELECT {flags} FROM r LEFT JOIN ({tf}) USING (sequence_name, frame_id) LEFT JOIN ({pf}) USING (sequence_name, frame_id)",
        "alignment_counts": f"WITH {BOXES_SQL} SELECT sequence_name, count(*) FILTER (in_truth AND in_predicted) AS common, count(*) FILTER (in_truth AND NOT in_predicted) AS truth_only, count(*) FILTER (NOT in_truth AND in_predicted) AS predicted_only FROM ({union}) GROUP BY 1",
        "iou_pairs": f"WITH {BOXES_SQL} SELECT * FROM (SELECT sequence_name, frame_id, g.ord AS truth_ord, p.ord AS predicted_ord, round({_IOU}, 6) AS iou FROM gt g JOIN pr p USING (sequence_name, frame_id)  WHERE {_IOU} > 0.3)",
        "greedy_match_last": f"WITH RECURSIVE {match_sql(coarse)} SELECT n.difficulty, n.n AS eligible, f.tp, f.score_sum FROM n JOIN (SELECT difficulty, sum(len(scores))::BIGINT AS tp, round(sum(list_sum(scores)), 6) AS score_sum FROM first_pass GROUP BY 1) f USING (difficulty)",
        "greedy_match_best": f"WITH RECURSIVE {curve_sql(coarse).replace(_THRESHOLDS_CTE, 'thr AS (SELECT cls, difficulty, idx, threshold FROM n CROSS JOIN (VALUES (0, 0.0::DOUBLE), (1, 0.3::DOUBLE), (2, 0.6::DOUBLE)) v(idx, threshold))')} SELECT difficulty, threshold, tp, fp, fn FROM curve",
        "pr_thresholds": f"WITH RECURSIVE {match_sql(coarse)} SELECT difficulty, idx, round(threshold, 9) AS threshold FROM thr",
        "precision_envelope": f"WITH RECURSIVE {curve_sql(coarse)} SELECT difficulty, idx, round(threshold, 6) AS threshold, tp, fp, fn, round(prec, 6) AS precision, round(max(prec) OVER (PARTITION BY difficulty ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS envelope FROM curve",
        "detection_ap_coarse": f"WITH RECURSIVE {curve_sql(coarse)} SELECT cls AS class_name, difficulty, ap11, ap41 FROM aps",
        "detection_ap_fine": f"WITH RECURSIVE {curve_sql(fine)} SELECT cls AS class_name, difficulty, ap11, ap41 FROM aps",
        "pr_curve": f"WITH RECURSIVE {curve_sql(coarse)} SELECT difficulty, idx, round(threshold, 6) AS threshold, round(prec, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall FROM curve",
        "mean_ap": f"WITH RECURSIVE {curve_sql(fine)} SELECT n.cls AS class_name, round(avg(coalesce(ap11, 0)), 6) AS map11, round(avg(coalesce(ap41, 0)), 6) AS map41 FROM n LEFT JOIN ap USING (cls, difficulty) GROUP BY 1",
        "macro_ap": f"WITH RECURSIVE {curve_sql(fine)} SELECT difficulty, round(avg(ap11), 5) AS ap11, round(avg(ap41), 5) AS ap41, count(*) AS classes FROM aps GROUP BY 1",
        "frame_ap": f"WITH RECURSIVE {curve_sql(per_frame)} SELECT split_part(cls, '|', 1) AS sequence_name, split_part(cls, '|', 2)::BIGINT AS frame_id, difficulty, ap11, ap41 FROM aps",
    }
