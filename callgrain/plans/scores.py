"""Queries over detector scores: fusion, verdicts, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrain.operators import fusion as fu
from callgrain.operators import guardrails as gr
from callgrain.operators import metrics as me
from callgrain.plans.registry import query
from callgrain.sources import tables as src

CALIBRATORS = [("click", 4.0, -2.0), ("view", 3.0, -1.0), ("purchase", 6.0, -3.0)]
WEIGHTS = [("click", 0.35), ("view", 0.25), ("purchase", 0.2), ("error", 0.2)]
GREEN, RED = 0.62, 0.7

SCORES = """ev AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS win_ix FROM events),
scores AS (SELECT user_id AS call_id, win_ix, event_type AS name, arg_max(value, event_id) / (1 + arg_max(value, event_id)) AS score FROM ev GROUP BY ALL)"""
CAL = SCORES + """, cal(name, a, b) AS (VALUES ('click', 4.0::DOUBLE, -2.0::DOUBLE), ('view', 3.0, -1.0), ('purchase', 6.0, -3.0)),
p AS (SELECT call_id, win_ix, name, score, CASE WHEN a IS NOT NULL THEN 1 / (1 + exp(-(a * score + b))) ELSE least(greatest(score, 0), 1) END AS p FROM scores LEFT JOIN cal USING (name))"""
CTX = CAL + """, k AS (SELECT user_id AS call_id, avg((props->>'$.k')::DOUBLE) / 100 AS score FROM events GROUP BY user_id),
ctx AS (SELECT call_id, unnest(['error', 'context_k']) AS name, least(greatest(score, 0), 1) AS p FROM k),
every AS (SELECT call_id, win_ix, name, p FROM p UNION ALL
  SELECT w.call_id, w.win_ix, c.name, c.p FROM (SELECT DISTINCT call_id, win_ix FROM p) w JOIN ctx c USING (call_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.call_id = w.call_id AND p.win_ix = w.win_ix AND p.name = c.name))"""
FUSE = CTX + """, wt(name, w) AS (VALUES ('click', 0.35::DOUBLE), ('view', 0.25), ('purchase', 0.2), ('error', 0.2)),
fused AS (SELECT call_id, win_ix, coalesce(sum(w * p) / sum(CASE WHEN w IS NOT NULL THEN w END), avg(p), 0.5) AS fused FROM every LEFT JOIN wt USING (name) GROUP BY ALL)"""
GUARD = FUSE + """, fl AS (SELECT user_id AS call_id, count(*) % 3 = 0 AS background, avg(value) > 48 AS suppressed FROM events GROUP BY user_id),
g AS (SELECT call_id, win_ix, CASE WHEN background THEN greatest(0, fused - 0.25) ELSE fused END AS q, suppressed FROM fused JOIN fl USING (call_id)),
guarded AS (SELECT call_id, win_ix, CASE WHEN suppressed THEN 0.5 + (q - 0.5) * 0.85 ELSE q END AS fused FROM g)"""
EMA = GUARD + """, s AS (SELECT call_id, list(fused ORDER BY win_ix) AS s FROM guarded GROUP BY call_id),
e AS (SELECT call_id, list_reduce(s, lambda e, x: 0.4 * x + 0.6 * e) AS score FROM s)"""
LABELLED = "lab AS (SELECT doc_id, quality AS y, lang, source, (n_chars % 97)::DOUBLE / 97 AS score FROM labels JOIN documents USING (doc_id))"
ROC = LABELLED + """, d AS (SELECT score AS threshold, sum(y)::BIGINT AS dt, sum(1 - y)::BIGINT AS df FROM lab GROUP BY score),
c AS (SELECT *, sum(dt) OVER w AS tps, sum(df) OVER w AS fps, lead(dt) OVER w AS nt, lead(df) OVER w AS nf, row_number() OVER w AS r FROM d WINDOW w AS (ORDER BY threshold DESC)),
roc AS (SELECT 'inf'::DOUBLE AS threshold, 0::BIGINT AS tps, 0::BIGINT AS fps UNION ALL SELECT threshold, tps::BIGINT, fps::BIGINT FROM c WHERE nt IS NULL OR nt <> dt OR nf <> df OR r = 1),
rt AS (SELECT *, tps / max(tps) OVER () AS tpr, fps / max(fps) OVER () AS fpr FROM roc)"""


def _cal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALIBRATORS, "name string, a double, b double")


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "name string, w double")


def _calibrated(spark, sf_dir):
    return fu.calibrate(src.window_scores(spark, sf_dir), _cal(spark)).select("call_id", "win_ix", "name", "score", "p")


def _every(spark, sf_dir):
    context = src.context_scores(spark, sf_dir).select("call_id", "name", fu.clip01(F.col("score")).alias("p"))
    return fu.with_context(_calibrated(spark, sf_dir).drop("score"), context)


def _flags(spark, sf_dir):
    return src.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("call_id")).agg((F.count("*") % 3 == 0).alias("background"), (F.avg("value") > 48).alias("suppressed"))


def _fused(spark, sf_dir):
    return fu.combine(_every(spark, sf_dir), _weights(spark))


def _guarded(spark, sf_dir):
    return fu.guard(_fused(spark, sf_dir), _flags(spark, sf_dir)).select("call_id", "win_ix", "fused")


@query(f"WITH {CAL} SELECT call_id, win_ix, name, round(p, 6) AS p FROM p")
def q_calibrate(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("call_id", "win_ix", "name", F.round("p", 6).alias("p"))


@query(f"WITH {CTX} SELECT call_id, win_ix, name, round(p, 9) AS p FROM every")
def q_context_precedence(spark, sf_dir):
    return _every(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(f"WITH {FUSE} SELECT call_id, win_ix, round(fused, 6) AS fused FROM fused")
def q_fuse_fallback(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("fused", F.round("fused", 6))


@query(f"WITH {GUARD} SELECT call_id, win_ix, round(fused, 6) AS fused FROM guarded")
def q_guardrails(spark, sf_dir):
    return _guarded(spark, sf_dir).withColumn("fused", F.round("fused", 6))


@query(f"WITH {EMA} SELECT call_id, round(score, 6) AS score FROM e")
def q_ema(spark, sf_dir):
    return fu.ordered(_guarded(spark, sf_dir)).select("call_id", F.round(fu.ema(F.col("s")), 6).alias("score"))


@query(f"""WITH {GUARD}, s AS (SELECT call_id, list(fused ORDER BY win_ix) AS s FROM guarded GROUP BY call_id),
t AS (SELECT call_id, s, unnest(range(1, len(s) + 1)) AS k FROM s)
SELECT call_id, k - 1 AS step, round(list_reduce(s[1:k], lambda e, x: 0.4 * x + 0.6 * e), 6) AS smoothed FROM t""")
def q_ema_trace(spark, sf_dir):
    return fu.ema_trace(_guarded(spark, sf_dir)).withColumn("smoothed", F.round("smoothed", 6))


@query(f"""WITH {EMA}, v AS (SELECT *, CASE WHEN score >= {RED} - 1e-9 THEN 'RED' WHEN score >= {GREEN} - 1e-9 THEN 'CHALLENGE' ELSE 'GREEN' END AS state FROM e)
SELECT call_id, state, round(score, 6) AS score, round(least(greatest(CASE state WHEN 'RED' THEN score WHEN 'GREEN' THEN 1 - score
ELSE 0.5 + least(score - {GREEN}, {RED} - score) / ({RED} - {GREEN}) END, 0), 1), 5) AS confidence FROM v""")
def q_verdict(spark, sf_dir):
    rows = fu.verdicts(_guarded(spark, sf_dir), GREEN, RED)
    return rows.select("call_id", "state", F.round("score", 6).alias("score"), F.round("confidence", 5).alias("confidence"))


@query(f"""WITH {FUSE}, m AS (SELECT call_id, name, avg(p) AS m, round(coalesce(any_value(w), 0) * abs(avg(p) - 0.5), 9) AS pull FROM every LEFT JOIN wt USING (name) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pull DESC, name) AS r FROM m)
SELECT call_id, 'top detectors: ' || string_agg(format('{{}}={{:.2f}}', name, m), ', ' ORDER BY r) AS reason FROM r WHERE r <= 3 GROUP BY call_id""")
def q_reason_topk(spark, sf_dir):
    return fu.top_reasons(_every(spark, sf_dir), _weights(spark))


@query(f"""WITH {SCORES} SELECT call_id, win_ix, round(coalesce(max(score) FILTER (WHERE name = 'click'), 0.5), 6) AS click, round(coalesce(max(score) FILTER (WHERE name = 'view'), 0.5), 6) AS "view",
round(coalesce(max(score) FILTER (WHERE name = 'purchase'), 0.5), 6) AS purchase, round(coalesce(max(score) FILTER (WHERE name = 'error'), 0.5), 6) AS error FROM scores GROUP BY ALL""")
def q_pivot_impute(spark, sf_dir):
    names = ["click", "view", "purchase", "error"]
    wide = src.window_scores(spark, sf_dir).groupBy("call_id", "win_ix").pivot("name", names).agg(F.max("score"))
    return wide.select("call_id", "win_ix", *[F.round(F.coalesce(n, F.lit(0.5)), 6).alias(n) for n in names])


@query("""SELECT event_id, coalesce((props->>'$.score')::DOUBLE, (props->>'$.value')::DOUBLE, (props->>'$.k')::DOUBLE) AS detail FROM events""")
def q_details_probe(spark, sf_dir):
    details = [F.get_json_object("props", f"$.{k}").cast("double") for k in ("score", "value", "k")]
    return src.table(spark, sf_dir, "events").select("event_id", F.coalesce(*details).alias("detail"))


def _roc(spark, sf_dir):
    return me.roc(src.labelled(spark, sf_dir))


@query(f"WITH {ROC} SELECT round(threshold, 9) AS threshold, tps, fps FROM roc")
def q_roc(spark, sf_dir):
    return _roc(spark, sf_dir).withColumn("threshold", F.round("threshold", 9))


@query(f"""WITH {LABELLED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 9) AS auc FROM lab p, lab n WHERE p.y = 1 AND n.y = 0""")
def q_auc(spark, sf_dir):
    return me.auc_of_all(src.labelled(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {ROC}, t(target) AS (VALUES (0.01::DOUBLE), (0.02), (0.05), (0.2)),
b AS (SELECT target, tpr, threshold, row_number() OVER (PARTITION BY target ORDER BY fps DESC, tps DESC, threshold) AS r FROM t JOIN rt ON fpr <= target + 1e-12)
SELECT target, round(tpr, 9) AS hit, round(threshold, 9) AS threshold FROM b WHERE r = 1""")
def q_hit_at_fpr(spark, sf_dir):
    rows = me.at_fpr(_roc(spark, sf_dir), [0.01, 0.02, 0.05, 0.2])
    return rows.select("target", F.round("hit", 9).alias("hit"), F.round("threshold", 9).alias("threshold"))


@query(f"""WITH {ROC}, dd AS (SELECT *, fpr - (1 - tpr) AS d, row_number() OVER (ORDER BY fps, tps) AS ix FROM rt),
l AS (SELECT *, lag(d) OVER (ORDER BY ix) AS d0, lag(fpr) OVER (ORDER BY ix) AS f0 FROM dd)
SELECT round(CASE WHEN d0 * d < 0 THEN f0 + (fpr - f0) * (-d0) / (d - d0) ELSE (fpr + 1 - tpr) / 2 END, 9) AS eer FROM l ORDER BY round(abs(d), 12), ix LIMIT 1""")
def q_eer(spark, sf_dir):
    return me.eer(_roc(spark, sf_dir)).select(F.round("eer", 9).alias("eer"))


@query(f"""WITH {LABELLED}, x AS (SELECT y, score, unnest([{{'dim': 'lang', 'slice': lang}}, {{'dim': 'source', 'slice': source}}]) AS s FROM lab)
SELECT s.dim AS dim, s.slice AS slice, count(*) AS n, sum(y)::BIGINT AS n_relay, round(avg((score >= 0.5)::INT) FILTER (WHERE y = 1), 9) AS recall, round(avg((score >= 0.5)::INT) FILTER (WHERE y = 0), 9) AS fpr FROM x GROUP BY ALL""")
def q_slice_table(spark, sf_dir):
    dims = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("slice")) for c in ("lang", "source")])).alias("s")
    rows = src.labelled(spark, sf_dir).select("y", (F.col("score") >= 0.5).cast("int").alias("hit"), dims)
    return rows.groupBy("s.dim", "s.slice").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n_relay"), F.round(F.avg(F.when(F.col("y") == 1, F.col("hit"))), 9).alias("recall"), F.round(F.avg(F.when(F.col("y") == 0, F.col("hit"))), 9).alias("fpr"))


@query(f"WITH {LABELLED} SELECT lang, source, count(*) AS n, round(avg(score), 9) AS mean_score FROM lab GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def q_slice_sets(spark, sf_dir):
    lang, source = F.col("lang"), F.col("source")
    rows = src.labelled(spark, sf_dir)
    return rows.groupingSets([[lang], [source], [lang, source], []], lang, source).agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


@query(f"WITH {LABELLED} SELECT y::BIGINT AS y, count(*) AS n, round(avg(((score >= 0.5)::INT = y)::INT), 9) AS accuracy FROM lab GROUP BY ROLLUP (y)")
def q_label_accuracy(spark, sf_dir):
    rows = src.labelled(spark, sf_dir).withColumn("right", ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("int"))
    return rows.rollup(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("right"), 9).alias("accuracy"))


@query(f"""WITH {LABELLED}, s AS (SELECT lang, score, y FROM lab), pos AS (SELECT score FROM s WHERE y = 1), neg AS (SELECT lang, score FROM s WHERE y = 0)
SELECT neg.lang, round(avg(CASE WHEN pos.score > neg.score THEN 1.0 WHEN pos.score = neg.score THEN 0.5 ELSE 0 END), 9) AS auc FROM neg, pos GROUP BY neg.lang""")
def q_slice_auc(spark, sf_dir):
    return me.auc_against_all_positives(src.labelled(spark, sf_dir), ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


@query(f"WITH {LABELLED} SELECT round(quantile_cont(score, 0.1) FILTER (WHERE y = 1), 9) AS theta_red, round(quantile_cont(score, 0.95) FILTER (WHERE y = 0), 9) AS theta_green FROM lab")
def q_np_thresholds(spark, sf_dir):
    rows = src.labelled(spark, sf_dir)
    pick = lambda y, q, n: F.round(F.percentile(F.when(F.col("y") == y, F.col("score")), F.lit(q)), 9).alias(n)
    return rows.agg(pick(1, 0.1, "theta_red"), pick(0, 0.95, "theta_green"))


@query("SELECT quality AS y, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 9)::DOUBLE AS weight FROM labels GROUP BY quality")
def q_class_weights(spark, sf_dir):
    n = src.table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.round(F.sum("n").over(Window.partitionBy()).cast("double") / (2 * F.col("n")), 9))


@query("SELECT doc_id, unnest(range(1, CASE WHEN toxic = 1 THEN 4 ELSE 2 END)) AS copy FROM labels")
def q_boost_oversample(spark, sf_dir):
    from callgrain.operators.splits import oversample

    rows = oversample(src.table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.when(F.col("toxic") == 1, 3.0).otherwise(1.0))
    return rows.select("doc_id", F.col("copy").cast("long"))


@query("""WITH d AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'no json' ELSE '{"quantization_noise": {"noise_flatness": ' || value || ', "flag": ' || (event_id % 2 = 0)::VARCHAR || ', "deep": {"x": 1}}, "rt60": "'
|| CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE (event_id % 10)::VARCHAR || '.5' END || '", "rt60_s": ' || event_id || ', "dead_floor": ' || (event_id % 5 = 0)::VARCHAR || ', "n_clusters": [1], "n_speakers": 2' || '}' END AS j FROM events)
SELECT event_id, CASE WHEN json_valid(j) THEN coalesce(try_cast(j->>'$.rt60' AS DOUBLE), (j->>'$.rt60_s')::DOUBLE) END AS rt60,
CASE WHEN json_valid(j) THEN (j->>'$.quantization_noise.noise_flatness')::DOUBLE END AS flat, CASE WHEN json_valid(j) THEN (event_id % 2 = 0)::INT::DOUBLE END AS flag,
CASE WHEN json_valid(j) THEN (event_id % 5 = 0)::INT::DOUBLE END AS dead, CASE WHEN json_valid(j) THEN 2.0::DOUBLE END AS clusters, CASE WHEN json_valid(j) THEN 5 ELSE 0 END::BIGINT AS known FROM
(SELECT event_id, j FROM d)""")
def q_detail_numbers(spark, sf_dir):
    """Details that come as JSON, through VARIANT: nested objects, booleans, texts that are numbers and texts that are not."""
    e, text = F.col("event_id"), lambda c: c.cast("string")
    rt60 = F.when(e % 3 == 0, "unknown").otherwise(F.concat(text(e % 10), F.lit(".5")))
    said = F.concat(F.lit('{"quantization_noise": {"noise_flatness": '), text(F.col("value")), F.lit(', "flag": '), text(e % 2 == 0), F.lit(', "deep": {"x": 1}}, "rt60": "'), rt60, F.lit('", "rt60_s": '), text(e), F.lit(', "dead_floor": '), text(e % 5 == 0), F.lit(', "n_clusters": [1], "n_speakers": 2}'))
    rows = src.table(spark, sf_dir, "events").select("event_id", F.when(e % 7 == 0, F.lit(None)).when(e % 11 == 0, "no json").otherwise(said).alias("details"))
    found = gr.as_numbers(rows)
    known = F.size(F.map_filter("details", lambda k, v: k != "rt60"))
    return found.select("event_id", gr.detail(gr.RT60).alias("rt60"), gr.detail(gr.FLAT).alias("flat"), gr.detail(("quantization_noise.flag",)).alias("flag"), gr.detail(gr.SUPPRESSED).alias("dead"), gr.detail(gr.CLUSTERS).alias("clusters"), known.cast("long").alias("known"))
