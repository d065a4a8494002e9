"""Queries over scores with details, reports, samples and plans of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.operators import datagen as dg
from callgrain.operators import detectors as det
from callgrain.operators import evaluation as ev
from callgrain.operators import guardrails as gr
from callgrain.operators import learning as le
from callgrain.operators import metrics as me
from callgrain.operators import ranked
from callgrain.operators import scenes as sc
from callgrain.operators import verdict as vd
from callgrain.operators.conversation import score as talk_score
from callgrain.plans.registry import query
from callgrain.plans.scores import CALIBRATORS, LABELLED, ROC
from callgrain.sources import audio as files
from callgrain.sources import records as rec
from callgrain.sources import tables as src

#: The stand-in for features and cues: |e[1]| to |e[64]| of an embedding, cut at 1.
CUES = "c AS (SELECT vec_id, list_transform(embedding, lambda x: least(abs(x::DOUBLE) * 2, 1.0::DOUBLE)) AS e FROM embeddings)"
WEIGHTS = [("reverb", 0.3), ("cnn", 0.35), ("gbm", 0.25), ("scene_context", 0.1)]
GREEN, RED = 0.35, 0.8


def _cues(spark, sf_dir, names, scale=None):
    e = F.transform("embedding", lambda x: F.least(F.abs(x.cast("double")) * 2, F.lit(1.0)))
    rows = src.table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return rows.select("vec_id", *[(F.col("e")[i] * (scale or {}).get(n, 1.0)).alias(n) for i, n in enumerate(names)])


RULE_INPUTS = ["bandedge_drop_300", "bandedge_drop_3400", "hf_void_frac", "hbcorr_3k4_4k", "hbcorr_4k_8k", "srmr_mean", "env_decay_slope", "env_decay_t12", "thd_proxy", "plateau_frac", "crest_factor_mean", "dyn_range_db"]


@query(f"""WITH {CUES}, z AS (SELECT vec_id,
0.40 * least(e[1], e[2]) + 0.20 * (e[1] + e[2]) / 2 + 0.20 * e[3] + 0.20 * (1 - 0.5 * (e[4] + e[5])) AS b,
0.35 * (1 - e[6]) + 0.35 * (1 - e[7]) + 0.30 * e[8] AS r, 0.40 * e[9] + 0.25 * e[10] + 0.20 * (1 - e[11]) + 0.15 * (1 - e[12]) AS d FROM c)
SELECT vec_id, round(1 / (1 + exp(-10 * (b - 0.5))), 6) AS bandwidth_forensics, round(1 / (1 + exp(-10 * (r - 0.5))), 6) AS reverb, round(1 / (1 + exp(-10 * (d - 0.5))), 6) AS distortion FROM z""")
def q_rule_detectors(spark, sf_dir):
    rows = det.rule_scores(_cues(spark, sf_dir, RULE_INPUTS))
    return rows.select("vec_id", *[F.round(n, 6).alias(n) for n in det.DETAILS])


SCENE_SCALE = {"flux": 0.2, "loudness_std": 12.0, "tempo": 0.3, "modulation_peak": 0.4}


@query(f"""WITH {CUES}, q AS (SELECT vec_id, e[1] AS m48, e[2] * 0.3 AS tempo, e[3] * 0.4 AS mp, e[4] AS flat, e[5] AS harm, e[6] AS weak, e[7] * 0.2 AS flux, e[8] * 12 AS loud FROM c),
p AS (SELECT *, least(greatest((flat - 0.4) / 0.4, 0), 1) AS broad, least(flux / 0.15, 1) AS fs, CASE WHEN harm > 0.05 THEN least(weak * 1.5, 1) ELSE 0 END AS babble, 1 - least(mp * 3, 1) AS diffuse FROM q),
t AS (SELECT vec_id, least(greatest(0.5 * least(greatest((m48 - 0.3) / 0.2, 0), 1) + 0.3 * (1 - least(loud / 12, 1)) + 0.2 * least(greatest(1 - abs(flat - 0.3) / 0.3, 0), 1), 0), 1) AS tv,
least(greatest(0.5 * least(greatest((harm - 0.25) / 0.45, 0), 1) + 0.3 * least(tempo * 4, 1) + 0.2 * (1 - least(flat / 0.4, 1)), 0), 1) AS music,
least(greatest((0.4 * fs + 0.35 * babble + 0.25 * diffuse) * (1 - broad), 0), 1) AS crowd, least(greatest(0.45 * broad + 0.35 * (1 - least(loud / 6, 1)) + 0.2 * (1 - fs), 0), 1) AS noise FROM p)
SELECT vec_id, round(tv, 6) AS tv, round(music, 6) AS music, round(crowd, 6) AS crowd, round(noise, 6) AS noise, round(greatest(0.45 - 0.35 * greatest(tv, music, crowd), 0)::DOUBLE, 6) AS score FROM t""")
def q_scene_tags(spark, sf_dir):
    names = ["syllables", "tempo", "modulation_peak", "flatness", "periodic", "weakly_periodic", "flux", "loudness_std"]
    rows = sc.scene_tags(_cues(spark, sf_dir, names, SCENE_SCALE))
    return rows.select("vec_id", *[F.round(n, 6).alias(n) for n in ("tv", "music", "crowd", "noise", "score")])


@query(f"""WITH {CUES}, q AS (SELECT vec_id, e[1] * 0.01 AS lo, e[2] * 0.02 AS hi, e[3] * 20 AS tail, e[4] AS flat, e[5] AS st FROM c)
SELECT vec_id, round(least(greatest(0.4 * (0.7 * least(greatest(1 - hi / 0.01, 0), 1) + 0.3 * least(greatest(1 - lo / 0.005, 0), 1)) + 0.35 * least(greatest((tail - 3) / 7, 0), 1)
+ 0.25 * least(greatest((flat - 0.25) / 0.45, 0), 1) * (0.5 + 0.5 * st), 0), 1), 6) AS score FROM q""")
def q_replay_score(spark, sf_dir):
    rows = sc.replay_score(_cues(spark, sf_dir, sc.REPLAY_CUES, {"low_share": 0.01, "high_share": 0.02, "tail_frames": 20.0}))
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {CUES} SELECT vec_id, round(least(0.1 + CASE WHEN floor(e[1] * 3) >= 2 THEN 0.35 * e[2] ELSE 0 END + 0.3 * least(e[3] / 0.5, 1) + 0.25 * least(e[4] / 0.25, 1), 1)::DOUBLE, 6) AS score FROM c""")
def q_conversation_score(spark, sf_dir):
    rows = _cues(spark, sf_dir, ["voices", "stability", "coupling", "drift"])
    value = talk_score(F.floor(F.col("voices") * 3), F.col("stability"), F.col("coupling"), F.col("drift"))
    return rows.select("vec_id", F.round(value, 6).alias("score"))


@query(f"""WITH {CUES}, q AS (SELECT vec_id, round(e[1] * 0.1, 4) AS lo, round(e[2] * 0.1, 4) AS hi FROM c)
SELECT vec_id, CASE WHEN hi < 0.02 AND lo < 0.05 THEN 'telephony' WHEN hi < 0.08 THEN 'wideband' ELSE 'fullband' END AS bandwidth, CASE WHEN hi < 0.05 THEN 'narrowband' ELSE 'wideband' END AS channel FROM q""")
def q_bandwidth_class(spark, sf_dir):
    rows = _cues(spark, sf_dir, ["low", "high"], {"low": 0.1, "high": 0.1})
    return rows.select("vec_id", sc.bandwidth_class(F.col("low"), F.col("high")).alias("bandwidth"), sc.channel_class(F.round("high", 4)).alias("channel"))


# --- Scores with details, guardrails and verdicts --------------------------------

DETAILED = """ev AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS win_ix FROM events),
ws AS (SELECT user_id AS call_id, win_ix, event_id AS ord, CASE event_type WHEN 'click' THEN 'reverb' WHEN 'view' THEN 'cnn' WHEN 'purchase' THEN 'gbm' ELSE 'other' END AS name,
  value / (20 + value) AS score, CASE WHEN event_id % 7 = 0 THEN (value % 10) / 20 END AS rt60, event_id % 97 = 0 AS dead FROM ev),
u AS (SELECT user_id AS call_id, count(*) AS n, avg(value) AS v FROM events GROUP BY user_id),
f AS (SELECT call_id, (n % 10) / 20.0::DOUBLE AS channel, 1 + n % 2 AS clusters, CASE WHEN n % 5 > 0 THEN 0.5 + (n % 4) / 8.0 END AS stability, CASE WHEN n % 3 > 0 THEN (n % 6) / 10.0 END AS coupling,
  (n % 9) / 10.0 AS tv, (n % 8) / 10.0 AS crowd, (n % 20) / 20.0::DOUBLE AS noise FROM u)"""
FLAGS = DETAILED + """, rt AS (SELECT call_id, arg_min(rt60, (win_ix, ord)) AS rt60 FROM ws WHERE rt60 IS NOT NULL GROUP BY call_id),
rv AS (SELECT call_id, arg_min(score, (win_ix, ord)) AS reverb FROM ws WHERE name = 'reverb' GROUP BY call_id), dd AS (SELECT call_id, bool_or(dead) AS dead FROM ws GROUP BY call_id),
fl AS (SELECT f.call_id, coalesce(channel < 0.3 AND clusters = 1 AND coalesce(stability, 1) >= 0.7 AND CASE WHEN rt60 IS NOT NULL THEN rt60 < 0.3 ELSE reverb < 0.4 END, false) AS benign,
  (tv > 0.6 OR crowd > 0.6) AND coalesce(coupling, 1) < 0.2 AS background, dead OR noise > 0.7 AS suppressed
  FROM f LEFT JOIN rt USING (call_id) LEFT JOIN rv USING (call_id) LEFT JOIN dd USING (call_id))"""


def _detailed(spark, sf_dir):
    """Scores of windows and of calls with details, in place of detectors' own: from events, by fixed rules."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    events = src.table(spark, sf_dir, "events").withColumn("win_ix", F.floor((F.row_number().over(order) - 1) / 5))
    name = F.when(F.col("event_type") == "click", "reverb").when(F.col("event_type") == "view", "cnn").when(F.col("event_type") == "purchase", "gbm").otherwise("other")
    facts = {"rt60": F.when(F.col("event_id") % 7 == 0, F.col("value") % 10 / 20), "dead_floor": F.when(F.col("event_id") % 97 == 0, 1.0)}
    windows = events.select(F.col("user_id").alias("call_id"), "win_ix", F.col("event_id").alias("ord"), name.alias("name"), (F.col("value") / (20 + F.col("value"))).alias("score"), _map(facts))
    calls = events.groupBy(F.col("user_id").alias("call_id")).agg(F.count("*").alias("n"))
    n = F.col("n")
    talk = {"n_clusters": (1 + n % 2).cast("double"), "cluster_stability": F.when(n % 5 > 0, 0.5 + n % 4 / 8), "background_coupling": F.when(n % 3 > 0, n % 6 / 10)}
    scene = {"tv": n % 9 / 10, "crowd": n % 8 / 10, "noise": n % 20 / 20}
    parts = [("channel_switch", n % 10 / 20, {}), ("conversation_context", F.lit(0.1), talk), ("scene_context", F.lit(0.4), scene)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(k).alias("name"), s.cast("double").alias("score"), _map(d)) for i, (k, s, d) in enumerate(parts)]))
    call = calls.select("call_id", F.lit(None).cast("long").alias("win_ix"), rows.alias("r")).select("call_id", "win_ix", "r.*")
    return windows.unionByName(call)


def _map(facts):
    if not facts:
        return F.create_map().cast("map<string,double>").alias("details")
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in facts]), F.array(*[v.cast("double") for v in facts.values()]))
    return F.map_filter(full, lambda _, v: v.isNotNull()).alias("details")


@query(f"WITH {FLAGS} SELECT * FROM fl")
def q_guardrail_flags(spark, sf_dir):
    return gr.flags(_detailed(spark, sf_dir))


FUSED = FLAGS + """, cal(name, a, b) AS (VALUES ('reverb', 4.0::DOUBLE, -2.0::DOUBLE), ('cnn', 3.0, -1.0), ('gbm', 6.0, -3.0)), wt(name, w) AS (VALUES ('reverb', 0.3::DOUBLE), ('cnn', 0.35), ('gbm', 0.25), ('scene_context', 0.1)),
latest AS (SELECT call_id, win_ix, name, arg_max(score, ord) AS score FROM ws GROUP BY ALL),
p AS (SELECT call_id, win_ix, name, CASE WHEN a IS NOT NULL THEN 1 / (1 + exp(-(a * score + b))) ELSE least(greatest(score, 0), 1) END AS p FROM latest LEFT JOIN cal USING (name)
  UNION ALL SELECT w.call_id, w.win_ix, 'scene_context', 0.4 FROM (SELECT DISTINCT call_id, win_ix FROM ws) w),
fused AS (SELECT call_id, win_ix, sum(w * p) / sum(w) AS s FROM p JOIN wt USING (name) GROUP BY ALL),
g AS (SELECT call_id, win_ix, CASE WHEN background THEN greatest(0, s - 0.25) ELSE s END AS s, suppressed FROM fused JOIN fl USING (call_id)),
l AS (SELECT call_id, list(CASE WHEN suppressed THEN 0.5 + (s - 0.5) * 0.85 ELSE s END ORDER BY win_ix) AS s FROM g GROUP BY call_id),
e AS (SELECT call_id, list_reduce(s, lambda e, x: 0.4 * x + 0.6 * e) AS score FROM l),
v AS (SELECT call_id, score, benign, CASE WHEN score >= 0.8 - 1e-9 THEN 'RED' WHEN score < 0.35 - 1e-9 THEN 'GREEN' ELSE 'CHALLENGE' END AS state FROM e JOIN fl USING (call_id)),
k AS (SELECT call_id, score, CASE WHEN benign AND state = 'RED' THEN 'CHALLENGE' ELSE state END AS state FROM v)"""


def _bank(spark):
    names = {"click": "reverb", "view": "cnn", "purchase": "gbm"}
    return spark.createDataFrame([(names[n], a, b) for n, a, b in CALIBRATORS], "name string, a double, b double")


@query(f"""WITH {FUSED} SELECT call_id, state, round(score, 6) AS score,
round(least(greatest(CASE state WHEN 'RED' THEN score WHEN 'GREEN' THEN 1 - score ELSE 0.5 + least(score - 0.35, 0.8 - score) / (0.8 - 0.35) END, 0), 1), 6) AS confidence FROM k""")
def q_guarded_verdict(spark, sf_dir):
    rows = vd.fuse(_detailed(spark, sf_dir), _bank(spark), spark.createDataFrame(WEIGHTS, "name string, w double"), GREEN, RED)
    return rows.select("call_id", "state", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


# --- Reports -----------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT p.lang, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 9) AS auc FROM lab p JOIN lab n ON p.lang = n.lang WHERE p.y = 1 AND n.y = 0 GROUP BY p.lang")
def q_auc_pairwise(spark, sf_dir):
    return me.auc(src.labelled(spark, sf_dir), ["lang"]).filter("auc is not null").select("lang", F.round("auc", 9).alias("auc"))


AT = """t(target) AS (VALUES (0.01::DOUBLE), (0.02), (0.05)), h AS (SELECT target, arg_max(tpr, (fps, tps)) AS hit, arg_max(threshold, (fps, tps)) AS threshold FROM t JOIN rt ON fpr <= target + 1e-12 GROUP BY target)"""


@query(f"WITH {ROC}, {AT} SELECT target, round(threshold, 9) AS threshold FROM h")
def q_thr_at_fpr(spark, sf_dir):
    return me.at_fpr(me.roc(src.labelled(spark, sf_dir)), [0.01, 0.02, 0.05]).select("target", F.round("threshold", 9).alias("threshold"))


@query(f"""WITH {ROC}, {AT}, a AS (SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc FROM lab p, lab n WHERE p.y = 1 AND n.y = 0),
dd AS (SELECT *, fpr - (1 - tpr) AS d, row_number() OVER (ORDER BY fps, tps) AS ix FROM rt), l AS (SELECT *, lag(d) OVER (ORDER BY ix) AS d0, lag(fpr) OVER (ORDER BY ix) AS f0 FROM dd),
q AS (SELECT CASE WHEN d0 * d < 0 THEN f0 + (fpr - f0) * (-d0) / (d - d0) ELSE (fpr + 1 - tpr) / 2 END AS eer FROM l ORDER BY round(abs(d), 12), ix LIMIT 1)
SELECT (SELECT count(*) FROM lab) AS n, round((SELECT auc FROM a), 8) AS auc, round((SELECT eer FROM q), 8) AS eer, round(max(hit) FILTER (WHERE target = 0.01), 8) AS hit_at_fpr_1,
round(max(hit) FILTER (WHERE target = 0.02), 8) AS hit_at_fpr_2, round(max(hit) FILTER (WHERE target = 0.05), 8) AS hit_at_fpr_5 FROM h""")
def q_metrics(spark, sf_dir):
    rows = me.compute(src.labelled(spark, sf_dir))
    return rows.select("n", *[F.round(c, 8).alias(c) for c in rows.columns[1:]])


@query(f"""WITH {ROC}, {AT}, x AS (SELECT y, score, unnest([{{'dim': 'lang', 'slice': lang}}, {{'dim': 'source', 'slice': source}}]) AS s FROM lab), th AS (SELECT threshold FROM h WHERE target = 0.02),
b AS (SELECT s.dim AS dim, s.slice AS slice, count(*) AS n, sum(y)::BIGINT AS n_relay, avg((score >= threshold)::INT) FILTER (WHERE y = 1) AS recall, avg((score >= threshold)::INT) FILTER (WHERE y = 0) AS fpr FROM x, th GROUP BY ALL),
a AS (SELECT s.dim AS dim, s.slice AS slice, avg(CASE WHEN p.score > x.score THEN 1.0 WHEN p.score = x.score THEN 0.5 ELSE 0 END) AS auc FROM x, lab p WHERE x.y = 0 AND p.y = 1 GROUP BY ALL)
SELECT dim, slice, n, n_relay, round(recall, 8) AS recall, round(fpr, 8) AS fpr, round(auc, 8) AS auc_vs_relay FROM b LEFT JOIN a USING (dim, slice)""")
def q_slice_report(spark, sf_dir):
    rows = src.labelled(spark, sf_dir)
    limit = me.at_fpr(me.roc(rows), [0.02]).first()["threshold"]
    table = me.slice_table(rows, ["lang", "source"], F.lit(limit))
    return table.select("dim", "slice", "n", "n_relay", *[F.round(c, 8).alias(c) for c in ("recall", "fpr", "auc_vs_relay")])


#: Windows of two detectors over labelled documents: three windows each, the second detector misses some documents.
WINDOWED = LABELLED + """, w AS (SELECT doc_id::VARCHAR AS file, CASE y WHEN 1 THEN 'relay' ELSE 'direct' END AS label, k.range AS win_ix, name, (score + (k.range * 7 + doc_id % 13) % 10 / 20.0::DOUBLE) / 1.5 AS score
  FROM lab, range(3) k, (VALUES ('cnn'), ('gbm')) d(name) WHERE name = 'cnn' OR doc_id % 5 > 0)"""


def _windowed(spark, sf_dir):
    rows = src.labelled(spark, sf_dir)
    names = F.when(F.col("doc_id") % 5 > 0, F.array(F.lit("cnn"), F.lit("gbm"))).otherwise(F.array(F.lit("cnn")))
    wide = rows.select(F.col("doc_id").cast("string").alias("file"), F.when(F.col("y") == 1, "relay").otherwise("direct").alias("label"), "doc_id", "score", F.explode(names).alias("name"))
    wide = wide.withColumn("win_ix", F.explode(F.sequence(F.lit(0), F.lit(2))))
    moved = (F.col("score") + (F.col("win_ix") * 7 + F.col("doc_id") % 13) % 10 / 20) / 1.5
    return wide.select("file", "label", "win_ix", "name", moved.alias("score"))


@query(f"""WITH {WINDOWED}, m AS (SELECT file, name, avg(score) AS score FROM w GROUP BY ALL)
SELECT file, name, round(score, 8) AS score FROM m UNION ALL SELECT file, 'cnn_gbm_avg', round(avg(score), 8) FROM m GROUP BY file HAVING count(*) = 2""")
def q_sample_scores(spark, sf_dir):
    return ev.sample_scores(_windowed(spark, sf_dir)).withColumn("score", F.round("score", 8))


@query(f"""WITH {WINDOWED}, e AS (SELECT file, win_ix, sum(CASE name WHEN 'cnn' THEN 0.35 ELSE 0.25 END * score) / 0.6 AS s FROM w GROUP BY ALL) SELECT file, round(avg(s), 8) AS score FROM e GROUP BY file""")
def q_fused_samples(spark, sf_dir):
    return ev.fused_scores(_windowed(spark, sf_dir)).withColumn("score", F.round("score", 8))


@query(f"""WITH {WINDOWED}, m AS (SELECT file, name, any_value(label) AS label, avg(score) AS score FROM w GROUP BY ALL),
b AS (SELECT file, name, label, score FROM m UNION ALL SELECT file, 'cnn_gbm_avg', any_value(label), avg(score) FROM m GROUP BY file HAVING count(*) = 2)
SELECT p.name, round(avg(CASE WHEN p.score > n.score + 1e-12 THEN 1.0 WHEN abs(p.score - n.score) <= 1e-12 THEN 0.5 ELSE 0 END), 3) AS auc FROM b p JOIN b n ON p.name = n.name WHERE p.label = 'relay' AND n.label = 'direct' GROUP BY p.name""")
def q_sample_auc(spark, sf_dir):
    rows = _windowed(spark, sf_dir)
    return ev.sample_auc(rows, rows.select("file", "label").distinct()).select("name", F.round("auc", 3).alias("auc"))


@query(f"""WITH {WINDOWED}, a AS (SELECT n.name, n.label, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc FROM w n JOIN w p ON p.name = n.name WHERE n.label = 'direct' AND p.label = 'relay' GROUP BY ALL)
SELECT name, label, count(*) AS n_windows, round(avg(score), 8) AS mean_score, round(any_value(auc), 4) AS auc_vs_relay FROM w LEFT JOIN a USING (name, label) GROUP BY ALL""")
def q_class_report(spark, sf_dir):
    rows = _windowed(spark, sf_dir)
    found = ev.class_report(rows.drop("label"), rows.select("file", "label").distinct())
    return found.select("name", "label", "n_windows", F.round("mean_score", 8).alias("mean_score"), F.round("auc_vs_relay", 4).alias("auc_vs_relay"))


@query(f"""WITH {LABELLED}, r AS (SELECT CASE y WHEN 1 THEN 'relay' ELSE 'normal' END AS label, ((score >= 0.5)::INT = y)::INT AS right FROM lab)
SELECT coalesce(label, 'overall') AS label, count(*) AS n, round(avg("right"), 4) AS accuracy FROM r GROUP BY ROLLUP (label)""")
def q_label_report(spark, sf_dir):
    rows = src.labelled(spark, sf_dir).withColumn("label", F.when(F.col("y") == 1, "relay").otherwise("normal"))
    return ev.label_accuracy(rows)


@query("SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic")
def q_label_counts(spark, sf_dir):
    return src.table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT greatest(sum(1 - quality) / greatest(sum(quality), 1), 0.001)::DOUBLE AS pos_weight FROM labels")
def q_pos_weight(spark, sf_dir):
    return spark.createDataFrame([(le.positive_weight(src.table(spark, sf_dir, "labels").select(F.col("quality").alias("y"))),)], "pos_weight double")


# --- Samples and plans -------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 11 = 0 THEN 'other' WHEN toxic = 1 THEN 'relay' ELSE 'normal' END AS label, n_chars / 10.0::DOUBLE AS d FROM labels JOIN documents USING (doc_id))
SELECT id, CASE WHEN label = 'other' THEN 'label' WHEN d < 2 THEN 'too short' WHEN d > 120 THEN 'too long' ELSE 'accepted' END AS outcome FROM s""")
def q_upload_checks(spark, sf_dir):
    rows = src.table(spark, sf_dir, "labels").join(src.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    label = F.when(F.col("doc_id") % 11 == 0, "other").when(F.col("toxic") == 1, "relay").otherwise("normal")
    good, bad = rec.check_samples(rows.select(F.col("doc_id").cast("string").alias("id"), label.alias("label"), (F.col("n_chars") / 10).alias("duration_s")))
    return good.select("id", F.lit("accepted").alias("outcome")).unionByName(bad.select("id", F.col("reason").alias("outcome")))


@query("""WITH s AS (SELECT *, CASE WHEN (SELECT bool_or(lang = 'test') FROM documents) THEN lang = 'test' ELSE true END AS k FROM documents) SELECT doc_id FROM s WHERE k""")
def q_default_split(spark, sf_dir):
    return ev.evaluated_split(src.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"))).select("doc_id")


@query("""SELECT doc_id, k.range AS win, (lang = 'en')::INT AS y FROM documents, range(3) k WHERE source = 'src_1' OR source IS NULL""")
def q_window_index(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("file"), F.when(F.col("lang") == "en", "relay").otherwise(F.col("lang")).alias("label"), F.when((F.col("source") == "src_1") | F.col("source").isNull(), "train").otherwise("dev").alias("split"))
    return le.window_index(rows, "train").select(F.col("file").alias("doc_id"), F.col("win").cast("long").alias("win"), "y")


@query("""WITH s AS (SELECT source, list_extract(string_split(source, '_'), -1) AS factor FROM documents)
SELECT source, round(coalesce(CASE WHEN source = 'src_1' THEN 2.0 WHEN source = 'src_2' THEN 1.5 END, 1.0)::DOUBLE, 4) AS factor, count(*) AS n FROM s GROUP BY ALL""")
def q_boost_factors(spark, sf_dir):
    docs = src.table(spark, sf_dir, "documents").select("source", rec.boost_column(F.lit("src_1:2,src_2:1.5"), F.col("source")).alias("factor"))
    return docs.groupBy("source", F.round("factor", 4).alias("factor")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT page_id, string_split(url, '/') AS p FROM pages), s AS (SELECT page_id, p[len(p) - 2] AS speaker FROM u WHERE len(p) >= 3) SELECT speaker, count(*) AS files FROM s GROUP BY speaker""")
def q_scan_speakers(spark, sf_dir):
    rows = files.speakers(src.table(spark, sf_dir, "pages").select(F.col("url").alias("file")))
    return rows.select("speaker", F.size("files").cast("long").alias("files"))


SEED = "(('0x' || substr(md5({0}), 1, 8))::BIGINT)"


@query(f"""WITH p AS (SELECT label, i, {SEED.format("'3:' || label || ':' || i::VARCHAR")} AS seed FROM (VALUES ('relay'), ('direct'), ('hardneg_tv')) l(label), range(40) r(i) WHERE i % 2 = 1)
SELECT label || '/' || lpad(i::VARCHAR, 6, '0') || '.wav' AS file, label, i, CASE WHEN i % 10 < 8 THEN 'train' WHEN i % 10 = 8 THEN 'dev' ELSE 'test' END AS split, seed FROM p""")
def q_dataset_plan(spark, sf_dir):
    who = src.table(spark, sf_dir, "customer").select(F.concat(F.lit("spk"), F.col("c_custkey").cast("string")).alias("speaker"), F.array(F.concat(F.col("c_name"), F.lit(".wav"))).alias("files"))
    speakers = who.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.crc32(F.col("speaker").cast("binary")) % 3 + 1).cast("int")))
    return dg.plan(speakers, 40, 3, ["relay", "direct", "hardneg_tv"], 1, 2).select("file", "label", "i", "split", "seed")


@query("""WITH p AS (SELECT DISTINCT l_linestatus AS codec1, l_returnflag AS codec2 FROM lineitem), h AS (SELECT * FROM p ORDER BY md5('5:' || codec1 || ':' || codec2), 1, 2 LIMIT 1)
SELECT l_linestatus AS codec1, l_returnflag AS codec2, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM h WHERE codec1 = l_linestatus AND codec2 = l_returnflag) GROUP BY ALL""")
def q_codec_pairs(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("codec1"), F.col("l_returnflag").alias("codec2"))
    counts = rows.groupBy("codec1", "codec2").agg(F.count("*").alias("n"))
    return counts.join(dg.held_out(counts.select("codec1", "codec2"), 1, 5), ["codec1", "codec2"], "left_anti")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) SELECT doc_id, source, r FROM r""")
def q_hash_rank(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents").select("doc_id", "source")
    return ranked.hash_rank(rows, ["source"], F.col("doc_id").cast("string"), "doc_id").select("doc_id", "source", "r")


@query(f"""WITH n AS (SELECT count(*) FILTER (WHERE lang = 'en') AS n FROM documents)
SELECT doc_id, unnest(CASE WHEN (SELECT n FROM n) >= 200 THEN CASE WHEN lang = 'en' THEN [CASE WHEN {SEED.format("'half:' || doc_id::VARCHAR")} % 2 = 0 THEN 'direct' ELSE 'relay' END] ELSE [] END
WHEN lang = 'en' THEN ['direct', 'relay'] ELSE ['relay'] END) AS role FROM documents""")
def q_protocol_roles(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), F.when(F.col("lang") == "en", "narrowband").otherwise("wideband").alias("channel"))
    return dg.protocol(rows, 100).select(F.col("call_id").alias("doc_id"), "role")
