"""Queries over calls and turns: masks, holds, voices, rates, scenes, analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callgrain import service
from callgrain.operators import calls as ca
from callgrain.operators import changepoint as cp
from callgrain.operators import conversation as talk
from callgrain.operators import channel as ch
from callgrain.operators import datagen as dg
from callgrain.operators import scenes as sc
from callgrain.operators import segments as seg
from callgrain.operators import windows as win
from callgrain.operators.ranked import quantiles
from callgrain.plans.registry import query
from callgrain.plans.signal import SIG, levels
from callgrain.sources import audio as files
from callgrain.sources import tables as src
from callgrain.sources.stores import kept

FRAMES = SIG + ", fr AS (SELECT call_id, i, x AS rms_db, (i % 8) / 10.0::DOUBLE AS flatness, (i % 11) / 20.0::DOUBLE AS zcr FROM sig)"


def _frames(spark, sf_dir):
    rows = src.signal(spark, sf_dir)
    return rows.select("call_id", "i", F.col("x").alias("rms_db"), (F.col("i") % 8 / 10).alias("flatness"), (F.col("i") % 11 / 20).alias("zcr"))


@query(f"""WITH {FRAMES} SELECT call_id, i, rms_db > quantile_cont(rms_db, 0.2) OVER (PARTITION BY call_id) + 10 AND flatness < 0.5 AND zcr BETWEEN 0.005 AND 0.45 AS speech FROM fr""")
def q_speech_mask(spark, sf_dir):
    return seg.speech_mask(_frames(spark, sf_dir)).select("call_id", F.col("i").cast("long"), "speech")


@query(f"""WITH {SIG}, m AS (SELECT call_id, i, x > 90 + call_id % 20 AS a, x > 30 AS b FROM sig) SELECT call_id, i, CASE WHEN bool_or(a) OVER (PARTITION BY call_id) THEN a ELSE b END AS speech FROM m""")
def q_chosen_mask(spark, sf_dir):
    rows = src.signal(spark, sf_dir)
    mask = lambda limit: rows.select("call_id", "i", (F.col("x") > limit).alias("speech"))
    return seg.chosen_mask(mask(90 + F.col("call_id") % 20), mask(F.lit(30))).select("call_id", F.col("i").cast("long"), "speech")


@query(f"WITH {SIG} SELECT call_id, i * 4 + k.range AS i, x > 40 AS speech FROM sig, range(4) k")
def q_sample_mask(spark, sf_dir):
    rows = src.signal(spark, sf_dir).withColumn("speech", F.col("x") > 40)
    return seg.to_samples(rows, 4).select("call_id", F.col("i").cast("long"), "speech")


@query(f"""WITH {SIG}, s AS (SELECT call_id, i // 10 AS s, avg(x) AS m FROM sig GROUP BY ALL) SELECT sig.call_id, i, round(x, 6) AS x, round(m, 6) AS held FROM sig JOIN s ON s.call_id = sig.call_id AND s.s = i // 10""")
def q_rms_hold(spark, sf_dir):
    rows = src.signal(spark, sf_dir)
    vectors = rows.groupBy("call_id", F.floor(F.col("i") / 10).alias("s")).agg(F.avg("x").alias("held"))
    held = win.held(rows, vectors, 10)
    return held.select("call_id", F.col("i").cast("long"), F.round("x", 6).alias("x"), F.round("held", 6).alias("held"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding[13:52], lambda x: x::DOUBLE)), 6) AS middle, round(list_sum(list_transform(embedding[1:40], lambda x: x::DOUBLE)), 6) AS first,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + list_sum(list_transform(embedding[1:36], lambda x: x::DOUBLE)), 6) AS looped FROM embeddings""")
def q_fit_length(spark, sf_dir):
    rows = src.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return rows.select("vec_id", total(win.centred(F.col("x"), 40)).alias("middle"), total(win.fitted(F.col("x"), 40)).alias("first"), total(win.looped(F.col("x"), 100)).alias("looped"))


@query("""WITH s AS (SELECT vec_id, embedding, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 45 AS first FROM embeddings) SELECT vec_id, first, round(list_sum(list_transform(embedding[first + 1 : first + 20], lambda x: x::DOUBLE)), 6) AS total FROM s""")
def q_slice_by_hash(spark, sf_dir):
    rows = src.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    key = F.col("vec_id").cast("string")
    return rows.select("vec_id", dg.pick(key, 45).cast("long").alias("first"), F.round(F.aggregate(dg.sliced(F.col("x"), 20, key), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH {SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY x, i) AS r, count(*) OVER (PARTITION BY call_id) AS n FROM sig)
SELECT call_id, i, round(x, 6) AS x FROM r WHERE r <= greatest(2, floor(0.2 * n))""")
def q_quiet_frames(spark, sf_dir):
    own = Window.partitionBy("call_id")
    rows = src.signal(spark, sf_dir).withColumn("r", F.row_number().over(own.orderBy("x", "i"))).withColumn("n", F.count("*").over(own))
    return rows.filter(F.col("r") <= F.greatest(F.lit(2), F.floor(0.2 * F.col("n")))).select("call_id", F.col("i").cast("long"), F.round("x", 6).alias("x"))


@query(f"""WITH {SIG}, d AS (SELECT call_id, x - lag(x) OVER w AS d, x > 40 AS on_, lead(x > 40) OVER w AS nxt FROM sig WINDOW w AS (PARTITION BY call_id ORDER BY i))
SELECT call_id, count(*) FILTER (WHERE d < -8) AS drops, count(*) FILTER (WHERE on_ AND NOT nxt) AS offsets, round(count(*) FILTER (WHERE d < -8) / (count(*) FILTER (WHERE on_ AND NOT nxt) + 1.0::DOUBLE) / 2, 6) AS rate FROM d GROUP BY call_id""")
def q_drops_offsets(spark, sf_dir):
    w = Window.partitionBy("call_id").orderBy("i")
    rows = src.signal(spark, sf_dir).withColumn("d", F.col("x") - F.lag("x").over(w)).withColumn("on", F.col("x") > 40).withColumn("next", F.lead(F.col("x") > 40).over(w))
    drops, offsets = F.count_if(F.col("d") < -8), F.count_if(F.col("on") & ~F.col("next"))
    return rows.groupBy("call_id").agg(drops.alias("drops"), offsets.alias("offsets"), F.round(drops / (offsets + 1) / 2, 6).alias("rate"))


def _turns(spark, sf_dir):
    rows = src.spectrum_input(spark, sf_dir)
    return rows.select(F.floor(F.col("vec_id") / 25).alias("call_id"), F.col("vec_id").alias("turn_ix"), F.col("label").alias("cluster"), "frame")


@query("""WITH t AS (SELECT vec_id // 25 AS call_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT call_id, label, count(*) AS k FROM t GROUP BY ALL), n AS (SELECT call_id, sum(k) AS n, count(*) AS raw FROM k GROUP BY call_id),
s AS (SELECT call_id, label FROM k JOIN n USING (call_id) WHERE n = 1 OR k >= greatest(2, ceil(0.2 * n))),
m AS (SELECT call_id, label, pos, avg(e[pos]) AS x FROM t JOIN s USING (call_id, label), range(1, 65) r(pos) GROUP BY ALL), c AS (SELECT call_id, label, list(x ORDER BY pos) AS c FROM m GROUP BY ALL),
v AS (SELECT call_id, label, avg(list_cosine_similarity(e, c)) AS v FROM t JOIN c USING (call_id, label) GROUP BY ALL), w AS (SELECT call_id, count(*) AS stable, avg(v) AS v FROM v GROUP BY call_id)
SELECT call_id, n::BIGINT AS turns, raw AS n_clusters_raw, coalesce(stable, 0) AS n_clusters, round(coalesce(v, 0), 6) AS cluster_stability FROM n LEFT JOIN w USING (call_id)""")
def q_voices(spark, sf_dir):
    rows = talk.voices(_turns(spark, sf_dir))
    return rows.select("call_id", "turns", "n_clusters_raw", "n_clusters", F.round("cluster_stability", 6).alias("cluster_stability"))


@query("""WITH r AS (SELECT conv_id AS call_id, CASE WHEN turn % 4 > 0 THEN length(text) / 50.0::DOUBLE END AS rate FROM conversations), s AS (SELECT call_id, count(rate) AS n, avg(rate) AS m, stddev_pop(rate) AS s FROM r GROUP BY call_id)
SELECT call_id, round(CASE WHEN n < 2 OR m <= 1e-6 THEN 1.0 ELSE least(greatest(1 - s / m, 0), 1) END::DOUBLE, 6) AS stability FROM s""")
def q_rate_stability(spark, sf_dir):
    rows = src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.when(F.col("turn") % 4 > 0, F.char_length("text") / 50).alias("rate"))
    return talk.rate_stability(rows).select("call_id", F.round("stability", 6).alias("stability"))


@query("""WITH s AS (SELECT label AS call_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS e FROM embeddings), d AS (SELECT call_id, i, r.range AS dim, e[r.range + 1]::DOUBLE AS x FROM s, range(4) r),
b AS (SELECT call_id, i, 20 * ln(var_pop(x) OVER w2 + 1e-8) - 10 * (ln(var_pop(x) OVER w0 + 1e-8) + ln(var_pop(x) OVER w1 + 1e-8)) AS bic, count(*) OVER w2 AS n FROM d
  WINDOW w0 AS (PARTITION BY call_id, dim ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w1 AS (PARTITION BY call_id, dim ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), w2 AS (PARTITION BY call_id, dim ORDER BY i ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
SELECT call_id, i, round(sum(bic), 5) AS bic FROM b WHERE n = 20 AND (i - 10) % 5 = 0 GROUP BY call_id, i""")
def q_delta_bic_dims(spark, sf_dir):
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = src.table(spark, sf_dir, "embeddings").withColumn("i", F.row_number().over(order) - 1)
    rows = rows.select(F.col("label").alias("call_id"), "i", F.posexplode(F.slice("embedding", 1, 4)).alias("dim", "x"))
    found = cp.delta_bic(rows.withColumn("x", F.col("x").cast("double")), 10, 5)
    return found.select("call_id", F.col("i").cast("long"), F.round("bic", 5).alias("bic"))


LEVELS = SIG + ", f AS (SELECT call_id, i // 5 AS f, 20 * log10(sqrt(avg(x * x))) AS db, max(x) / sqrt(avg(x * x)) AS crest FROM sig GROUP BY ALL), q AS (SELECT call_id, quantile_cont(db, 0.95) AS hi, quantile_cont(db, 0.05) AS lo FROM f GROUP BY call_id)"


def _levels(spark, sf_dir):
    return levels(src.signal(spark, sf_dir))


@query(f"WITH {LEVELS} SELECT call_id, round(avg(crest), 5) AS crest FROM f GROUP BY call_id")
def q_crest(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy("call_id").agg(F.round(F.avg("crest"), 5).alias("crest"))


@query(f"WITH {LEVELS} SELECT call_id, round(hi - lo, 5) AS dyn_range FROM q")
def q_dyn_range(spark, sf_dir):
    rows = quantiles(_levels(spark, sf_dir), "db", {"hi": 0.95, "lo": 0.05})
    return rows.groupBy("call_id").agg(F.round(F.first(F.col("hi") - F.col("lo")), 5).alias("dyn_range"))


@query(f"WITH {LEVELS} SELECT call_id, round(avg((db >= hi - 1.5)::INT), 6) AS plateau FROM f JOIN q USING (call_id) GROUP BY call_id")
def q_plateau(spark, sf_dir):
    return quantiles(_levels(spark, sf_dir), "db", {"hi": 0.95}).groupBy("call_id").agg(F.round(F.avg((F.col("db") >= F.col("hi") - 1.5).cast("int")), 6).alias("plateau"))


@query(f"WITH {SIG}, d AS (SELECT call_id, abs(x - lag(x) OVER (PARTITION BY call_id ORDER BY i)) AS d FROM sig) SELECT call_id, round(avg(d), 5) AS flux FROM d GROUP BY call_id HAVING count(d) > 0")
def q_flux(spark, sf_dir):
    d = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("call_id").orderBy("i")))
    return src.signal(spark, sf_dir).select("call_id", d.alias("d")).filter("d is not null").groupBy("call_id").agg(F.round(F.avg("d"), 5).alias("flux"))


@query(f"WITH {SIG}, d AS (SELECT call_id, (sign(x - 50) <> lag(sign(x - 50)) OVER (PARTITION BY call_id ORDER BY i))::INT AS c FROM sig) SELECT call_id, round(avg(c), 6) AS zcr FROM d GROUP BY call_id HAVING count(c) > 0")
def q_zcr(spark, sf_dir):
    now = F.signum(F.col("x") - 50)
    rows = src.signal(spark, sf_dir).select("call_id", (now != F.lag(now).over(Window.partitionBy("call_id").orderBy("i"))).cast("int").alias("c"))
    return rows.filter("c is not null").groupBy("call_id").agg(F.round(F.avg("c"), 6).alias("zcr"))


# --- From samples: kernels, whose values the tests hold -----------------------------


@query()
def q_mel(spark, sf_dir):
    """Mel vectors of each 10 ms."""
    return ca.tracks(src.calls(spark, sf_dir)).filter("mel is not null").select("call_id", "k", "mel")


@query()
def q_f0(spark, sf_dir):
    """The median pitch of each call's frames."""
    track = ca.tracks(src.calls(spark, sf_dir)).filter("not isnan(f0) and k % 2 = 0")
    return track.groupBy("call_id").agg(F.median("f0").alias("f0"))


@query()
def q_turns(spark, sf_dir):
    track = ca.tracks(src.calls(spark, sf_dir))
    return ca.described(track, ca.turns(track)).select("call_id", "turn_ix", "start_s", "end_s", "rms_db", "mean_f0", "rate")


@query()
def q_conversation(spark, sf_dir):
    return talk.analyze(src.calls(spark, sf_dir), kept)


@query()
def q_scenes(spark, sf_dir):
    return sc.scenes(src.calls(spark, sf_dir))


@query()
def q_replays(spark, sf_dir):
    return sc.replays(src.calls(spark, sf_dir))


@query()
def q_quality(spark, sf_dir):
    return sc.quality(src.calls(spark, sf_dir))


@query()
def q_analyze(spark, sf_dir):
    """From samples to verdicts: features, rules, conversation, channel, scene and replay, fused."""
    return service.analyze(src.calls(spark, sf_dir))


@query()
def q_wav_round_trip(spark, sf_dir):
    """Calls as WAV bytes and back: (call_id, n, far), the largest difference of a sample."""
    rows = files.decoded(files.encoded(src.calls(spark, sf_dir).withColumnRenamed("samples", "x").withColumn("samples", F.col("x"))).drop("samples"))
    far = F.array_max(F.zip_with("x", "samples", lambda a, b: F.abs(a - b)))
    return rows.select("call_id", F.size("samples").cast("long").alias("n"), far.alias("far"))




@query()
def q_channel_switches(spark, sf_dir):
    """Where the channel of the stand-in calls switches: (call_id, n, stability, score, times, strengths)."""
    found = ch.switches(src.calls(spark, sf_dir))
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 3)).alias(c)
    return found.select("call_id", "n", F.round("stability", 6).alias("stability"), F.round("score", 6).alias("score"), rounded("times"), rounded("strengths"))
