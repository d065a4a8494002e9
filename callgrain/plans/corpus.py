"""Queries over sample tables: splits, plans, quality control, voiceprints, challenges."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.operators import biometrics as bio
from callgrain.operators import conversation as talk
from callgrain.operators import splits as sl
from callgrain.plans.registry import query
from callgrain.sources import tables as src

def _mod(key: str) -> str:
    part = lambda at: f"(('0x' || substr(md5({key}), {at}, 8))::BIGINT % 100)"
    return f"(((({part(1)} * 96 + {part(9)}) % 100) * 16 + ({part(17)} * 96 + {part(25)}) % 100) % 100)"


def _docs(spark, sf_dir):
    return src.table(spark, sf_dir, "documents")


def _key():
    return F.col("doc_id").cast("string")


@query(f"SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, {_mod('doc_id::VARCHAR')} AS b FROM documents)")
def q_md5_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sl.speaker_split(_key()).alias("split"))


@query(f"""SELECT doc_id, CASE WHEN {_mod("'test:' || doc_id::VARCHAR")} < 15 THEN 'test' WHEN {_mod("'dev:' || doc_id::VARCHAR")} < 10 THEN 'dev' ELSE 'train' END AS split FROM documents""")
def q_two_level_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sl.two_level_split(_key()).alias("split"))


@query("SELECT doc_id % 4 AS shard, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def q_shard(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy((F.col("doc_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS seed FROM documents")
def q_sample_seed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sl.sample_seed(_key()).alias("seed"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_anti(spark, sf_dir):
    return sl.remaining(_docs(spark, sf_dir).select("doc_id"), src.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def q_semi_existing(spark, sf_dir):
    return sl.existing(_docs(spark, sf_dir).select("doc_id", "lang"), src.table(spark, sf_dir, "labels").filter("toxic = 0"), "doc_id")


@query("WITH s AS (SELECT DISTINCT source FROM documents), h AS (SELECT source FROM s ORDER BY md5(source), source LIMIT 2) SELECT source FROM s WHERE source NOT IN (SELECT source FROM h)")
def q_holdout_except(spark, sf_dir):
    sources = _docs(spark, sf_dir).select("source").distinct()
    return sources.exceptAll(sl.hash_limit(sources, F.col("source"), 2))


@query("""WITH g AS (SELECT source, coalesce(lead(source) OVER (ORDER BY source), first_value(source) OVER (ORDER BY source)) AS nxt FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT a.doc_id, b.doc_id AS partner_id, b.source AS partner_group FROM r a JOIN g ON a.source = g.source JOIN s ON s.source = g.nxt JOIN r b ON b.source = g.nxt AND b.r = a.r % s.n WHERE a.source <> b.source""")
def q_other_speaker(spark, sf_dir):
    return sl.other_group(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", "source")


@query("""WITH n AS (SELECT count(*) FILTER (WHERE lang = 'en') AS wide FROM documents)
SELECT doc_id, lang, CASE WHEN (SELECT wide FROM n) >= 400 THEN 'disjoint' ELSE 'paired' END AS protocol FROM documents WHERE (SELECT wide FROM n) < 400 OR lang = 'en'""")
def q_disjoint_or_paired(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "lang")
    wide = rows.agg(F.count_if(F.col("lang") == "en").alias("wide"))
    both = rows.crossJoin(F.broadcast(wide))  # one row
    return both.filter("wide < 400 or lang = 'en'").select("doc_id", "lang", F.when(F.col("wide") >= 400, "disjoint").otherwise("paired").alias("protocol"))


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, CASE WHEN n < 10 THEN 'in-sample' WHEN r <= greatest(1, round(0.7 * n)) THEN 'train' ELSE 'holdout' END AS part FROM r""")
def q_user_split(spark, sf_dir):
    return sl.seventy_thirty(src.table(spark, sf_dir, "labels").select("doc_id", "quality"), ["quality"], _key(), "doc_id").select("doc_id", "part")


@query("""WITH u AS (SELECT doc_id FROM labels WHERE toxic = 1), a AS (SELECT doc_id FROM labels WHERE toxic = 0 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100)
SELECT doc_id, 'user' AS origin FROM u UNION ALL SELECT doc_id, 'anchor' FROM a""")
def q_window_cap(spark, sf_dir):
    rows = src.table(spark, sf_dir, "labels")
    user = rows.filter("toxic = 1").select("doc_id", F.lit("user").alias("origin"))
    return user.unionByName(sl.hash_limit(rows.filter("toxic = 0").select("doc_id"), _key(), 100).withColumn("origin", F.lit("anchor")))


@query("""WITH q AS (SELECT doc_id, length(text) / 100.0 AS d, len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1)::DOUBLE AS digits FROM documents)
SELECT doc_id, round(d, 2)::DOUBLE AS duration_s, d BETWEEN 2 AND 120 AS accepted,
array_to_string(list_filter([CASE WHEN d < 2 THEN 'too short' END, CASE WHEN d > 120 THEN 'too long' END, CASE WHEN digits > 0.02 THEN 'many digits' END], lambda x: x IS NOT NULL), ';') AS warnings FROM q""")
def q_qc(spark, sf_dir):
    n = F.char_length("text")
    d, digits = n / F.lit(100.0), F.regexp_count("text", F.lit("[0-9]")) / F.greatest(n, F.lit(1))
    warnings = F.array(F.when(d < 2, "too short"), F.when(d > 120, "too long"), F.when(digits > 0.02, "many digits"))
    return _docs(spark, sf_dir).select("doc_id", F.round(d, 2).alias("duration_s"), d.between(2, 120).alias("accepted"), F.concat_ws(";", F.filter(warnings, lambda w: w.isNotNull())).alias("warnings"))


@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) AS other FROM documents GROUP BY source")
def q_source_pivot(spark, sf_dir):
    shown = ["de", "en", "es", "fr"]
    lang = F.when(F.col("lang").isin(*shown), F.col("lang")).otherwise("other")
    return _docs(spark, sf_dir).select("source", lang.alias("lang")).groupBy("source").pivot("lang", [*shown, "other"]).count().na.fill(0, [*shown, "other"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
def q_list_newest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(50)


CENTRE = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
m AS (SELECT label, pos, avg(v[pos]) AS x FROM u, range(1, 65) r(pos) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS s FROM m GROUP BY label)"""


@query(f"WITH {CENTRE} SELECT label, pos - 1 AS pos, round(x / s, 6) AS x FROM m JOIN n USING (label)")
def q_enroll_centroid(spark, sf_dir):
    rows = bio.enroll(src.spectrum_input(spark, sf_dir), "label").select("label", F.posexplode("centre").alias("pos", "x"))
    return rows.select("label", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


def _cosines(spark, sf_dir):
    rows = src.spectrum_input(spark, sf_dir)
    return rows.join(bio.enroll(rows, "label"), "label").select("vec_id", "label", bio.cosine(F.col("frame"), F.col("centre")).alias("cos"))


COS = CENTRE + ", c AS (SELECT label, list(x / s ORDER BY pos) AS c FROM m JOIN n USING (label) GROUP BY label), k AS (SELECT vec_id, label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS cos FROM embeddings JOIN c USING (label))"


@query(f"WITH {COS} SELECT vec_id, label, round(cos, 6) AS cos FROM k")
def q_verify_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir).withColumn("cos", F.round("cos", 6))


@query(f"WITH {COS} SELECT vec_id, round(1 / (1 + exp(-(8 * cos - 2.4))), 6) AS handset, round(1 / (1 + exp(-(6 * cos - 1.2))), 6) AS relay FROM k")
def q_cosine_to_prob(spark, sf_dir):
    return _cosines(spark, sf_dir).select("vec_id", *[F.round(bio.identity_probability(F.col("cos"), c), 6).alias(c) for c in bio.CHANNELS])


@query("""WITH t AS (SELECT vec_id // 25 AS call_id, vec_id AS turn_ix, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT call_id, count(*) AS n FROM t GROUP BY call_id),
c AS (SELECT call_id, label FROM t JOIN n USING (call_id) GROUP BY call_id, label HAVING count(*) >= greatest(2, ceil(0.2 * any_value(n)))),
p AS (SELECT *, lag(label) OVER w AS label0, lag(e) OVER w AS e0 FROM t WINDOW w AS (PARTITION BY call_id ORDER BY turn_ix)),
d AS (SELECT call_id, max(1 - list_cosine_similarity(e, e0)) AS drift FROM p JOIN c USING (call_id, label) WHERE label = label0 GROUP BY call_id)
SELECT call_id, round(coalesce(drift, 0), 6) AS drift FROM n LEFT JOIN d USING (call_id)""")
def q_identity_drift(spark, sf_dir):
    rows = src.spectrum_input(spark, sf_dir)
    turns = rows.select(F.floor(F.col("vec_id") / 25).alias("call_id"), F.col("vec_id").alias("turn_ix"), F.col("label").alias("cluster"), "frame")
    return talk.identity_drift(turns).select("call_id", F.round("drift", 6).alias("drift"))


@query("""SELECT event_id, CASE WHEN event_id % 100 > 90 THEN 'EXPIRED' WHEN value / 10 < 3 AND event_id % 3 > 0 THEN 'RETRY' WHEN value / 10 < 3 THEN 'FAIL'
WHEN event_type = 'error' THEN 'FAIL' WHEN event_type <> 'click' AND value / 200 < CASE WHEN event_id % 2 = 0 THEN 0.30 ELSE 0.20 END THEN 'FAIL' ELSE 'PASS' END AS verdict FROM events""")
def q_challenge_verdicts(spark, sf_dir):
    channel, identity = F.when(F.col("event_id") % 2 == 0, "handset"), F.when(F.col("event_type") != "click", F.col("value") / 200)
    v = bio.challenge_verdict(F.col("event_id") % 100, F.lit(90), F.col("value") / 10, F.col("event_type") != "error", identity, F.col("event_id") % 3, need=bio.least_identity(channel))
    return src.table(spark, sf_dir, "events").select("event_id", v.alias("verdict"))


@query("""WITH s AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id FROM s, n WHERE last_ts + INTERVAL 2 HOUR > now""")
def q_session_sweep(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))).filter("last_ts + interval 2 hours > now").select("user_id")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=([0-9]+)') THEN 'page_' || regexp_extract(url, '[?&]page=([0-9]+)', 1) ELSE 'src_' || substr(sha1(url), 1, 12) END AS video_id FROM pages""")
def q_video_id(spark, sf_dir):
    found = F.regexp_extract("url", "[?&]page=([0-9]+)", 1)
    return src.table(spark, sf_dir, "pages").select("page_id", F.when(found != "", F.concat(F.lit("page_"), found)).otherwise(F.concat(F.lit("src_"), F.substring(F.sha1(F.col("url").cast("binary")), 1, 12))).alias("video_id"))


@query("SELECT page_id, trim(url) AS url FROM pages WHERE trim(url) <> '' AND trim(url) NOT LIKE '#%'")
def q_url_filter(spark, sf_dir):
    url = F.trim("url")
    return src.table(spark, sf_dir, "pages").select("page_id", url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


@query("""WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def q_sessions(spark, sf_dir):
    events = src.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count("*").alias("n")).select("user_id", "n")
