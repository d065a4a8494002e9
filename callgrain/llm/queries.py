"""The numbered queries over whole tables, and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm import exact_dedup, infill, jaccard, language, minhash, mixing, packing, pii, search, substring, tokens, topk, warc


def vocabulary() -> str:
    """The place of the byte-level vocabulary; the operators take any other as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir), vocabulary())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), vocabulary())


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(_documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.filled_in_middle(_documents(spark, sf_dir))
    again = infill.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (again, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return {
        "op3_exact_topk": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY rank <= 5""",
        "op4_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({lower}) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
        "op8_substring_dedup": r"""
            WITH w AS (
              SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
            p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w),
            k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s : s + 19], ' ') ORDER BY doc_id, s) AS nth FROM p),
            gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM k WHERE nth > 1),
            e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
            o AS (
              SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n_kept
              FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i WHERE gone.i IS NULL GROUP BY e.doc_id)
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
                   sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON w.doc_id = o.doc_id""",
        "op9_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
            d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
            g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM g""",
        "op11_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
            t AS (
              SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
                     [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
            c AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, h[1] % (len(tokens) + 1) AS x, h[2] % (len(tokens) + 1) AS y FROM t),
            p AS (
              SELECT *, array_to_string(tokens[1 : least(x, y)], '') AS pre, array_to_string(tokens[least(x, y) + 1 : greatest(x, y)], '') AS mid,
                     array_to_string(tokens[greatest(x, y) + 1 :], '') AS suf,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                          WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM p""",
        "op12_lexical_search": rf"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{term}') AS t FROM documents),
            i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM benchmark),
            s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
            p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
            f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
            w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
            g AS (
              SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
              FROM i JOIN f USING (term) JOIN w USING (term), s GROUP BY q, item_id, r, doc_id)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM g WHERE score > 0 QUALIFY rank <= 10""",
    }
