"""The queries of this subpackage's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bucket_digest, fill_middle, media, packing, quality, sentencepieces, simhash, site_style, token_alignment, token_counts, toxicity, url_rules, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), separator=1, ids="crc32")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes", "spans_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(warc.plan_records(table(spark, sf_dir, "pages")))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.BASE_RULES))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.keeps("v1").alias("kept"))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(table(spark, sf_dir, "documents"), seed=1, outputs=("output_sha256", "restored_sha256"))


def op12_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_digest.edited(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_rules, op2_simhash, op3_packing, op4_sentencepiece, op5_warc, op6_main_text, op7_token_counts, op8_quality_rules, op9_avi_media, op10_toxicity, op11_fill_middle, op12_bucket_digest, op13_token_alignment, pipeline)}

ORACLE_SQL: dict[str, str] = {
    "op1_url_rules": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        p AS (
            SELECT page_id,
                   translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM u),
        r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (
            SELECT page_id, host, path,
                   (SELECT max(struct_pack(n := length(h || p), k := h || p, v := v)) FROM r
                    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
            FROM p)
        SELECT page_id, host, path, best.k AS rule, coalesce(best.v, 'allow') AS verdict FROM m""",
    "op8_quality_rules": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT doc_id, text,
                   regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM t),
        g AS (SELECT doc_id, words, list_transform(range(1, greatest(1, len(words) - 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
        e AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
        d AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) AS BIGINT) AS n_lines,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN c USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
                    OR 10 * word_chars < 20 * n_words OR word_chars > 30 * n_words) AS kept
        FROM m""",
    "op11_fill_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
        d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
                     CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                     CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
        c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        o AS (SELECT *, substring(text, 1, i) AS prefix, substring(text, i + 1, j - i) AS middle, substring(text, j + 1) AS suffix FROM c)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM o""",
}
