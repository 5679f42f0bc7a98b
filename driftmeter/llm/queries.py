"""The registered queries of this subpackage: each derives its digest columns from what its operator returns."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmeter.llm import (
    byte_bpe, importance, mixing, page_diff, personal, projected_search, quality_rules, sharding, simhash, spelling, suffix_dedup,
    token_files, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op4_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return found.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


def op8_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_diff.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    machine = toxicity.fitted(docs, labels.filter(fold() != 0))
    found = toxicity.scored(docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), machine)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = personal.train(personal.labelled_sentences(spark))
    found = personal.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_files, op3_source_mixing, op4_projected_search, op5_external_shuffle, op6_quality_rules, op7_byte_bpe, op8_page_diff, op9_suffix_array_dedup, op10_toxicity, op11_importance_resampling, op12_personal_data, op13_spelling_variants, pipeline)}
# SQL for the templates of the given pages: their articles hold no markup but h1, p, b and br, and few character references
_BLOCKS = "regexp_split_to_array(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1|br)>')"
_UNMARKED = "regexp_replace(x, '<[^>]+>', '', 'g')"
_DECODED = f"""regexp_replace(replace(replace(replace({_UNMARKED}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"""

def _lower(text: str) -> str:
    """A-Z only."""
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes, bit by bit: shift right, and where the bit shifted out differs from the text's, take the polynomial."""
    bits = f"list_transform(range(0, 8 * octet_length(encode({text}))), lambda i: get_bit(encode({text})::BIT, (i // 8 * 8 + 7 - i % 8)::INT)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op8_page_diff": f"""
      SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
        SELECT page_id, url, array_to_string(list_filter(list_transform({_BLOCKS},
          lambda x: trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text
        FROM pages)""",
    "op11_importance_resampling": f"""
      WITH held AS (
        SELECT true AS source, doc_id, regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
        UNION ALL
        SELECT false, NULL, regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
      units AS (SELECT source, doc_id, unnest(words) AS word FROM held),
      hashed AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM units)),
      totals AS (SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM units JOIN hashed USING (word) GROUP BY bucket),
      gains AS (
        SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain
        FROM totals),
      weights AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM units JOIN hashed USING (word) JOIN gains USING (bucket) WHERE source GROUP BY doc_id),
      scored AS (
        SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM held LEFT JOIN weights USING (doc_id) WHERE source),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
      SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""",
    "op13_spelling_variants": f"""
      WITH RECURSIVE runs AS (
        SELECT doc_id, unnest(regexp_extract_all({_lower('text')}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
      counted AS (SELECT doc_id, run, count(*) AS n, {_crc32("doc_id || ':' || run")} AS h FROM runs GROUP BY doc_id, run),
      shortened AS (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM counted),
      words AS (SELECT word, sum(n)::BIGINT AS n FROM shortened WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
      cuts AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word)))::INT AS i FROM words)),
      longer AS (SELECT DISTINCT c.word, w.word AS near FROM cuts c JOIN words w ON w.word = c.rest),
      near AS (
        SELECT DISTINCT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT word, near FROM longer UNION SELECT near, word FROM longer),
      best AS (
        SELECT near.word, count(*) AS n_near, first(near ORDER BY m.n DESC, encode(near)) AS form, max(m.n) AS form_n
        FROM near JOIN words m ON m.word = near.near GROUP BY near.word),
      formed AS (
        SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
        FROM words LEFT JOIN best USING (word)),
      walk AS (
        SELECT word, word AS root, form AS next FROM formed
        UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next)
      SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word) WHERE next IS NULL""",
}
