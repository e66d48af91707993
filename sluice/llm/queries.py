"""The queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, html, lines, near, quality, sharding, suffix_dedup
from .common import table

SHARDS = 8
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(docs, ["doc_id", "size", "text_crc32"], SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.start", "leak.n_words", "leak.n_equal")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, rules).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digest(chat.format_chats(rows))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_bpe, op3_decontamination, op4_html, op5_line_dedup, op6_quality, op7_suffix_dedup, op8_chat, op9_jaccard_join, op10_exact_dedup)}

_BARE = r"translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
_CONTROL = r"[<\[]\\*(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])"

ORACLE = {
    "op5_line_dedup": """
        WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
                   FROM documents WHERE text IS NOT NULL),
        b AS (SELECT line FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
        k AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line)
        SELECT d.doc_id, count(k.i) AS n_lines, count(*) FILTER (k.gone) AS n_removed,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (NOT k.gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_BARE} AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST)""",
    "op8_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + 17 AS chars,
                     row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS total
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(upto) FILTER (role = 'assistant' OR i = total)::bigint AS formatted_chars
        FROM p GROUP BY conv_id""",
}
