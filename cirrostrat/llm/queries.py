"""The thin queries over this package's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.alignment import align_documents
from cirrostrat.llm.chat import format_conversations, learned_text, read_turns
from cirrostrat.llm.host_rules import judge_documents
from cirrostrat.llm.html_text import extract_text
from cirrostrat.llm.minhash import near_duplicates
from cirrostrat.llm.mixing import mix_sources
from cirrostrat.llm.neighbours import nearest
from cirrostrat.llm.pieces import encode_documents
from cirrostrat.llm.records import encode_and_read_back
from cirrostrat.llm.repeats import cut_repeats
from cirrostrat.llm.sharding import shard_documents
from cirrostrat.llm.url_rules import document_of, judge_urls
from cirrostrat.llm.variants import count_words, group_variants
from cirrostrat.runtime import table

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.withColumn("doc_id", document_of(F.col("url"))).join(labels, "doc_id").filter(F.col("bad").isNotNull()).select("url", "bad")
    return judge_urls(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    chats = format_conversations(turns.unionByName(own))
    back = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents"), slips=31))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), need=200)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_token_records, op3_mixing, op4_sharding, op5_html_text, op6_url_filter, op7_sentencepiece, op8_chat, op9_quality_rules, op10_neighbours, op11_spelling_variants, op12_repeats, op13_token_alignment)}

MIXING_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents),
keyed AS (
    SELECT *, -ln(u) / greatest(0.01::DOUBLE, least(mean / 6.5::DOUBLE, 6.5::DOUBLE / mean) / (1 + 4 * symbols)) AS k
    FROM (SELECT *, coalesce(length(text)::DOUBLE / nullif(size, 0)::DOUBLE, 6.5::DOUBLE) AS mean,
                 coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / nullif(size, 0)::DOUBLE, 0) AS symbols FROM sized)),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS room FROM sources),
ranked AS (
    SELECT *, row_number() OVER by_level AS rank, sum(source_size) OVER () - coalesce(sum(room) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
           sum(w) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
    FROM named WINDOW by_level AS (ORDER BY room::DOUBLE / w::DOUBLE, source ASC NULLS LAST)),
level AS (SELECT arg_min(left_::DOUBLE / w_left::DOUBLE, rank) AS v FROM ranked WHERE left_::DOUBLE / w_left::DOUBLE <= room::DOUBLE / w::DOUBLE),
goals AS (SELECT source, source_size, least(room::DOUBLE, level.v * w) AS target FROM ranked, level),
rest AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM goals),
ahead AS (
    SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS left_,
           coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size, md5(k.text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM keyed k JOIN rest r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= left_ THEN 1 ELSE 0 END))::BIGINT AS taken FROM ahead
"""

CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
chats AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS flat,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
           sum(length('### ') + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '### ', '\h'), ':', '\c')) + 2
               + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h')) + length('</turn>') + 1) AS formatted_chars,
           string_agg(role, '>' ORDER BY turn NULLS FIRST, role, text) AS roles
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(flat) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, '(system>)?user>assistant(>user>assistant)*') AS valid
FROM chats
"""

QUALITY_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
grams AS (SELECT r, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
hits AS (SELECT DISTINCT r, i + unnest(range(5)) AS at FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT r, count(*) AS n FROM hits GROUP BY r),
lines AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l) GROUP BY r),
base AS (
    SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
    FROM docs d JOIN words w USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN lines l USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT sum(failed) / sum(n)::DOUBLE AS m, sum((failed * failed) / n::DOUBLE) / sum(n)::DOUBLE AS square, count(*) / sum(n)::DOUBLE AS by_chance, sum(n)::DOUBLE AS total FROM hosts),
fitted AS (SELECT m, CASE WHEN square - m * m - m * (1 - m) * by_chance > 0 THEN greatest(m * (1 - m) / (square - m * m - m * (1 - m) * by_chance) - 1, 0) ELSE total END AS strength FROM prior),
rates AS (SELECT source, (failed + m * strength) / (n + strength) AS rate FROM hosts, fitted),
verdicts AS (SELECT source, CASE WHEN rate > 0.5 THEN -1 ELSE 0.5::DOUBLE * (1 - rate / 0.5::DOUBLE) END AS symbols FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= coalesce(symbols, 0.5::DOUBLE) * n_words AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""

ORACLES: dict[str, str] = {"op3_mixing": MIXING_SQL, "op8_chat": CHAT_SQL, "op9_quality_rules": QUALITY_SQL}
