"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm import bpe, exact_dedup, html_text, linededup, mixing, quality, sharding, simhash, syncmers, token_counts
from grovekit.llm.common import documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_mixing, op3_lines, op4_bpe, op5_html, op6_simhash, op7_exact_dedup, op8_quality, op9_syncmers, op10_token_counts)}

# Letters whose counts bound an edit distance from below, and the others of the texts' languages.
LETTERS = "enatoriushld"
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
#: DuckDB's distance is one of bytes, so each accented letter becomes a control character.
PLAIN = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)])

LINES = f"""
    WITH RECURSIVE t AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
    p AS MATERIALIZED (SELECT * FROM t WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
    d AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY line) AS id, length(line) AS n, translate(line, '{ACCENTED}', {PLAIN}) AS plain,
        {", ".join(f"length(line) - length(replace(line, '{c}', '')) AS n_{c}" for c in LETTERS)} FROM (SELECT DISTINCT line FROM p)),
    near AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM d a JOIN d b ON a.n >= {linededup.SHARE} AND b.n >= a.n AND b.n <= a.n + least({linededup.THRESHOLD}, a.n // {linededup.SHARE}) AND (b.n > a.n OR b.id > a.id)
        AND CASE WHEN {" + ".join(f"abs(a.n_{c} - b.n_{c})" for c in LETTERS)} <= {2 * linededup.THRESHOLD} THEN levenshtein(a.plain, b.plain) <= least({linededup.THRESHOLD}, a.n // {linededup.SHARE}) ELSE false END),
    links AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
    reach(id, top) AS (SELECT u, u FROM links UNION SELECT links.v, reach.top FROM reach JOIN links ON links.u = reach.id),
    label AS (SELECT id, min(top) AS top FROM reach GROUP BY id),
    placed AS (SELECT p.doc_id, p.line_no, row_number() OVER (PARTITION BY coalesce(label.top, d.id) ORDER BY p.doc_id, p.line_no) AS place FROM p JOIN d USING (line) LEFT JOIN label USING (id)),
    gone AS (SELECT doc_id, count(*) AS n_dropped, string_agg(line_no, ',' ORDER BY line_no) AS dropped FROM placed WHERE place > 1 GROUP BY doc_id)
    SELECT doc_id, (SELECT count(*) FROM t WHERE t.doc_id = documents.doc_id) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN gone USING (doc_id)"""

ORACLES = {
    "op3_lines": LINES,
    # A to Z only: Spark and DuckDB agree on translate, not on lower.
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
}
