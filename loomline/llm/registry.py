"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import containers, conversations, corpus_tokens, hidden_copies, offence, pieces, scans, transcripts
from loomline.llm.sides import AGENT_WORDS, CUSTOMER_WORDS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.broken_sessions(_table(spark, sf_dir, "turns"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(_table(spark, sf_dir, "turns"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_rows(_table(spark, sf_dir, "doc_chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_pieces(_table(spark, sf_dir, "doc_chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_copies.copy_pairs(_table(spark, sf_dir, "transcript_segments"), _table(spark, sf_dir, "raw_segments"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_copies.collapse(_table(spark, sf_dir, "transcript_segments"), _table(spark, sf_dir, "raw_segments"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise_kinds(_table(spark, sf_dir, "doc_chunks"))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.clean_texts(_table(spark, sf_dir, "doc_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.noise_kinds(_table(spark, sf_dir, "turns"))


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.clean_turns(_table(spark, sf_dir, "turns"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_tokens.encode_corpus(_table(spark, sf_dir, "documents"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way back: texts from the ids."""
    return corpus_tokens.decode_corpus(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.pack_documents(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.offensive_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "content_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "content_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.source_rates(p8_scores(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_conversations": p1_conversations, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_records": p3_records, "p4_found": p4_found, "p4_texts": p4_texts, "p5_found": p5_found, "p5_turns": p5_turns, "p6_ids": p6_ids, "p6_texts": p6_texts, "p7_containers": p7_containers, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
_COPIES = r"""
WITH records AS (
  SELECT segment_id, session_id, speaker, text, "timestamp" AS stamp FROM transcript_segments
  UNION ALL
  SELECT segment_id, session_id, json_extract_string(payload, '$.speaker'), json_extract_string(payload, '$.text'),
         TRY_CAST(json_extract_string(payload, '$.timestamp') AS DOUBLE)
  FROM raw_segments WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
keyed AS (
  SELECT segment_id, session_id || '|' || CAST(stamp AS VARCHAR) || '|' || regexp_replace(lower(speaker), '[\s\p{Z}\p{P}]+', '', 'g')
         || '|' || regexp_replace(lower(text), '[\s\p{Z}\p{P}]+', '', 'g') AS k
  FROM records WHERE session_id IS NOT NULL AND speaker IS NOT NULL AND text IS NOT NULL AND stamp IS NOT NULL AND NOT isnan(stamp)),
grouped AS (SELECT segment_id, min(segment_id) OVER (PARTITION BY k) AS keep_id, k FROM keyed)
"""

_WHITE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"



def _words(words: frozenset[str], least: int = 1) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words) if len(w) >= least) + "]"


def _names(words: frozenset[str], least: int) -> str:
    """Whether a label's words name a side exactly, and whether one is a letter away from doing so."""
    exact = f"len(list_filter(ws, lambda w: list_contains({_words(words)}, w) AND (length(w) > 1 OR w = j))) > 0"
    near = f"len(list_filter(ws, lambda w: length(w) >= 4 AND len(list_filter({_words(words, least)}, lambda k: k[1] = w[1] AND damerau_levenshtein(w, k) <= 1)) > 0)) > 0"
    return f"list_contains({_words(words)}, j), {exact}, {near}"


#: The rows of a session alone decide whether it is broken, so SQL can say it without components.
_BROKEN = rf"""
WITH l AS (SELECT speaker, ws, array_to_string(ws, '') AS j FROM (SELECT DISTINCT speaker, regexp_extract_all(lower(speaker), '\p{{L}}[\p{{L}}\p{{M}}]*') AS ws FROM turns WHERE speaker IS NOT NULL)),
n(speaker, aj, ae, an, cj, ce, cn) AS (SELECT speaker, {_names(AGENT_WORDS, 5)}, {_names(CUSTOMER_WORDS, 6)} FROM l),
s AS (SELECT speaker, CASE WHEN aj THEN 'agent' WHEN cj THEN 'customer' WHEN ae OR ce THEN CASE WHEN ae AND ce THEN NULL WHEN ae THEN 'agent' ELSE 'customer' END
  WHEN an AND NOT cn THEN 'agent' WHEN cn AND NOT an THEN 'customer' END AS side FROM n),
t AS (SELECT session_id, id, side, CASE WHEN isnan(spoken_at) THEN NULL ELSE spoken_at END AS said_at, coalesce(is_final, FALSE) AND coalesce(regexp_matches(text, '[^\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]'), FALSE) AS usable
  FROM turns LEFT JOIN s USING (speaker) WHERE session_id IS NOT NULL)
SELECT session_id FROM t GROUP BY session_id HAVING count(*) FILTER (WHERE usable) = 0 OR count(*) FILTER (WHERE usable AND (side IS NULL OR said_at IS NULL)) > 0
  OR count(*) FILTER (WHERE usable AND side = 'agent') = 0 OR count(*) FILTER (WHERE usable AND side = 'customer') = 0
  OR arg_max(side, (said_at, id)) FILTER (WHERE usable AND said_at IS NOT NULL) = 'customer'
"""

ORACLE: dict[str, str] = {
    "p1_found": _BROKEN,
    "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": f"SELECT chunk_index FROM doc_chunks WHERE length(regexp_replace(regexp_replace(text, '^{_WHITE}+', ''), '{_WHITE}+$', '')) > 1000",
    "p3_found": _COPIES + "SELECT keep_id, segment_id AS copy_id FROM grouped WHERE segment_id <> keep_id",
    "p3_records": _COPIES + "SELECT keep_id, count(*) AS copies FROM grouped GROUP BY keep_id",
}
