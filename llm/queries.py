"""One query per operator, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from llm import fingerprints, language, licences, lines, middle, packing, phrases, pieces, quality, sharding, simhash, suffix_dedup, warc
from llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(texts(spark, sf_dir))


@query
def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.law(texts(spark, sf_dir))


@query
def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(texts(spark, sf_dir))


@query
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = warc.round_trip(table(spark, sf_dir, "pages"))
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# SHA-1 in base 32: each five hexadecimal digits are four letters.
ORACLE["op4_warc_round_trip"] = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM hashed GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((list_reduce(list_transform(range(1, 6), lambda k: instr('0123456789ABCDEF', substr(h, (5 * (i // 4) + k)::INTEGER, 1)) - 1), lambda x, y: x * 16 + y)
      >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed JOIN firsts USING (html)
"""


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = licences.scan(texts(spark, sf_dir))
    return told.select("doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                       F.array_join("licences", ",").alias("licences"))


ORACLE["op6_licence_scan"] = licences.oracle()


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(language.training_rows(docs))
    told = language.identify(docs, model, keep=["doc_id"])
    return told.select("doc_id", language.held_out(told.doc_id).alias("held_out"), "lang_pred", "score", "languages")


@query
def op8_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.measured(texts(spark, sf_dir))


@query
def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir))


@query
def op10_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.measured(texts(spark, sf_dir))


ORACLE["op11_line_dedup"] = lines.oracle()


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.measured(texts(spark, sf_dir))


ORACLE["op12_fill_in_middle"] = middle.oracle()


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_phrase_collocations"] = phrases.oracle()


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
