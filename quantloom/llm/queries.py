"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import (importance, language, lengthpack, licenses, linededup, neardup, packing, periodic, pieces, quality,
                           tokens, topk, toxicity)
from quantloom.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, path, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", *[f"rule_{r.name}" for r in quality.RULES], "kept")


SQL["op1_quality_rules"] = quality.oracle_sql()


@query
def op2_token_files(spark: SparkSession, path: str) -> DataFrame:
    target = shared_folder(spark, "tokens")
    docs = table(spark, path, "documents").select("doc_id", "text")
    tokens.write_tokens(docs, target, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_packing(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    return packed_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "tier", "step_group")


@query
def op6_exact_topk(spark: SparkSession, path: str) -> DataFrame:
    return topk.exact_topk(table(spark, path, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op6_exact_topk"] = topk.ORACLE


@query
def op8_language(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        F.concat_ws(",", "languages").alias("languages"))


def language_model(docs: DataFrame) -> language.Model:
    return language.train(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))))


@query
def op4_license_scan(spark: SparkSession, path: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, path, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                        F.size("spans").alias("n_spans"))


@query
def op9_toxicity(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_chain(docs, path)).drop("text")


def toxicity_chain(docs: DataFrame, path: str) -> toxicity.Chain:
    labels = table(docs.sparkSession, path, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(docs, labels, ["low_quality", "toxic"])


@query
def op3_jaccard_join(spark: SparkSession, path: str) -> DataFrame:
    groups = neardup.jaccard_groups(table(spark, path, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "class_id", "n_links", "n_copies")


@query
def op5_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    cleaned = linededup.line_dedup(table(spark, path, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "removed_lines", "removed_words", F.length("text").cast("long").alias("kept_chars"),
                          F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.to_json("removed").alias("removed"))


@query
def op7_sentencepiece(spark: SparkSession, path: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, path, "documents").select("doc_id", "text"), model), model)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
                        F.length("decoded").cast("long").alias("decoded_chars"), same.alias("round_trip"))


@query
def op11_length_packing(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    packed = lengthpack.pack_by_length(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")


@query
def op12_periodic_runs(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs, plant=True, with_text=False).withColumn("best", periodic.strongest())
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


@query
def op13_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, table(spark, path, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
