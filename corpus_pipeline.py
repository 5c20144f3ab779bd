"""The corpus pipeline: documents in, packed token sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import language, linededup, neardup, packing, toxicity
from quantloom.llm.common import neutral, store, table
from quantloom.llm.queries import language_model, packed_digest, toxicity_chain

#: A document stays whose largest language has so large a share of its words.
LEAST_SHARE = 0.5


def _passing(docs: DataFrame, judge, passes) -> DataFrame:
    """Rows of ``docs`` whose verdict passes. Verdicts stand beside columns of neutral names: none of ``docs`` is lost."""
    safe, names = neutral(docs)
    return judge(safe, names).filter(passes).select(*names.values()).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters or without a main language go.

    The models learn from the documents' own ``lang``; where no row has one, nothing can be told and all stay.
    A null text has no letters and goes; repeated rows stay or go together; an empty table stays empty; all columns stay,
    whatever their names.
    """
    model = language_model(docs)
    if not model.langs:
        return docs
    return _passing(docs, lambda safe, names: language.identify(safe, model, text=names["text"]),
                    (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, learned from ``labels`` and these documents, does not call toxic.

    A null text has no words and stays; repeated rows stay or go together; an empty table stays empty, and without
    labels all stay; all columns stay, whatever their names.
    """
    chain = toxicity_chain(docs, sf_dir)
    return _passing(docs, lambda safe, names: toxicity.score(safe, chain, text=names["text"]), ~F.col("toxic"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of words; one of which nothing but blanks is left goes.

    ``n_chars``, where there is one, follows a text that lost words. Null and empty texts stay; of repeated rows of one
    id all keep the same, of several ids the first; an empty table stays empty; all columns stay, whatever their names.
    """
    safe, names = neutral(docs)
    text = names["text"]
    cleaned = linededup.line_dedup(safe, doc_id=names["doc_id"], text=text)
    cleaned = cleaned.filter((F.col("removed_lines") == 0) | F.regexp_like(text, F.lit("[^\\x20\\x09-\\x0D]")))
    if (n := names.get("n_chars")) is not None:
        cleaned = cleaned.withColumn(n, F.when(F.col("removed_lines") > 0, F.length(text).cast("long")).otherwise(F.col(n)))
    return cleaned.select(*names.values()).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    Null texts and texts without words stay; of repeated rows one stays; an empty table stays empty; all columns stay,
    whatever their names.
    """
    return neardup.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 2048 tokens.

    A null text is an empty one, its end id alone; repeated rows are packed each; an empty table has no pieces; other
    columns are not read.
    """
    return packed_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", identify_language), ("toxicity", drop_toxic), ("line_dedup", dedup_lines),
          ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: Trained models, fuzzy similarity and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's result is written once and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
