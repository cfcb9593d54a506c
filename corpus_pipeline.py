"""Corpus pipeline: language filter, near-duplicate removal, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, read_table
from factorloom.llm.decontamination import leaks_into
from factorloom.llm.language import fit_language_model, language_column
from factorloom.llm.mixing import mix_sources
from factorloom.llm.ngram_join import shingle_components
from factorloom.llm.queries import MIX_ALPHA, tokenizer_path
from factorloom.llm.token_output import token_output

#: A text whose best language has a smaller posterior is rejected, and so is one without letters.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language (all with letters, if no row has a label to learn from).

    A null or empty text and one without letters goes; null ids, labels and
    sources stay as they are; repeated rows are judged alike; a tie of two
    languages has a score of 0.5 and stays; an empty table stays empty.
    """
    model = fit_language_model(spark, docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    guess = language_column(spark, model)
    judged = docs.withColumn("pipeline_language", guess)
    fits = (F.col("pipeline_language.lang_pred") != "und") & (F.col("pipeline_language.score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(fits).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked documents one row: of those with an id the smallest id, then the smallest hash of the row.

    A row without an id stays only where no row of its group has one.  Texts
    without words link with nothing and stay.  Rows that are equal in every
    column are one document, with words or without; an empty table stays empty.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("row"))
    parts = Scratch(spark, "pipeline-duplicates").keep(shingle_components(spark, docs.select(key.alias("pipeline_key"), "text"), "pipeline_key"), "components")
    kept = parts.where("pipeline_key = component_id").groupBy("pipeline_key").agg(F.count(F.lit(1)).alias("pipeline_copies"))
    kept = kept.select(F.col("pipeline_key.id").alias("pipeline_id"), F.col("pipeline_key.row").alias("pipeline_row"), "pipeline_copies")
    same = (F.xxhash64(*docs.columns) == F.col("pipeline_row")) & F.col("doc_id").eqNullSafe(F.col("pipeline_id"))
    stay = docs.join(kept, same).select(*docs.columns)
    # equal rows are combined before they are exchanged, so a hot one is no hot spot
    return stay.dropDuplicates() if kept.where("pipeline_copies > 1").limit(1).count() else stay


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item.

    A null or empty text contains none; an item without words is contained in
    none; repeated rows are judged alike; either table may be empty.
    """
    return docs.where(~leaks_into(spark, read_table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target source weights, in shuffled order.

    A null source is a source of its own; rows that repeat an id get the same
    count each; an empty table stays empty.
    """
    return mix_sources(spark, docs, alpha=MIX_ALPHA).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token shards and return the index read back from them.

    A null or empty text is the end id alone; repeated rows keep their rows;
    an empty table gives an empty index.
    """
    return token_output(spark, docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
