"""A training corpus from `documents`: quality, line dedup, near duplicates, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, mixing, ngram_join, quality
from tessera.llm.common import passing, remove_path, scratch_path, stored, table

#: The mixture uses every document, none more often than this.
REPEATS = 1.5


def packed(docs: DataFrame, *columns: str, without: str = "") -> DataFrame:
    """The named columns, and d: a struct of all columns but one, whose names can't clash with an operator's then."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("d"), *columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Rows without a decision don't exist: empty texts go by their site."""
    rows = packed(docs, "doc_id", "text", "source", "lang")
    out = quality.rate(rows, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"), texts=False)
    return out.where("keep").select("d.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten different texts or more hold; n_chars follows. Texts that were null stay null.

    Copies count as one text here: a document isn't emptied for having copies, of which the next stage keeps one.
    """
    out = line_dedup.dedup_lines(packed(docs, "doc_id", "text", without="text"), copies=False, nulls=True)
    done = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")}
    return out.select(*[done.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a similarity of 0.8 over five-word shingles.

    Texts without words (null ones too) have no shingles, so each is a group of its own and stays; so does a document
    without an id. Of rows with one doc_id and one text, one stays.
    """
    groups = ngram_join.join(docs)
    known = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"), F.count(F.lit(1)).alias("c"))
    known = stored(known.where("first = 0 or c > 1"), "gone")
    stay = docs.join(known.where("first = 0").select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = known.where("first = 1").select("doc_id")  # ids of several rows
    single = stay.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    several = stay.join(again, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, and again those of sources below their target weight, as often as the mixture uses them."""
    return mixing.mix(packed(docs, "doc_id", "text", "source"), repeats=REPEATS).select("d.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token counts and digests, a row for each use of a document."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("doc_id", "source", "lang"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", token_stage),
]

#: Shrinkage, components and bisection are iterative: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again.

    Once a stage's rows are written, the tables that it kept aside go, and so do the rows that it was given.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
