"""Ingest: files to documents, chunks, symbols and terms, written as versions of a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, code
from ..functions.text import stem
from ..sources.shared import Versions
from . import chunking, corpus
from .index import term_vectors


def documents(files: DataFrame, root: str) -> DataFrame:
    """(uri, root_name, path, title, language, authority, class, hash, text) of scanned files (path, hash, text)."""
    p = F.col("path")
    return files.select(
        F.concat(F.lit(f"project://{root}/"), p).alias("uri"),
        F.lit(root).alias("root_name"),
        "path",
        stem(p).alias("title"),
        classify.language(p).alias("language"),
        classify.infer_authority(F.lit(root), p).alias("authority"),
        classify.path_class(p).alias("class"),
        "hash",
        "text",
    )


def derive(docs: DataFrame) -> dict[str, DataFrame]:
    """Chunks, symbols and term vectors of documents."""
    plain = docs.where("language <> ''").select("uri", "root_name", "text")  # code; the rest is read as Markdown
    prose = chunking.markdown_chunk(docs.where("coalesce(language, '') = ''").select("uri", "root_name", "text"))
    chunks = prose.unionByName(chunking.chunk(plain).withColumn("heading", F.lit(""))).withColumn("chunk_id", F.xxhash64("uri", "ordinal"))
    symbols = code.extract(docs, "path", "uri", "root_name")
    terms = term_vectors(chunks, ["chunk_id", "root_name"], "heading", "body")
    return {"chunks": chunks, "symbols": symbols, "terms": terms}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """One of the tables (documents, chunks, symbols, terms) of the last version below a folder."""
    at = Versions(spark, folder).tables()
    return spark.read.parquet(f"{at}/{name}") if at else None


def write(spark: SparkSession, folder: str, new: DataFrame) -> int:
    """Upserts documents into the tables below a folder and derives the rest anew for what was written; how many were.

    All tables of the next version are written aside and then named at once, so a job that is lost half-way changes
    nothing, and readers see either version whole. Of two writers one fails with FileExistsError.
    """
    versions = Versions(spark, folder)
    last, at = max(versions.all(), default=0), versions.draft()
    old = read(spark, folder, "documents")
    merged = corpus.upsert(old if old is not None else new.limit(0), new)
    merged.write.parquet(f"{at}/merged")
    merged = spark.read.parquet(f"{at}/merged")
    fresh = merged.where("written")
    merged.drop("written").write.parquet(f"{at}/documents")
    gone = None
    for name, rows in derive(fresh).items():
        kept = read(spark, folder, name)
        if kept is not None:
            if name == "chunks":
                gone = kept.join(fresh.select("uri"), "uri", "left_semi").select("chunk_id")
            by = "chunk_id" if name == "terms" else "uri"
            rows = kept.join(gone if name == "terms" else fresh.select("uri"), by, "left_anti").unionByName(rows)
        rows.write.parquet(f"{at}/{name}")
    written = fresh.count()
    versions.commit(at, last)
    versions.forget()
    return written
