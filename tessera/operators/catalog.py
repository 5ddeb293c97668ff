"""Reads of the catalog: names, single documents with their chunks, previews, sources with their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Chunks and characters of a preview.
PREVIEW_CHUNKS, PREVIEW_CHARS = 20, 20_000


def names(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in order, without nulls and blanks."""
    return df.select(column).where(F.col(column).isNotNull() & (F.trim(column) != "")).distinct().orderBy(column)


def chosen(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is wanted: documents by id or uri, chunks or symbols of documents."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def preview(chunks: DataFrame, wanted: DataFrame, key: str = "document_id", most_chunks: int = PREVIEW_CHUNKS, most_chars: int = PREVIEW_CHARS) -> DataFrame:
    """(key, ordinal, text, cut): the first chunks of documents, until so many characters are shown; cut tells a shortened one."""
    w = Window.partitionBy(key).orderBy("ordinal", "chunk_id")
    rows = chosen(chunks, wanted, key).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_chunks)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.char_length("body")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.greatest(F.lit(most_chars) - F.col("_before"), F.lit(0)).cast("int")
    rows = rows.where(F.col("_before") < most_chars)
    return rows.select(key, "ordinal", F.left("body", left).alias("text"), (F.char_length("body") > left).alias("cut"))


def with_parts(sources: DataFrame, parts: DataFrame, key: str, column: str, into: str) -> DataFrame:
    """sources with `into`: the sorted values of a column of their parts (pages, files, members), empty where there are none."""
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias(into))
    return sources.join(listed, key, "left").withColumn(into, F.coalesce(into, F.array().cast(listed.schema[into].dataType)))


def default_roots(project: str, related: list[str]) -> list[str]:
    """A workspace's roots: the project's own, then related ones, each once, without blanks."""
    return list(dict.fromkeys(r.strip() for r in [project, *related] if r and r.strip()))


def choice_text(kind: str, found: list[str]) -> str:
    """What is asked of a user when several roots or groups fit."""
    return f"Several {kind} match. Name one of: " + ", ".join(sorted(dict.fromkeys(found)))
