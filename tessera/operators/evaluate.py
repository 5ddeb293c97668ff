"""Retrieval evaluation: expected sources and symbols against what came back, and latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import percentiles
from .index import Index, phrase_hits, set_down, words


def judge(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, top1, top3, sources_found, sources_declared, forbidden, tokens): one row a task.

    results: id, symbols (array, ranked), sources (array), tokens; tasks: id, expected_symbols, expected_sources,
    forbidden_symbols (arrays).
    """
    r = tasks.join(results, "id", "left")
    fold = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    got, want = fold(F.col("symbols")), fold(F.col("expected_symbols"))
    hit = lambda n: F.when(F.size(want) > 0, F.arrays_overlap(F.slice(got, 1, n), want))
    found = F.size(F.filter("expected_sources", lambda e: F.exists(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.contains(s, e))))
    return r.select("id", hit(1).alias("top1"), hit(3).alias("top3"), found.alias("sources_found"), F.size("expected_sources").alias("sources_declared"), F.size(F.array_intersect(got, fold(F.col("forbidden_symbols")))).alias("forbidden"), "tokens")


def metrics(judged: DataFrame) -> DataFrame:
    """One row of recall shares, forbidden hits and the mean of tokens."""
    return judged.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.avg(F.col("top1").cast("int")).alias("top1_recall"),
        F.avg(F.col("top3").cast("int")).alias("top3_recall"),
        F.try_divide(F.sum("sources_found"), F.sum("sources_declared")).alias("source_recall"),
        F.sum("forbidden").alias("forbidden_hits"),
        F.avg("tokens").alias("avg_tokens"),
    )


def latencies(times: DataFrame, *by: str) -> DataFrame:
    """(by, p50, p95) of column ms, by rank without interpolation, in one pass."""
    return percentiles(times, "ms", {"p50": 0.5, "p95": 0.95}, *by)


def containing(docs: DataFrame, needles: DataFrame, ix: Index, key: str = "doc_id") -> DataFrame:
    """(id, key): documents whose text holds a needle (id, needle) as it is.

    A needle's inner words stand whole and side by side in any text that holds it, so texts are found by them as a phrase,
    through the index of docs (whose chunk_id is the key), and then looked at. Needles of fewer than three words have no
    inner one; if there are any, they are compared with every text.
    """
    ws = needles.select("id", "needle", words(F.col("needle")).alias("ws"))
    inner = ws.where(F.size("ws") > 2).select(F.col("id").alias("pid"), F.slice("ws", F.lit(2), F.size("ws") - 2).alias("ws"), F.lit(None).cast("array<string>").alias("roots"))
    near = set_down(phrase_hits(ix, inner).select(F.col("pid").alias("id"), F.col("chunk_id").alias(key)), "near")
    texts = docs.select(key, "text")
    out = texts.join(near, key).join(needles.select("id", "needle"), "id").where(F.contains("text", "needle")).select("id", key)
    short = ws.where(F.size("ws") < 3).select("id", "needle")
    return out.unionByName(texts.join(short, F.contains("text", "needle")).select("id", key)) if short.limit(1).count() else out
