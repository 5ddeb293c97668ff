"""Mutations of the catalog as merged snapshots: keyed upserts with their parts, removals, purges, states of sources.

Every function gives the next state of a table; tables.replace() writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a task sorts.
TASK_PARTS = 1_000_000


def keyed(old: DataFrame, new: DataFrame, *key: str, order: str | None = None) -> DataFrame:
    """old with new's rows in place of those of their key; of new rows with one key the last by order (any, without one)."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), F.col(order) if order else F.lit(0)).alias("_r")).select("_r.*") if order else new.dropDuplicates(list(key))
    return old.join(last.select(*key), list(key), "left_anti").unionByName(last, allowMissingColumns=True)


def with_parts(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Parts after an upsert of parents: all old parts of these go, new ones come (pages of a site, files of a repository).

    Parents are as many as parts, so their keys are sorted, not broadcast (as files' sizes, which tell little of them, would
    have it); the number of tasks that sort follows the number of parts, so that what one of them holds doesn't grow.
    """
    tasks = max(int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-old.count() // TASK_PARTS))
    gone = parents.select(key).repartition(tasks, key).hint("merge")
    return old.repartition(tasks, key).join(gone, key, "left_anti").unionByName(new.join(gone, key, "left_semi"))


def removed(df: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """df without the rows whose key is gone."""
    return df.join(gone.select(*key).distinct(), list(key), "left_anti")


def purged(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that have chunks."""
    return documents.join(chunks.select(key).distinct(), key, "left_semi")


def cleared(df: DataFrame) -> DataFrame:
    """The empty table of df's columns."""
    return df.limit(0)


def reviewed(recipes: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """recipes with review_status, reviewed_at and authority after decisions (id, status).

    A recipe that is promoted (status 'reviewed') counts as curated; one that is demoted no longer does.
    """
    d = decisions.select("id", F.col("status").alias("_s"))
    out = recipes.join(d, "id", "left")
    status = F.coalesce("_s", "review_status")
    authority = F.when(F.col("_s") == "reviewed", "curated_internal_recipe").when(F.col("_s").isNotNull() & (F.col("authority") == "curated_internal_recipe"), "generated_summary").otherwise(F.col("authority"))
    return out.withColumns({"authority": authority, "reviewed_at": F.when(F.col("_s").isNotNull(), now).otherwise(F.col("reviewed_at")), "review_status": status}).select(recipes.columns)


def stamped(sources: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """sources with last_attempt, last_success, status and version after runs (key, at, ok, version).

    Every run is an attempt; only one that went well moves the time of success and the version.
    """
    r = runs.groupBy(key).agg(F.max_by(F.struct("at", "ok", "version"), "at").alias("_last"), F.max_by(F.struct("at", "version"), F.when(F.col("ok"), F.col("at"))).alias("_good"), F.max("ok").alias("_any"))
    out = sources.join(r, key, "left")
    good = F.col("_any") & F.col("_good.at").isNotNull()
    return out.withColumns(
        {
            "last_attempt": F.coalesce("_last.at", "last_attempt"),
            "last_success": F.when(good, F.col("_good.at")).otherwise(F.col("last_success")),
            "status": F.when(F.col("_last.ok"), "ok").when(F.col("_last.ok").isNotNull(), "failed").otherwise(F.col("status")),
            "version": F.when(good, F.col("_good.version")).otherwise(F.col("version")),
        }
    ).select(sources.columns)


def refreshed(pages: DataFrame, responses: DataFrame, key: str = "url") -> DataFrame:
    """(key, outcome): what a refresh with conditional requests found.

    pages has key, etag and hash; responses has key, code, etag and hash. 304, or the same hash, is unchanged; 404 and 410
    are gone; other codes than 200 failed; a page without a response is not asked for.
    """
    r = responses.select(key, F.col("code").alias("_c"), F.col("hash").alias("_h"))
    both = pages.select(key, F.col("hash").alias("_o"), F.lit(True).alias("_old")).join(r, key, "full_outer")
    c = F.col("_c")
    outcome = F.when(c.isNull(), "not asked").when(c == 304, "unchanged").when(c.isin(404, 410), "gone").when(c != 200, "failed")
    return both.select(key, outcome.when(F.col("_old").isNull(), "new").when(F.col("_o") == F.col("_h"), "unchanged").otherwise("changed").alias("outcome"))


def report(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by, outcome, n): the counters of a crawl or an ingest."""
    return outcomes.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))
