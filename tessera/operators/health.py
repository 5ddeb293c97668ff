"""Source health: states, errors and growth of an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import operational_state


def inventory(*sources: DataFrame) -> DataFrame:
    """All kinds of sources as one list (name, kind, status, documents, chunks, last_error, verified_at)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def with_local(inventory: DataFrame, roots: DataFrame) -> DataFrame:
    """The inventory with roots (root_name, documents, chunks) that no source owns, as local ones."""
    rest = roots.join(inventory.select(F.col("name").alias("root_name")), "root_name", "left_anti")
    return inventory.unionByName(rest.select(F.col("root_name").alias("name"), F.lit("local").alias("kind"), F.lit("").alias("status"), "documents", "chunks"), allowMissingColumns=True)


def issues(inventory: DataFrame) -> DataFrame:
    """(name, severity, problem) of sources that failed, are degraded, or have documents without chunks."""
    state = operational_state(F.col("status"), F.col("documents"))
    found = F.array_compact(
        F.array(
            F.when(state == "failed", F.struct(F.lit("error").alias("severity"), F.lit("last run failed").alias("problem"))),
            F.when(state == "degraded", F.struct(F.lit("warning").alias("severity"), F.lit("last run was partial").alias("problem"))),
            F.when((F.col("documents") > 0) & (F.coalesce("chunks", F.lit(0)) == 0), F.struct(F.lit("warning").alias("severity"), F.lit("documents without chunks").alias("problem"))),
        )
    )
    return inventory.select("name", F.explode(found).alias("i")).select("name", "i.*")


def dashboard(inventory: DataFrame) -> DataFrame:
    """One row: sources that are fine, failed, and all of them."""
    state = operational_state(F.col("status"), F.col("documents"))
    return inventory.agg(F.count_if(state == "ok").alias("ok"), F.count_if(state == "failed").alias("failed"), F.count(F.lit(1)).alias("sources"))


def recent_errors(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Pages with an error, the last verified first; ties by the larger id."""
    return pages.where(F.trim(F.coalesce("last_error", F.lit(""))) != "").orderBy(F.desc("verified_at"), F.desc("id")).limit(limit)


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """(root_name, documents, chunks, symbols): what each root gained between two counts."""
    b = before.select("root_name", *[F.col(c).alias(f"_{c}") for c in ("documents", "chunks", "symbols")])
    out = after.join(b, "root_name", "full_outer").na.fill(0)
    return out.select("root_name", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in ("documents", "chunks", "symbols")])
