"""Reports over request events: summary, time series, outcomes, efficiency, knowledge and pages of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the reports.
GROUNDED = ("grounded_curated", "grounded_local", "grounded_mixed")
KNOWN_COVERAGE = ("high", "medium", "low", "not_applicable")
MOST_RANKED, MOST_PAGE, WARNING_SHARE, RETENTION_DAYS = 25, 100, 0.20, 90
LABELS = {"curated": "Curated knowledge", "recipe": "Recipes", "symbol": "Symbols/APIs", "citation": "Raw documents", "document": "Raw documents"}

def status() -> Column:
    return F.col("result_status")


def coverage() -> Column:
    return F.col("coverage")


def grounded() -> Column:
    return status().isin(*GROUNDED)


def tokens() -> Column:
    """Tokens that a request returned."""
    return F.coalesce("returned_tokens", F.lit(0))


def served() -> Column:
    return grounded() & (tokens() > 0)


def unclassified() -> Column:
    """Grounded, but of no known coverage."""
    return grounded() & ~F.coalesce(coverage(), F.lit("")).isin(*KNOWN_COVERAGE)


def where(requests: DataFrame, since=None, until=None, tool: str = "", covered: str = "", result: str = "", root: str = "", roots: DataFrame | None = None) -> DataFrame:
    """Requests by time (both ends included), tool, coverage (`unclassified` is a virtual one), status and root."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        cond = cond & (F.col("occurred_at") <= F.lit(until).cast("timestamp"))
    if tool:
        cond = cond & (F.col("tool_name") == tool)
    if covered:
        cond = cond & (unclassified() if covered == "unclassified" else coverage() == covered)
    if result:
        cond = cond & (status() == result)
    out = requests.where(cond)
    return out.join(roots.where(F.col("root_name") == root).select("request_id"), "request_id", "left_semi") if root else out


def n(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)


def summary(requests: DataFrame) -> DataFrame:
    """One row of counts, rates and the reconciliation of outcomes."""
    one = requests.agg(
        F.count(F.lit(1)).alias("total"),
        n(grounded(), "grounded"),
        n((F.col("curated_count") > 0) | (status() == "grounded_curated"), "curated"),
        n(coverage() == "high", "high"),
        n(coverage() == "medium", "medium"),
        n(coverage() == "low", "low"),
        n(unclassified(), "unclassified"),
        n(coverage() == "not_applicable", "not_applicable"),
        n(F.col("root_selection_required") | (status() == "root_selection_required"), "root_selection"),
        n(status() == "no_local_match", "no_match"),
        n(status() == "local_insufficient", "insufficient"),
        n(status() == "request_error", "errors"),
        F.coalesce(F.sum(F.when(served(), tokens())), F.lit(0)).alias("tokens_served"),
        F.round(F.avg(F.when(served(), tokens())), 6).alias("avg_package_tokens"),
    )
    total = F.col("grounded") + F.col("root_selection") + F.col("no_match") + F.col("insufficient") + F.col("errors")
    return one.select(
        "*",
        share("grounded", "total").alias("local_evidence_rate"),
        share("root_selection", "total").alias("root_selection_rate"),
        share("curated", "grounded").alias("curated_rate"),
        share("high", "grounded").alias("high_rate"),
        share("unclassified", "grounded").alias("unclassified_rate"),
        (F.col("unclassified") > WARNING_SHARE * F.col("grounded")).alias("unclassified_warning"),
        total.alias("reconcile_sum"),
        (total == F.col("total")).alias("reconcile_ok"),
    )


def bucket(ts: Column, size: str) -> Column:
    """The label of the hour, day, week (Monday-based, from 00) or month that a time is in."""
    if size == "hour":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:00:00'Z'")
    if size == "month":
        return F.date_format(ts, "yyyy-MM")
    if size == "week":
        week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM-dd")


def timeseries(requests: DataFrame, size: str = "day") -> DataFrame:
    """A row of counts and token sums for each bucket of time."""
    source = F.col("estimated_source_tokens")
    return requests.groupBy(bucket(F.col("occurred_at"), size).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        n(grounded(), "grounded"),
        n(F.col("root_selection_required") | (status() == "root_selection_required"), "root_choice"),
        n(status() == "no_local_match", "no_match"),
        n(status() == "local_insufficient", "insufficient"),
        n(status() == "request_error", "errors"),
        n(coverage() == "high", "high"),
        n(coverage() == "medium", "medium"),
        n(coverage() == "low", "low"),
        F.coalesce(F.sum(F.when(served(), tokens())), F.lit(0)).alias("tokens_served"),
        F.coalesce(F.sum(F.when(source > 0, source)), F.lit(0)).alias("source_tokens"),
        F.round(F.avg(F.when(served(), tokens())), 6).alias("avg_package"),
    )


def outcomes(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: exclusive outcomes with a rest, and overlapping uses of evidence."""
    documents = evidence.where("evidence_type = 'document'").select("request_id", F.lit(True).alias("has_document")).distinct()
    error = status() == "request_error"
    one = requests.join(documents, "request_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        n(error, "errors"),
        n(~error & ((status() == "root_selection_required") | F.col("root_selection_required")), "root_choice"),
        n(status() == "no_local_match", "no_match"),
        n(status() == "local_insufficient", "insufficient"),
        n(status() == "grounded_mixed", "mixed"),
        n(status() == "grounded_curated", "curated"),
        n(status() == "grounded_local", "local"),
        n(F.col("curated_count") > 0, "uses_curated"),
        n(F.col("recipe_count") > 0, "uses_recipe"),
        n(F.col("symbol_count") > 0, "uses_symbol"),
        n(F.col("citation_count") > 0, "uses_raw"),
        n(F.col("has_document"), "uses_document"),
    )
    known = sum((F.col(c) for c in ("root_choice", "no_match", "insufficient", "mixed", "curated", "local")), F.col("errors"))
    return one.withColumn("other", F.greatest(F.col("total") - known, F.lit(0)))


def efficiency(requests: DataFrame) -> DataFrame:
    """One row of token sums and averages over grounded requests; what nothing was measured for is null."""
    when = lambda cond, x: F.when(cond, x)
    source = F.col("estimated_source_tokens")
    one = requests.agg(
        F.sum(when(served(), tokens())).alias("local_tokens"),
        F.sum(when(grounded(), F.col("structured_tokens"))).alias("structured_tokens"),
        F.sum(when(grounded(), F.col("raw_document_tokens"))).alias("raw_tokens"),
        F.sum(when(grounded() & (source > 0), source)).alias("source_tokens"),
        F.round(F.avg(when(served(), tokens())), 6).alias("avg_package_tokens"),
        n(grounded(), "grounded"),
    )
    whole = F.coalesce("structured_tokens", F.lit(0)) + F.coalesce("raw_tokens", F.lit(0))
    some = F.col("local_tokens") > 0
    return one.select(
        "*",
        F.when(some & (whole > 0), F.round(F.coalesce("raw_tokens", F.lit(0)) / whole, 6)).alias("raw_share"),
        F.when(some & (F.col("grounded") > 0), F.round(F.col("local_tokens") / F.col("grounded"), 6)).alias("tokens_per_grounded"),
    )


def evidence_tokens(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """(type, label, tokens) by evidence type, and what the served tokens have beyond as `overhead`."""
    typed = evidence.join(requests.select("request_id"), "request_id").groupBy(F.col("evidence_type").alias("type")).agg(F.sum("estimated_tokens").alias("tokens"))
    label = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in LABELS.items()], F.col("type"))
    local = requests.agg(F.sum(F.when(served(), tokens())).alias("local"))
    rest = local.crossJoin(typed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("typed"))).where("local > typed")  # one row each
    rest = rest.select(F.lit("overhead").alias("type"), F.lit("Mixed package overhead").alias("label"), (F.col("local") - F.col("typed")).alias("tokens"))
    return typed.select("type", label.alias("label"), "tokens").unionByName(rest)


def top_roots(requests: DataFrame, roots: DataFrame, limit: int = MOST_RANKED) -> DataFrame:
    """(key, times_selected, times_included): the most asked roots; ties by name."""
    g = roots.join(requests.select("request_id"), "request_id").groupBy(F.col("root_name").alias("key"))
    return g.agg(F.count(F.lit(1)).alias("times_selected"), n(F.col("selected"), "times_included")).orderBy(F.desc("times_selected"), "key").limit(limit)


def top_evidence(requests: DataFrame, evidence: DataFrame, limit: int = MOST_RANKED) -> DataFrame:
    """(key, label, times_selected, times_included): the most used evidence; ties by key."""
    key = F.coalesce(F.nullif(F.col("evidence_key"), F.lit("")), F.col("evidence_type"))
    g = evidence.join(requests.select("request_id"), "request_id").groupBy(key.alias("key"))
    return g.agg(F.min("evidence_type").alias("label"), F.count(F.lit(1)).alias("times_selected"), n(F.col("included_after_trimming"), "times_included")).orderBy(F.desc("times_selected"), "key").limit(limit)


#: The columns that a page of requests may be sorted by; another one means the first.
SORTABLE = ("occurred_at", "tool_name", "result_status", "coverage", "returned_tokens", "estimated_source_tokens", "citation_count", "curated_count", "symbol_count", "recipe_count")


def page(requests: DataFrame, sort: str = "occurred_at", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of requests in order of a column, ties by id."""
    sort = sort if sort in SORTABLE else SORTABLE[0]
    order = F.col(sort).desc() if descending else F.col(sort).asc()
    return requests.orderBy(order, "request_id").offset(max(offset, 0)).limit(min(max(limit, 1), MOST_PAGE))


def page_total(requests: DataFrame) -> DataFrame:
    """One row: how many requests all pages hold."""
    return requests.agg(F.count(F.lit(1)).alias("total"))


def retained(requests: DataFrame, children: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """The requests not older than the cutoff, and their children."""
    kept = requests.where(F.col("occurred_at") >= cutoff)
    return kept, children.join(kept.select("request_id"), "request_id", "left_semi")


def export_rows(report: DataFrame, section: str) -> DataFrame:
    """A one-row report as (section, key, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in report.columns])
    return report.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.key", "p.value")


def request_detail(requests: DataFrame, roots: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each request with its roots (ordered, distinct) and evidence in order of rank."""
    r = roots.groupBy("request_id").agg(F.array_sort(F.collect_set("root_name")).alias("roots"))
    e = evidence.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_type"))), lambda x: x.evidence_type).alias("evidence"))
    return requests.select("request_id", "result_status").join(r, "request_id", "left").join(e, "request_id", "left")


def apportioned(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, pieces, per_piece): returned tokens over the pieces of evidence, whole and 1 at least."""
    pieces = evidence.groupBy("request_id").agg(F.count(F.lit(1)).alias("pieces"))
    return pieces.join(requests.where("returned_tokens > 0"), "request_id").select("request_id", "pieces", F.greatest(F.expr("returned_tokens div pieces"), F.lit(1)).alias("per_piece"))


def status_of_counts(citations: Column, symbols: Column, recipes: Column, curated: Column, covered: Column) -> Column:
    """The status that a request's counts of evidence amount to."""
    none = (citations == 0) & (symbols == 0) & (recipes == 0)
    has_curated = (curated > 0) | (recipes > 0)
    has_raw = (citations > curated) | ((citations > 0) & (curated == 0))
    return (
        F.when(none & F.coalesce(covered, F.lit("")).isin("low", ""), "no_local_match")
        .when(none, "local_insufficient")
        .when(has_curated & has_raw & (citations > recipes), "grounded_mixed")
        .when(has_curated, "grounded_curated")
        .otherwise("grounded_local")
    )
