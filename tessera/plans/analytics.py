"""Reports over request events, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, usage
from ..sources import tables as T
from ..sources.shared import fresh
from ..sources.tables import EVIDENCE_SQL, REQUESTS_SQL, ROOTS_SQL
from ..streaming import events as S

G = "(result_status IN ('grounded_curated', 'grounded_local', 'grounded_mixed'))"
TOK = "coalesce(returned_tokens, 0)"
SERVED = f"({G} AND {TOK} > 0)"
UNC = f"({G} AND coalesce(coverage, '') NOT IN ('high', 'medium', 'low', 'not_applicable'))"


def n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


def buckets(expr: str) -> str:
    return f"""WITH {REQUESTS_SQL} SELECT {expr} AS bucket, count(*) AS total, {n(G, "grounded")}, {n("root_selection_required OR result_status = 'root_selection_required'", "root_choice")},
 {n("result_status = 'no_local_match'", "no_match")}, {n("result_status = 'local_insufficient'", "insufficient")}, {n("result_status = 'request_error'", "errors")},
 {n("coverage = 'high'", "high")}, {n("coverage = 'medium'", "medium")}, {n("coverage = 'low'", "low")},
 CAST(coalesce(sum({TOK}) FILTER (WHERE {SERVED}), 0) AS BIGINT) AS tokens_served, CAST(coalesce(sum(estimated_source_tokens) FILTER (WHERE estimated_source_tokens > 0), 0) AS BIGINT) AS source_tokens,
 round(avg({TOK}) FILTER (WHERE {SERVED}), 6) AS avg_package FROM requests GROUP BY 1"""


SUMMARY_SQL = f"""WITH {REQUESTS_SQL}, s AS (SELECT count(*) AS total, {n(G, "grounded")}, {n("curated_count > 0 OR result_status = 'grounded_curated'", "curated")},
 {n("coverage = 'high'", "high")}, {n("coverage = 'medium'", "medium")}, {n("coverage = 'low'", "low")}, {n(UNC, "unclassified")}, {n("coverage = 'not_applicable'", "not_applicable")},
 {n("root_selection_required OR result_status = 'root_selection_required'", "root_selection")}, {n("result_status = 'no_local_match'", "no_match")},
 {n("result_status = 'local_insufficient'", "insufficient")}, {n("result_status = 'request_error'", "errors")},
 CAST(coalesce(sum({TOK}) FILTER (WHERE {SERVED}), 0) AS BIGINT) AS tokens_served, round(avg({TOK}) FILTER (WHERE {SERVED}), 6) AS avg_package_tokens FROM requests)
SELECT *, round(grounded / total, 6) AS local_evidence_rate, round(root_selection / total, 6) AS root_selection_rate, round(curated / grounded, 6) AS curated_rate,
 round(high / grounded, 6) AS high_rate, round(unclassified / grounded, 6) AS unclassified_rate, unclassified > 0.2 * grounded AS unclassified_warning,
 grounded + root_selection + no_match + insufficient + errors AS reconcile_sum, grounded + root_selection + no_match + insufficient + errors = total AS reconcile_ok FROM s"""

OUTCOMES_SQL = f"""WITH {REQUESTS_SQL}, {EVIDENCE_SQL}, s AS (SELECT count(*) AS total, {n("result_status = 'request_error'", "errors")},
 {n("result_status <> 'request_error' AND (result_status = 'root_selection_required' OR root_selection_required)", "root_choice")}, {n("result_status = 'no_local_match'", "no_match")},
 {n("result_status = 'local_insufficient'", "insufficient")}, {n("result_status = 'grounded_mixed'", "mixed")}, {n("result_status = 'grounded_curated'", "curated")}, {n("result_status = 'grounded_local'", "local")},
 {n("curated_count > 0", "uses_curated")}, {n("recipe_count > 0", "uses_recipe")}, {n("symbol_count > 0", "uses_symbol")}, {n("citation_count > 0", "uses_raw")},
 {n("request_id IN (SELECT request_id FROM evidence WHERE evidence_type = 'document')", "uses_document")} FROM requests)
SELECT *, greatest(total - (errors + root_choice + no_match + insufficient + mixed + curated + local), 0) AS other FROM s"""

EFFICIENCY_SQL = f"""WITH {REQUESTS_SQL}, s AS (SELECT CAST(sum({TOK}) FILTER (WHERE {SERVED}) AS BIGINT) AS local_tokens, CAST(sum(structured_tokens) FILTER (WHERE {G}) AS BIGINT) AS structured_tokens,
 CAST(sum(raw_document_tokens) FILTER (WHERE {G}) AS BIGINT) AS raw_tokens, CAST(sum(estimated_source_tokens) FILTER (WHERE {G} AND estimated_source_tokens > 0) AS BIGINT) AS source_tokens,
 round(avg({TOK}) FILTER (WHERE {SERVED}), 6) AS avg_package_tokens, {n(G, "grounded")} FROM requests)
SELECT *, CASE WHEN local_tokens > 0 AND structured_tokens + raw_tokens > 0 THEN round(raw_tokens / (structured_tokens + raw_tokens), 6) END AS raw_share,
 CASE WHEN local_tokens > 0 AND grounded > 0 THEN round(local_tokens / grounded, 6) END AS tokens_per_grounded FROM s"""

TOKENS_SQL = f"""WITH {REQUESTS_SQL}, {EVIDENCE_SQL}, t AS (SELECT evidence_type AS type, CAST(sum(estimated_tokens) AS BIGINT) AS tokens FROM evidence JOIN requests USING (request_id) GROUP BY 1)
SELECT type, CASE type WHEN 'curated' THEN 'Curated knowledge' WHEN 'recipe' THEN 'Recipes' WHEN 'symbol' THEN 'Symbols/APIs' ELSE 'Raw documents' END AS label, tokens FROM t
UNION ALL SELECT 'overhead', 'Mixed package overhead', CAST(l - s AS BIGINT) FROM (SELECT sum({TOK}) FILTER (WHERE {SERVED}) AS l FROM requests), (SELECT sum(tokens) AS s FROM t) WHERE l > s"""

STATUS_SQL = f"""WITH {REQUESTS_SQL} SELECT CASE WHEN citation_count = 0 AND symbol_count = 0 AND recipe_count = 0 THEN CASE WHEN coalesce(coverage, '') IN ('low', '') THEN 'no_local_match' ELSE 'local_insufficient' END
 WHEN (curated_count > 0 OR recipe_count > 0) AND (citation_count > curated_count OR citation_count > 0 AND curated_count = 0) AND citation_count > recipe_count THEN 'grounded_mixed'
 WHEN curated_count > 0 OR recipe_count > 0 THEN 'grounded_curated' ELSE 'grounded_local' END AS status, count(*) AS n FROM requests GROUP BY 1"""


def filtered(spark, sf):
    """A filtered summary: one tool, one root, the first half of the month."""
    r = usage.where(T.requests(spark, sf), "2024-01-01", "2024-01-15", tool="click", root="src3", roots=T.request_roots(spark, sf))
    return usage.summary(r).select("total", "grounded", "errors", "tokens_served")


def unclassified(spark, sf):
    return usage.where(T.requests(spark, sf), covered="unclassified").groupBy("result_status").agg(F.count(F.lit(1)).alias("n"))


def retention(spark, sf):
    r, e = usage.retained(T.requests(spark, sf), T.evidence(spark, sf), F.lit("2024-01-20").cast("timestamp"))
    return r.agg(F.count(F.lit(1)).alias("requests")).crossJoin(e.agg(F.count(F.lit(1)).alias("evidence")))  # one row each


def detail(spark, sf):
    d = usage.request_detail(T.requests(spark, sf), T.request_roots(spark, sf), T.evidence(spark, sf))
    return d.select("request_id", "result_status", F.array_join("roots", ",").alias("roots"), F.array_join("evidence", ",").alias("evidence"))


def status_counts(spark, sf):
    s = usage.status_of_counts(F.col("citation_count"), F.col("symbol_count"), F.col("recipe_count"), F.col("curated_count"), F.col("coverage"))
    return T.requests(spark, sf).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def streamed(spark, sf, transform):
    """A stream over `events` run to its end, read back as a table."""
    at = fresh(spark, "stream")
    out = transform(S.source(spark, sf, "events.parquet"))
    S.run_to_table(out, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def replaced(spark, sf, transform, *key):
    """A stream over `events` run to its end, rows replacing earlier ones of their key, read back as a table."""
    at = fresh(spark, "stream")
    out = transform(S.source(spark, sf, "events.parquet"))
    S.run_latest(out, f"{at}/out", f"{at}/checkpoint")
    return S.latest(spark, f"{at}/out", out.schema, *key)


QUERIES = {
    "usage_summary": (lambda s, d: usage.summary(T.requests(s, d)), SUMMARY_SQL),
    "usage_summary_filtered": (filtered, f"""WITH {REQUESTS_SQL}, {ROOTS_SQL} SELECT count(*) AS total, {n(G, "grounded")}, {n("result_status = 'request_error'", "errors")}, CAST(coalesce(sum({TOK}) FILTER (WHERE {SERVED}), 0) AS BIGINT) AS tokens_served
      FROM requests WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at <= TIMESTAMP '2024-01-15' AND tool_name = 'click' AND request_id IN (SELECT request_id FROM request_roots WHERE root_name = 'src3')"""),
    "usage_unclassified": (unclassified, f"WITH {REQUESTS_SQL} SELECT result_status, count(*) AS n FROM requests WHERE {UNC} GROUP BY 1"),
    "usage_timeseries_hour": (lambda s, d: usage.timeseries(T.requests(s, d), "hour"), buckets("strftime(occurred_at, '%Y-%m-%dT%H:00:00Z')")),
    "usage_timeseries_day": (lambda s, d: usage.timeseries(T.requests(s, d), "day"), buckets("strftime(occurred_at, '%Y-%m-%d')")),
    "usage_timeseries_week": (lambda s, d: usage.timeseries(T.requests(s, d), "week"), buckets("strftime(occurred_at, '%Y-W%W')")),
    "usage_timeseries_month": (lambda s, d: usage.timeseries(T.requests(s, d), "month"), buckets("strftime(occurred_at, '%Y-%m')")),
    "usage_outcomes": (lambda s, d: usage.outcomes(T.requests(s, d), T.evidence(s, d)), OUTCOMES_SQL),
    "usage_efficiency": (lambda s, d: usage.efficiency(T.requests(s, d)), EFFICIENCY_SQL),
    "usage_evidence_tokens": (lambda s, d: usage.evidence_tokens(T.requests(s, d), T.evidence(s, d)), TOKENS_SQL),
    "usage_top_roots": (lambda s, d: usage.top_roots(T.requests(s, d), T.request_roots(s, d)), f"WITH {REQUESTS_SQL}, {ROOTS_SQL} SELECT root_name AS key, count(*) AS times_selected, count(*) FILTER (WHERE selected) AS times_included FROM request_roots JOIN requests USING (request_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
    "usage_top_evidence": (lambda s, d: usage.top_evidence(T.requests(s, d), T.evidence(s, d)), f"WITH {REQUESTS_SQL}, {EVIDENCE_SQL} SELECT coalesce(nullif(evidence_key, ''), evidence_type) AS key, min(evidence_type) AS label, count(*) AS times_selected, count(*) FILTER (WHERE included_after_trimming) AS times_included FROM evidence JOIN requests USING (request_id) GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25"),
    "usage_requests_page": (lambda s, d: usage.page(T.requests(s, d), "returned_tokens", True, 40, 20).select("request_id", "tool_name", "returned_tokens"), f"WITH {REQUESTS_SQL} SELECT request_id, tool_name, returned_tokens FROM requests ORDER BY returned_tokens DESC NULLS LAST, request_id LIMIT 40 OFFSET 20"),
    "usage_retention": (retention, f"WITH {REQUESTS_SQL}, {EVIDENCE_SQL} SELECT (SELECT count(*) FROM requests WHERE occurred_at >= TIMESTAMP '2024-01-20') AS requests, (SELECT count(*) FROM evidence WHERE request_id IN (SELECT request_id FROM requests WHERE occurred_at >= TIMESTAMP '2024-01-20')) AS evidence"),
    "usage_export": (lambda s, d: usage.export_rows(usage.outcomes(T.requests(s, d), T.evidence(s, d)), "outcomes"), OUTCOMES_SQL.replace("SELECT *, greatest", ", o AS (SELECT *, greatest") + ") SELECT 'outcomes' AS section, key, CAST(value AS VARCHAR) AS value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME key VALUE value)"),
    "usage_request_detail": (detail, f"WITH {REQUESTS_SQL}, {EVIDENCE_SQL}, {ROOTS_SQL} SELECT request_id, result_status, (SELECT string_agg(DISTINCT root_name, ',' ORDER BY root_name) FROM request_roots r WHERE r.request_id = q.request_id) AS roots, (SELECT string_agg(evidence_type, ',' ORDER BY rank) FROM evidence e WHERE e.request_id = q.request_id) AS evidence FROM requests q"),
    "usage_apportioned": (lambda s, d: usage.apportioned(T.evidence(s, d), T.requests(s, d)), f"WITH {REQUESTS_SQL}, {EVIDENCE_SQL} SELECT request_id, pieces, greatest(returned_tokens // pieces, 1) AS per_piece FROM (SELECT request_id, count(*) AS pieces FROM evidence GROUP BY 1) JOIN requests USING (request_id) WHERE returned_tokens > 0"),
    "usage_status_of_counts": (status_counts, STATUS_SQL),
    "percentile_floor": (lambda s, d: corpus.percentile_floor(T.table(s, d, "events"), "value", 0.95, "event_type"), "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p FROM events GROUP BY 1"),
    "stream_tumbling_counts": (lambda s, d: replaced(s, d, S.tumbling, "start", "event_type"), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_sliding_counts": (lambda s, d: replaced(s, d, S.sliding, "start"), "SELECT date_trunc('hour', ts) - to_hours(o) AS start, count(*) AS n FROM events, (SELECT unnest(range(6)) AS o) GROUP BY ALL"),
    "event_sessions": (lambda s, d: S.sessions(T.table(s, d, "events")), """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM
      (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s"""),
    "stream_dedupe": (lambda s, d: streamed(s, d, lambda e: S.deduplicated(e.select("event_id", "ts", "event_type"))).select("event_id", "event_type"), "SELECT DISTINCT event_id, event_type FROM events"),
}
