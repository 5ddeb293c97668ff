"""Change feeds and logs of request events over the input tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds
from ..sources import tables as T
from ..sources.shared import fresh
from ..streaming import events as S
from ..streaming import requests as R


def changes(spark, sf):
    """Every event as a line of a commit of three; a third of them are of one path."""
    i, u = F.col("event_id"), F.col("user_id")
    path = lambda n: F.concat(F.lit("p"), n.cast("string"))
    one, two = F.when(i % 3 == 0, "hot").otherwise(path(u)), F.when(i % 9 == 1, "hot").otherwise(path((u * 7 + i) % 200))
    kind = F.element_at(F.array(*map(F.lit, ["R100", "R087", "A", "M", "D", "T", "C75"])), (i % 7 + 1).cast("int"))
    line = F.concat_ws("\t", kind, one, F.when(i % 7 < 2, two))
    return T.table(spark, sf, "events").select(F.expr("event_id div 3").alias("seq"), line.alias("line"))


def changed_files(spark, sf):
    """The feed applied in two parts."""
    c, none = changes(spark, sf), spark.createDataFrame([], feeds.FILES)
    return feeds.applied(feeds.applied(none, c.where("seq < 1000")), c.where("seq >= 1000"))


CHANGED_SQL = """WITH RECURSIVE lines AS (SELECT event_id // 3 AS seq, event_id % 7 AS kind, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'p' || user_id END AS one,
   CASE WHEN event_id % 9 = 1 THEN 'hot' ELSE 'p' || ((user_id * 7 + event_id) % 200) END AS two FROM events),
 ev AS (SELECT path, seq, bool_or(there) AS there, bool_or(begins) AS begins, max(source) AS source FROM
   (SELECT one AS path, seq, kind IN (2, 3, 5) AS there, kind = 2 AS begins, NULL AS source FROM lines WHERE kind <> 6 UNION ALL SELECT two, seq, true, true, one FROM lines WHERE kind < 2) GROUP BY path, seq),
 last AS (SELECT path, max(seq) AS seq, arg_max(there, seq) AS there, max(seq) FILTER (WHERE begins) AS born, max(seq) FILTER (WHERE NOT there) AS died FROM ev GROUP BY path),
 edges AS (SELECT e.path, e.seq, e.source, coalesce(max(b.seq), -1) AS prior FROM ev e LEFT JOIN ev b ON b.begins AND b.path = e.source AND b.seq < e.seq WHERE e.source IS NOT NULL GROUP BY ALL),
 chain AS (SELECT path, seq, path AS place, CASE WHEN born IS NULL OR died > born THEN -2 ELSE born END AS place_seq, 0 AS moves FROM last WHERE there
   UNION ALL SELECT c.path, c.seq, e.source, e.prior, c.moves + 1 FROM chain c JOIN edges e ON e.path = c.place AND e.seq = c.place_seq)
SELECT path, seq, arg_max(place, moves) AS origin, CAST(max(moves) AS BIGINT) AS moves FROM chain GROUP BY path, seq"""


def request_log(spark, sf):
    """Every event as a request with roots and evidence, streamed into three tables; then every fourth once more, corrected."""
    at = fresh(spark, "requests")
    i, tokens = F.col("event_id"), F.floor("value").cast("long")
    blank = lambda kind: F.lit(None).cast(kind)
    root = lambda key, name, on: F.struct(key.alias("root_key"), name.alias("root_name"), blank("string").alias("root_group_key"), F.lit(" ").alias("root_role"), on.alias("selected"))
    src = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    roots = F.when(i % 2 == 0, F.array(root(src, F.lit(""), F.lit(True)), root(blank("string"), F.lit("other"), blank("boolean"))))
    evidence = F.transform(
        F.sequence(F.lit(1), (i % 3 + 1).cast("int")),
        lambda k: F.struct(F.lit("curated").alias("evidence_type"), F.concat(F.lit("key-"), k.cast("string")).alias("evidence_key"), F.lit("").alias("root_key"), blank("string").alias("source_uri"), k.alias("rank_position"), F.lit(True).alias("selected_for_package"), (k == 1).alias("included_after_trimming"), (tokens + k).alias("estimated_tokens")),
    )

    def as_requests(events, fixed=False):
        return events.select(
            F.when(i % 11 != 0, i.cast("string")).alias("request_id"),
            F.col("ts").alias("occurred_at"),
            F.lit(" ").alias("session_hash"),
            F.lit("fixed").alias("tool_name") if fixed else F.col("event_type").alias("tool_name"),
            F.lit("ok").alias("result_status"),
            F.lit("high").alias("coverage"),
            tokens.alias("estimated_tokens"),
            F.when(i % 5 == 0, tokens * 2).alias("returned_tokens"),
            F.when(i % 6 == 0, "own").alias("token_estimator_version"),
            roots.alias("roots"),
            (F.slice(evidence, 1, 1) if fixed else evidence).alias("evidence"),
        )

    source = lambda: S.source(spark, sf, "events.parquet")
    R.record(as_requests(source()), f"{at}/log", f"{at}/first")
    R.record(as_requests(source().where(i % 4 == 0), True), f"{at}/log", f"{at}/second", writer="corrections", after=1)
    log = R.RequestLog(spark, f"{at}/log")
    r = log.table("roots").groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("root_key", F.lit("/"), "root_name", F.when(F.col("selected"), "+").otherwise("")))), ",").alias("roots"))
    e = log.table("evidence").groupBy("request_id").agg(F.sum("estimated_tokens").alias("evidence_tokens"), F.count_if("included_after_trimming").alias("included"))
    q = log.table("requests").select("request_id", "tool_name", "session_hash", "estimated_tokens", "returned_tokens", "token_estimator_version")
    return q.join(r, "request_id", "left").join(e, "request_id", "left")


REQUEST_LOG_SQL = """WITH e AS (SELECT event_id AS i, event_type, user_id, CAST(floor(value) AS BIGINT) AS t, CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 3 + 1 END AS n FROM events WHERE event_id % 11 <> 0),
 r AS (SELECT *, CASE WHEN i % 5 = 0 AND t * 2 <> 0 THEN t * 2 ELSE t END AS ret FROM e)
SELECT CAST(i AS VARCHAR) AS request_id, CASE WHEN i % 4 = 0 THEN 'fixed' ELSE event_type END AS tool_name, CAST(NULL AS VARCHAR) AS session_hash, CASE WHEN t = 0 THEN ret ELSE t END AS estimated_tokens, ret AS returned_tokens,
 CASE WHEN i % 6 = 0 THEN 'own' WHEN ret > 0 THEN 'chars_div_4_v1' END AS token_estimator_version,
 CASE WHEN i % 2 = 0 THEN 'other/other,src' || (user_id % 20) || '/src' || (user_id % 20) || '+' END AS roots, CAST(n * t + n * (n + 1) // 2 AS BIGINT) AS evidence_tokens, CAST(1 AS BIGINT) AS included FROM r"""

QUERIES = {"changed_files": (changed_files, CHANGED_SQL), "request_log": (request_log, REQUEST_LOG_SQL)}
