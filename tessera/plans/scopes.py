"""Scopes of requests and groups over the input tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope
from ..sources import tables as T

GROUPS = [
    ("g0", "Group 0", "{}"),
    ("", "Group 1", '{"allowCrossRootRetrieval":true,"includeRelatedProjectsForPatterns":true,"maxRelatedProjects":1}'),
    ("g2", "Group 2", '{"allowCrossRootRetrieval":false}'),
    ("g3", "Group 3", '{"allowCross'),
    ("g4", "Group 4", '{"allowCrossRootRetrieval": true}'),
]
CUES = [("the", "src0", 80), ("ing", "src1", 75), ("ción", "src2", 85), ("ment", "src3", 70), ("ung", "src1", 60), ("about", "src6", 20), (" of ", "gone", 90)]
ROLES = ["official_documentation", "related_project", "current_project", "related_project", "related_project"]


def groups(spark):
    return spark.createDataFrame(GROUPS, "id string, name string, policies string")


def roots(spark, sf):
    return T.table(spark, sf, "documents").select(F.col("source").alias("root_name")).where("root_name is not null").distinct()


def members(spark, sf):
    """Each source in the group of its number; those that end in 0 or 5 are in the last group too."""
    k = F.regexp_extract("root_name", r"\d+", 0).cast("int")
    role = F.element_at(F.array(*map(F.lit, ROLES)), k % 5 + 1)
    m = roots(spark, sf).select("root_name", k.alias("k"), role.alias("role"), (k % 3).alias("priority"))
    m = m.select(F.explode(F.when(F.col("k") % 5 == 0, F.array(F.col("k") % 6, F.lit(4))).otherwise(F.array(F.col("k") % 6))).alias("g"), "root_name", "role", "priority").where("g < 5")
    return m.select(F.concat(F.lit("Group "), F.col("g").cast("string")).alias("group_name"), "root_name", "role", "priority").distinct()


def requests(spark, sf):
    """Every document as a request: its text, of every third with its source's name; some name roots outright."""
    d = T.table(spark, sf, "documents")
    i, k = F.col("doc_id"), F.regexp_extract("source", r"\d+", 0).cast("int")
    query = F.concat("text", F.when(i % 3 == 0, F.concat(F.lit(" about "), F.upper("source"))).otherwise(""))
    src = lambda n: F.concat(F.lit("src"), n.cast("string"))
    explicit = (
        F.when(i % 5 == 1, F.array("source", F.lit(" "), F.concat(F.lit(" "), src(i % 24), F.lit(" "))))
        .when(i % 5 == 2, F.array("source", src((k + 6) % 20)))
        .when(i % 5 == 3, F.array("source"))
    )
    return d.select(i.alias("request_id"), query.alias("query"), explicit.alias("explicit"))


def resolved_scopes(spark, sf):
    cues = spark.createDataFrame(CUES, "cue string, root string, weight int")
    out = scope.resolve(requests(spark, sf), roots(spark, sf), cues, groups(spark), members(spark, sf))
    return out.select("request_id", F.array_join("roots", ",").alias("roots"), "group", "reason", "detail", F.array_join("hints", "|").alias("hints"))


def expanded_groups(spark, sf):
    """Every document asks for a group, with its source and its neighbour preferred, or a project."""
    i, k = F.col("doc_id"), F.regexp_extract("source", r"\d+", 0).cast("int")
    name = F.when(i % 7 == 6, "gone").when(i % 2 == 0, F.concat(F.lit(" GROUP "), (k % 5).cast("string"))).otherwise(F.concat(F.lit("g"), (i % 5).cast("string")))
    liked = F.array("source", F.concat(F.lit(" src"), ((i + 1) % 20).cast("string")), F.lit("src4"))
    asks = T.table(spark, sf, "documents").select(i.alias("ask_id"), name.alias("group"), liked.alias("preferred"), F.when(i % 4 == 0, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("project"), (i % 3 == 0).alias("only_preferred"))
    out = scope.expand(asks, groups(spark), members(spark, sf), roots(spark, sf))
    return out.select("ask_id", "group", F.array_join("roots", ",").alias("roots"), "reason")


_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_policy = lambda k, d: f"CASE WHEN plain THEN {d} ELSE coalesce(CAST(json_extract(js, '$.{k}') AS {'INT' if isinstance(d, int) and not isinstance(d, bool) else 'BOOLEAN'}), CAST(0 AS {'INT' if isinstance(d, int) and not isinstance(d, bool) else 'BOOLEAN'})) END AS {k}"
TABLES_SQL = f"""roots AS (SELECT DISTINCT source AS root_name, CAST(regexp_extract(source, '[0-9]+') AS INT) AS k FROM documents WHERE source IS NOT NULL),
 groups0(gid, name, policies) AS (VALUES {_values(GROUPS)}),
 groups AS (SELECT name, CASE WHEN gid = '' THEN name ELSE gid END AS id, {", ".join(_policy(k, v) for k, v in scope.POLICIES.items())}
   FROM (SELECT *, policies IN ('', '{{}}') OR NOT json_valid(policies) AS plain, CASE WHEN json_valid(policies) THEN policies ELSE '{{}}' END AS js FROM groups0)),
 members AS (SELECT DISTINCT 'Group ' || g AS name, root_name, ({ROLES!r})[k % 5 + 1] AS role, k % 3 AS priority
   FROM (SELECT *, unnest(CASE WHEN k % 5 = 0 THEN [k % 6, 4] ELSE [k % 6] END) AS g FROM roots) WHERE g < 5),
 placed AS (SELECT *, row_number() OVER (PARTITION BY name, role ORDER BY priority DESC, root_name) AS place FROM members JOIN groups USING (name))"""


def expand_sql(asks: str) -> str:
    """expanded: (ask_id, id, roots, reason) of asks (ask_id, key, preferred, project, sole)."""
    return f"""asks AS ({asks}), named AS (SELECT * FROM asks LEFT JOIN groups g ON lower(g.id) = asks.key OR lower(g.name) = asks.key),
 rows AS (SELECT n.*, p.root_name, p.priority, CASE WHEN p.role <> 'related_project' THEN [0, -p.priority] WHEN n.preferCurrentProjectWhenSpecified AND p.root_name = n.project THEN [1, 0]
   WHEN list_contains(preferred, p.root_name) THEN [2, list_position(preferred, p.root_name)]
   WHEN n.includeRelatedProjectsForPatterns AND p.place <= n.maxRelatedProjects THEN [3, p.place] END AS rank
   FROM named n JOIN placed p ON p.name = n.name WHERE n.allowCrossRootRetrieval),
 found AS (SELECT ask_id, CASE WHEN bool_or(sole AND list_contains(preferred, root_name)) THEN list(root_name ORDER BY root_name) FILTER (WHERE list_contains(preferred, root_name) OR root_name = project)
   WHEN count(rank) > 0 THEN list(root_name ORDER BY rank, root_name) FILTER (WHERE rank IS NOT NULL) ELSE list(root_name ORDER BY priority DESC, root_name) END AS roots FROM rows GROUP BY ask_id),
 expanded AS (SELECT ask_id, id, coalesce(roots, []) AS roots, CASE WHEN id IS NULL THEN 'unknown_group' WHEN NOT allowCrossRootRetrieval THEN 'forbidden' WHEN roots IS NULL THEN 'no_members' END AS reason
   FROM named LEFT JOIN found USING (ask_id))"""


ASKS_SQL = """SELECT doc_id AS ask_id, CASE WHEN doc_id % 7 = 6 THEN 'gone' WHEN doc_id % 2 = 0 THEN 'group ' || (CAST(regexp_extract(source, '[0-9]+') AS INT) % 5) ELSE 'g' || (doc_id % 5) END AS key,
 [source, 'src' || ((doc_id + 1) % 20), 'src4'] AS preferred, CASE WHEN doc_id % 4 = 0 THEN 'src' || (doc_id % 20) END AS project, doc_id % 3 = 0 AS sole FROM documents"""
EXPANDED_SQL = f"""WITH {TABLES_SQL}, {expand_sql(ASKS_SQL)} SELECT ask_id, id AS "group", array_to_string(roots, ',') AS roots, reason FROM expanded"""

RESOLVED_SQL = f"""WITH {TABLES_SQL}, cues(cue, root, weight) AS (VALUES {_values(CUES)}),
 {expand_sql("SELECT id AS ask_id, lower(id) AS key, CAST([] AS VARCHAR[]) AS preferred, '' AS project, false AS sole FROM groups")},
 q AS (SELECT doc_id AS request_id, lower(text || CASE WHEN doc_id % 3 = 0 THEN ' about ' || upper(source) ELSE '' END) AS query,
   list_filter(list_transform(CASE doc_id % 5 WHEN 1 THEN [source, ' ', ' src' || (doc_id % 24) || ' '] WHEN 2 THEN [source, 'src' || ((CAST(regexp_extract(source, '[0-9]+') AS INT) + 6) % 20)] WHEN 3 THEN [source] ELSE [] END, lambda x: trim(x)), lambda x: x <> '') AS said FROM documents),
 needles AS (SELECT cue, trim(cue) AS hint, root, weight FROM cues UNION ALL SELECT lower(root_name), 'root:' || root_name, root_name, 100 FROM roots),
 hits AS (SELECT request_id, hint, root, weight, root IN (SELECT root_name FROM roots) AS there FROM q JOIN needles ON contains(query, cue) WHERE len(said) = 0),
 scores AS (SELECT request_id, root, score, max(score) OVER (PARTITION BY request_id) AS top FROM (SELECT request_id, root, sum(weight) AS score FROM hits WHERE there GROUP BY ALL)),
 inferred AS (SELECT request_id, list(root ORDER BY root) AS roots FROM scores WHERE score * 100 >= top * 60 GROUP BY request_id),
 told AS (SELECT request_id, list_sort(list_distinct(list(hint))) AS hints FROM hits GROUP BY request_id),
 r AS (SELECT request_id, said, list_filter(said, lambda x: NOT list_contains(here, x))[1] AS unknown, inferred.roots AS read, hints FROM q CROSS JOIN (SELECT list(root_name) AS here FROM roots) LEFT JOIN inferred USING (request_id) LEFT JOIN told USING (request_id)),
 b AS (SELECT request_id, CASE WHEN len(said) = 0 THEN coalesce(read, []) WHEN unknown IS NULL THEN list_sort(list_distinct(said)) ELSE [] END AS wanted,
   CASE WHEN len(said) = 0 THEN coalesce(hints, []) WHEN unknown IS NULL THEN ['explicit rootName'] ELSE [] END AS hints, unknown, len(said) = 0 AND read IS NULL AS missed FROM r),
 first AS (SELECT root_name, arg_min(id, name) AS key FROM members JOIN groups USING (name) GROUP BY root_name),
 each AS (SELECT request_id, list_sort(list_distinct(coalesce(list(key) FILTER (WHERE key IS NOT NULL), []))) AS keys FROM (SELECT request_id, unnest(wanted) AS root_name FROM b WHERE len(wanted) > 1) LEFT JOIN first USING (root_name) GROUP BY request_id),
 o AS (SELECT b.*, keys, e.id, e.roots AS scope, e.reason AS barred FROM b LEFT JOIN each USING (request_id) LEFT JOIN expanded e ON len(keys) = 1 AND e.ask_id = keys[1])
SELECT request_id, array_to_string(CASE WHEN id IS NOT NULL AND barred IS NULL THEN scope ELSE wanted END, ',') AS roots, CASE WHEN barred IS NULL THEN id END AS "group",
 CASE WHEN unknown IS NOT NULL THEN 'unknown_root' WHEN missed THEN 'not_inferred' WHEN len(keys) > 1 THEN 'several_groups' WHEN barred = 'forbidden' THEN 'forbidden' WHEN len(keys) = 0 THEN 'several_families' END AS reason,
 CASE WHEN unknown IS NOT NULL THEN unknown WHEN len(keys) > 1 THEN array_to_string(keys, ', ') END AS detail,
 array_to_string(CASE WHEN id IS NOT NULL AND barred IS NULL THEN list_append(hints, 'knowledgeGroup:' || id) ELSE hints END, '|') AS hints FROM o"""

QUERIES = {"resolved_scopes": (resolved_scopes, RESOLVED_SQL), "expanded_groups": (expanded_groups, EXPANDED_SQL)}
