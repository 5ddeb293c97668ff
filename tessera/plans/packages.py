"""Packages, health, playbooks and scopes over the input tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, code, keyed, text
from ..functions.excerpts import CALLS
from ..operators import context, corpus, evaluate, health, packages, playbook, recipes, symbols
from ..operators.index import set_down
from ..sources import files
from ..sources import tables as T
from ..sources.tables import CHUNKS_SQL, REQUESTS_SQL, SYMBOLS_SQL
from .retrieval import KIND_SQL, RANK_SQL, content_sql


def health_issues(spark, sf):
    """Sources of documents as an inventory: status by name, chunks missing from some."""
    d = T.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("m"))
    states = F.element_at(F.array(*map(F.lit, ["ok", "failed: x", "partial", "", "running"])), (F.col("m") % 5 + 1).cast("int"))
    return health.issues(d.select("name", F.lit("web").alias("kind"), states.alias("status"), "documents", F.when(F.col("m") % 4 == 0, 0).otherwise(F.col("documents")).alias("chunks")))


HEALTH_SQL = """WITH d AS (SELECT source AS name, min(doc_id) AS m FROM documents GROUP BY 1)
SELECT name, 'error' AS severity, 'last run failed' AS problem FROM d WHERE m % 5 = 1 UNION ALL SELECT name, 'warning', 'last run was partial' FROM d WHERE m % 5 = 2
UNION ALL SELECT name, 'warning', 'documents without chunks' FROM d WHERE m % 4 = 0"""


def growth(spark, sf):
    c = T.chunks(spark, sf)
    count = lambda x: corpus.root_counts(x.select("document_id", "root_name").distinct(), x, x.where("chunk_id % 3 = 0"))
    return health.growth(count(c.where("chunk_id % 2 = 0")), count(c))


GROWTH_SQL = f"""WITH {CHUNKS_SQL}, a AS (SELECT root_name, count(DISTINCT document_id) AS d, count(*) AS c, count(*) FILTER (WHERE chunk_id % 3 = 0) AS s FROM chunks GROUP BY 1),
 b AS (SELECT root_name, count(DISTINCT document_id) AS d, count(*) AS c, count(*) FILTER (WHERE chunk_id % 3 = 0) AS s FROM chunks WHERE chunk_id % 2 = 0 GROUP BY 1)
SELECT root_name, a.d - coalesce(b.d, 0) AS documents, a.c - coalesce(b.c, 0) AS chunks, a.s - coalesce(b.s, 0) AS symbols FROM a LEFT JOIN b USING (root_name)"""


def playbook_queries(spark, sf):
    """All queries of all subjects."""
    return playbook.queries(T.table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("subject")))


PLAYBOOK_SQL = f"""WITH s AS (SELECT p_partkey AS qid, trim(p_name) AS s, {content_sql("p_name")} AS ws FROM part),
 q AS (SELECT qid, list_concat([{{'q': s, 'w': 8.0::DOUBLE}}, {{'q': s || ' example', 'w': 5.0::DOUBLE}}, {{'q': s || ' sample', 'w': 5.0::DOUBLE}}],
   list_transform(list_filter(ws, lambda x, i: list_position(ws, x) = i), lambda x: {{'q': x, 'w': 1.0::DOUBLE}})) AS qs FROM s),
 u AS (SELECT qid, unnest(qs) AS q, unnest(range(len(qs))) AS part FROM q)
SELECT qid, CAST(part AS INT) AS part, q.q AS query, q.w AS weight FROM u"""


def playbook_apis(spark, sf):
    s = T.symbols(spark, sf)
    t = s.select((F.col("id") % 5).alias("qid"), F.concat(text.unqualified(F.col("name")), F.lit("() make_call (1) TestCall(2) and RetryPolicy; "), "name", F.lit(" ("), F.col("id").cast("string"), F.lit(")")).alias("text"), F.when(F.col("id") % 3 == 0, "sample").otherwise("guide").alias("kind"))
    q = t.select("qid").distinct().withColumn("subject", F.lit("make_call of a thing"))
    return playbook.frequent_apis(t, q)


APIS_SQL = rf"""WITH {SYMBOLS_SQL}, b AS (SELECT id, name, regexp_replace(trim(name), '\(\)$', '') AS n FROM symbols),
 u AS (SELECT id % 5 AS qid, CASE WHEN id % 3 = 0 THEN 3 ELSE 1 END AS w, (CASE WHEN contains(n, '::') THEN split_part(n, '::', -1) WHEN contains(n, '.') THEN split_part(n, '.', -1) WHEN contains(n, '#') THEN split_part(n, '#', -1) ELSE n END) || '() make_call (1) TestCall(2) and RetryPolicy; ' || name || ' (' || id || ')' AS t FROM b),
 x AS (SELECT qid, w, api FROM (SELECT qid, w, unnest(list_concat(regexp_extract_all(t, '{CALLS[0]}', 1), regexp_extract_all(t, '{CALLS[1]}', 1))) AS api FROM u) WHERE lower(api) NOT IN ({", ".join(f"'{x}'" for x in playbook.NOISE)}) AND NOT starts_with(lower(api), 'test') AND NOT starts_with(lower(api), 'dialog')),
 g AS (SELECT qid, api, CAST(sum(w) + CASE WHEN contains('make_call of a thing', lower(api)) THEN 6 ELSE 0 END AS BIGINT) AS n FROM x GROUP BY qid, api)
SELECT qid, CAST(r AS INT) AS rank, api, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, api) AS r FROM g) WHERE r <= 10"""


def group_recall(spark, sf):
    """Chunks of all roots as hits of one query in each language, roles raising scores."""
    h = T.chunks(spark, sf).select(F.col("language").alias("qid"), "chunk_id", "root_name", (F.char_length("body") % 97).cast("double").alias("score"))
    roles = spark.createDataFrame([("src0", "official_docs"), ("src1", "current_project"), ("src2", "curated_knowledge")], "root_name string, role string")
    return context.group_hits(h, roles, "src3", 2, 8).select("qid", "chunk_id", "score")


RECALL_SQL = f"""WITH {CHUNKS_SQL}, h AS (SELECT language AS qid, chunk_id, root_name, CAST(length(body) % 97 + CASE root_name WHEN 'src0' THEN 2 WHEN 'src1' THEN 1 WHEN 'src2' THEN 1 WHEN 'src3' THEN 4 ELSE 0 END AS DOUBLE) AS score FROM chunks)
SELECT qid, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, root_name ORDER BY score DESC, chunk_id) AS r, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS o FROM h) WHERE r <= 2 OR o <= 8"""


def recipe_search(spark, sf):
    """Benchmark items as recipes about a word."""
    b = T.table(spark, sf, "benchmark").select(F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("uri"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("subject"), F.lit("Go Net").alias("technology"), F.lit("go").alias("language"), F.col("text").alias("body"), F.when(F.col("item_id") % 3 == 0, "human_reviewed").otherwise("generated").alias("review_status"), F.lit("src0").alias("root_name"), (F.col("item_id") % 7).alias("created_at"))
    return recipes.search(b, "THE", technology="net", roots=["src0"], limit=12).select("uri", "review_status", "created_at")


RECIPE_SQL = """SELECT 'u' || item_id AS uri, CASE WHEN item_id % 3 = 0 THEN 'human_reviewed' ELSE 'generated' END AS review_status, item_id % 7 AS created_at FROM benchmark
WHERE contains(lower(text), 'the') ORDER BY CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END, item_id % 7 DESC, 'u' || item_id LIMIT 12"""


def enriched(spark, sf):
    """Page paths with metadata of the folders that hold them, an index and front matter."""
    p = T.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://(.*)$", 1).alias("path"))
    p = p.groupBy("path").agg(F.min("page_id").alias("page_id"))  # of pages at one path the first
    top = p.select(F.regexp_extract("path", "^([^/]*)", 1).alias("folder")).distinct().select(F.lit(0).alias("pos"), F.concat(F.lit("host:"), "folder").alias("id"), F.col("folder").alias("name"), F.lit("L1").alias("level"), "folder", F.lit("draft").alias("doc_status"))
    deep = p.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().select(F.lit(1).alias("pos"), F.concat(F.lit("dir:"), "folder").alias("id"), F.lit("").alias("name"), F.lit("L2").alias("level"), "folder", F.lit("verified").alias("doc_status"))
    ix = p.where("page_id % 2 = 0").select("path", F.lit("ix").alias("id"), F.lit("Index").alias("component"), F.lit("L3").alias("level"), F.lit("inferred").alias("status"))
    fm = p.where("page_id % 5 = 0").select("path", F.lit("deprecated").alias("status"))
    return packages.enrich(p, top.where("folder like '%a%'").unionByName(deep.where("folder like '%e%'")), ix, fm)


ENRICH_SQL = r"""WITH p AS (SELECT min(page_id) AS page_id, path FROM (SELECT page_id, regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages) GROUP BY path),
 h AS (SELECT path, page_id, regexp_extract(path, '^([^/]*)', 1) AS host, regexp_replace(path, '/[^/]*$', '') AS dir FROM p),
 d AS (SELECT h.path, list(f.dir ORDER BY f.dir DESC) AS ds FROM h JOIN (SELECT DISTINCT dir FROM h WHERE contains(dir, 'e')) f ON h.path = f.dir OR starts_with(h.path, f.dir || '/') GROUP BY h.path)
SELECT path, CASE WHEN ds IS NOT NULL THEN 'dir' WHEN contains(host, 'a') THEN 'host' WHEN page_id % 2 = 0 THEN 'ix' END AS kind,
 CASE WHEN contains(host, 'a') THEN host WHEN page_id % 2 = 0 THEN 'Index' END AS component, CASE WHEN contains(host, 'a') THEN 'L1' WHEN ds IS NOT NULL THEN 'L2' WHEN page_id % 2 = 0 THEN 'L3' END AS level,
 CASE WHEN page_id % 5 = 0 THEN 'deprecated' WHEN contains(host, 'a') THEN 'draft' WHEN ds IS NOT NULL THEN 'verified' WHEN page_id % 2 = 0 THEN 'inferred' END AS status FROM h LEFT JOIN d USING (path)"""


def metadata_enrich(spark, sf):
    e = enriched(spark, sf)
    return e.select("path", F.substring_index("id", ":", 1).alias("kind"), "component", "level", "status")


def robots_filter(spark, sf):
    rules = files.robots_rules("User-agent: *\nDisallow: /docs\nDisallow: /a\n", "tessera")
    return T.table(spark, sf, "pages").select("page_id", files.crawlable(F.col("url"), rules).alias("ok"))


#: Sources in eight languages, # standing for a part's number, and their symbols: name, kind, line.
SOURCES = (
    ("go", "go", "package p\n// func No() {}\nfunc Make#(x int) {\n}\nfunc (s *S) Stop#() {\n}", (("Make#", "function", 3), ("Stop#", "method", 5))),
    ("py", "python", "def make_#(x):\n    pass\nclass Part#:\n    async def go_#(self): pass", (("make_#", "function", 1), ("Part#", "type", 3), ("go_#", "method", 4))),
    ("c", "c", "int init_#(void) {\n  Bus::run_#(1);\n}\nvoid later_#(int a);\n#define MOST_# 4", (("init_#", "function", 1), ("Bus::run_#", "call", 2), ("later_#", "declaration", 4), ("MOST_#", "macro", 5))),
    ("hpp", "cpp", "template<typename T, typename U = std::vector<std::pair<int, T>>>\nclass Box# {};\nbool Less#(int a, int b) { return a<b;\n}\nvoid ns::Open#() {\n}", (("Box#", "type", 2), ("Less#", "function", 3), ("ns::Open#", "method", 5))),
    ("cs", "csharp", "public class Net# {\n  public async Task<List<int>> Go#(string h) {\n  }\n}", (("Net#", "type", 1), ("Go#", "method", 2))),
    ("java", "java", "public class Ja# {\n  public void run#(int a) {\n  }\n  Status stop#();\n}", (("Ja#", "type", 1), ("run#", "method", 2), ("stop#", "declaration", 4))),
    ("ts", "typescript", "export class Cl# {\n  open#(a: string): void {\n  }\n}\nexport const make# = async (a) => 1;", (("Cl#", "type", 1), ("open#", "method", 2), ("make#", "function", 5))),
    ("js", "javascript", "function old#() {}\nif (x) {\n}", (("old#", "function", 1),)),
)


#: Sources whose symbols a task reads off.
TASK_SOURCES = 10_000


def code_symbols(spark, sf):
    """Symbols of made-up sources, one for each part, in eight languages."""
    n = F.col("p_partkey").cast("string")
    texts = [F.replace(F.lit(text.replace("#define", "\x01define")), F.lit("#"), n) for _, _, text, _ in SOURCES]
    which = (F.col("p_partkey") % len(SOURCES) + 1).cast("int")
    path = F.concat(F.lit("p"), n, F.lit("."), F.element_at(F.array(*[F.lit(e) for e, *_ in SOURCES]), which))
    parts = T.table(spark, sf, "part").select("p_partkey")
    parts = parts.repartition(max(1, -(-parts.count() // TASK_SOURCES)), "p_partkey")  # narrow rows in few files, but each a text to be read
    return code.extract(parts.select(path.alias("path"), F.replace(F.element_at(F.array(*texts), which), F.lit("\x01"), F.lit("#")).alias("text")))


def code_sql() -> str:
    rows = []
    for k, (ending, language, source, symbols_of) in enumerate(SOURCES):
        for name, kind, line in symbols_of:
            signature = name + "()" if kind == "call" else source.split("\n")[line - 1].strip().replace("#define", "\x01define")
            value = lambda x: "replace(replace('" + x.replace("'", "''").replace("\x01", "' || chr(1) || '") + "', '#', CAST(p_partkey AS VARCHAR)), chr(1), '#')"
            rows.append(f"SELECT 'p' || p_partkey || '.{ending}' AS path, {value(name)} AS name, '{kind}' AS kind, '{language}' AS language, {value(signature)} AS signature, {line} AS line FROM part WHERE p_partkey % {len(SOURCES)} = {k}")
    return " UNION ALL ".join(rows)


def evaluation(spark, sf):
    """Benchmark items as tasks: the documents that hold them, and the symbols that each item's number names, against those expected.

    Symbols are looked up by name; every third task asks for a symbol that is not there, every fifth forbids the one found.
    """
    b, d = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("needle")), T.table(spark, sf, "documents")
    held = evaluate.containing(d.where("text is not null"), b, T.index(spark, sf))
    hit = held.groupBy("id").agg(F.collect_set(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."))).alias("sources"))
    s = T.symbols(spark, sf)
    named = set_down(s.join(b.select("id"), "id").select(F.col("id").alias("qid"), "name"), "named")
    found = s.select("id", "name").join(set_down(symbols.find(s, named, 3), "symbols"), "id").groupBy(F.col("qid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("symbols"))
    own = named.select(F.col("qid").alias("id"), "name")
    none = F.array().cast("array<string>")
    asked = F.when(F.col("name").isNull(), none).when(F.col("id") % 3 == 0, F.array(F.lit("no such symbol"))).otherwise(F.array("name"))
    tasks = b.join(own, "id", "left").select("id", asked.alias("expected_symbols"), F.array(F.lit("doc-")).alias("expected_sources"), F.when((F.col("id") % 5 == 0) & F.col("name").isNotNull(), F.array("name")).otherwise(none).alias("forbidden_symbols"))
    res = b.select("id", F.char_length("needle").alias("tokens")).join(hit, "id", "left").join(found, "id", "left")
    m = evaluate.metrics(evaluate.judge(res, tasks))
    return m.select("tasks", *[F.round(c, 6).alias(c) for c in ("top1_recall", "top3_recall", "source_recall")], "forbidden_hits", F.round("avg_tokens", 6).alias("avg_tokens"))


EVALUATION_SQL = f"""WITH {SYMBOLS_SQL}, h AS (SELECT item_id, length(b.text) AS t, count(doc_id) > 0 AS f FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
 g AS (SELECT id, lower(name) AS low, norm, row_number() OVER (PARTITION BY norm ORDER BY {KIND_SQL}, {RANK_SQL}, start_line, id) AS r FROM (SELECT *, lower(regexp_replace(regexp_replace(trim(name), '\\(\\)$', ''), '\\s+', '', 'g')) AS norm FROM symbols)),
 n AS (SELECT h.*, s.id IS NOT NULL AS named, (SELECT min(r) FROM g o WHERE o.norm = s.norm AND o.low = s.low) AS first FROM h LEFT JOIN g s ON s.id = item_id)
SELECT count(*) AS tasks, round(count(*) FILTER (WHERE named AND item_id % 3 <> 0 AND first = 1) / count(*) FILTER (WHERE named), 6) AS top1_recall, round(count(*) FILTER (WHERE named AND item_id % 3 <> 0 AND first <= 3) / count(*) FILTER (WHERE named), 6) AS top3_recall,
 round(count(*) FILTER (WHERE f) / count(*), 6) AS source_recall, count(*) FILTER (WHERE named AND item_id % 5 = 0 AND first <= 3) AS forbidden_hits, round(avg(t), 6) AS avg_tokens FROM n"""


def latencies(spark, sf):
    return evaluate.latencies(T.table(spark, sf, "events").select("event_type", F.col("value").alias("ms")), "event_type")


def tool_classes(spark, sf):
    names = ["search", "get_symbol", "get_document", "list_roots", "report_outcome", "implementation_context", "click"]
    t = F.element_at(F.array(*map(F.lit, names)), (F.col("request_id") % 7 + 1).cast("int"))
    r = T.requests(spark, sf).select(classify.tool_class(t).alias("class"), classify.normal_coverage(F.col("coverage"), F.col("request_id") % 4 != 0).alias("cov"), classify.source_estimate(F.coalesce("returned_tokens", F.lit(0)), F.col("structured_tokens"), F.col("raw_document_tokens")).alias("est"))
    return r.groupBy("class", "cov").agg(F.count(F.lit(1)).alias("n"), F.sum("est").alias("est"))


TOOLS_SQL = f"""WITH {REQUESTS_SQL} SELECT (['knowledge_search', 'symbol_search', 'document_fetch', 'root_resolution', 'outcome_report', 'implementation_context', 'other'])[request_id % 7 + 1] AS class,
 CASE WHEN request_id % 4 = 0 THEN 'not_applicable' WHEN coverage IN ('high', 'medium', 'low') THEN coverage ELSE CASE WHEN coverage IS NULL THEN 'unclassified' ELSE 'unclassified' END END AS cov, count(*) AS n,
 CAST(sum(CASE WHEN coalesce(returned_tokens, 0) > 0 THEN returned_tokens * CASE WHEN raw_document_tokens > structured_tokens AND structured_tokens = 0 THEN 2 WHEN structured_tokens > 0 AND raw_document_tokens = 0 THEN 4 ELSE 3 END END) AS BIGINT) AS est FROM requests GROUP BY 1, 2"""


def recipe_lineage(spark, sf):
    """Documents as recipes of which each replaces the one before, in chains of up to a thousand."""
    d = T.table(spark, sf, "documents").select("doc_id").distinct()
    return recipes.lineage(d.select(F.col("doc_id").alias("uri"), F.when(F.col("doc_id") % 1000 != 0, F.col("doc_id") - 1).alias("replaces")))


LINEAGE_SQL = """WITH RECURSIVE d AS (SELECT DISTINCT doc_id FROM documents), c AS (SELECT doc_id AS uri, doc_id AS origin, 0 AS steps FROM d
 UNION ALL SELECT uri, origin - 1, steps + 1 FROM c WHERE origin % 1000 <> 0 AND (origin = uri OR origin IN (FROM d)))
SELECT uri, arg_max(origin, steps) AS origin, CAST(max(steps) AS BIGINT) AS steps FROM c GROUP BY uri"""


def session_hashes(spark, sf):
    """The sessions of all events: blank names, names under a salt, and names under a salt longer than a block."""
    e = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" session-"), F.col("user_id").cast("string"), F.lit("é "))).alias("raw"))
    return e.select("event_id", keyed.session_hash(F.col("raw"), SALT).alias("session"), keyed.session_hash(F.col("raw"), SALT * 9).alias("long"), keyed.session_hash(F.col("raw")).alias("plain"))


def hmac_sql(salt: bytes) -> str:
    blob = lambda pad: "'" + "".join(f"\\x{b:02X}" for b in keyed.padded_key(salt, pad)) + "'::BLOB"
    return f"left(sha256({blob(keyed.OUTER)} || unhex(sha256({blob(keyed.INNER)} || encode(r)))), 32)"


SALT = b"a salt of this install"
SESSION_SQL = f"""SELECT event_id, CASE WHEN r = '' THEN '' ELSE {hmac_sql(SALT)} END AS session, CASE WHEN r = '' THEN '' ELSE {hmac_sql(SALT * 9)} END AS long, CASE WHEN r = '' THEN '' ELSE left(sha256(r), 16) END AS plain
FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'session-' || user_id || 'é' END AS r FROM events)"""


QUERIES = {
    "recipe_lineage": (recipe_lineage, LINEAGE_SQL),
    "session_hashes": (session_hashes, SESSION_SQL),
    "source_health": (health_issues, HEALTH_SQL),
    "library_growth": (growth, GROWTH_SQL),
    "playbook_queries": (playbook_queries, PLAYBOOK_SQL),
    "playbook_apis": (playbook_apis, APIS_SQL),
    "group_recall": (group_recall, RECALL_SQL),
    "recipe_search": (recipe_search, RECIPE_SQL),
    "metadata_enrich": (metadata_enrich, ENRICH_SQL),
    "robots_filter": (robots_filter, r"SELECT page_id, NOT (starts_with(p, '/docs') OR starts_with(p, '/a')) AS ok FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS p FROM pages)"),
    "code_symbols": (code_symbols, code_sql()),
    "evaluation_metrics": (evaluation, EVALUATION_SQL),
    "latency_percentiles": (latencies, "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p95 FROM events GROUP BY 1"),
    "tool_classes": (tool_classes, TOOLS_SQL),
}
