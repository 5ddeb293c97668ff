"""Package selection, catalog reads, mutations and excerpts over the input tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import excerpts, git, web
from ..operators import catalog, mutate, select
from ..operators.index import made_once
from ..sources import pdf
from ..sources import tables as T
from ..sources.tables import CHUNKS_SQL, EVIDENCE_SQL, REQUESTS_SQL, SYMBOLS_SQL
from .retrieval import RANK_SQL

WORTH = "authority IN ('current_project', 'related_internal_project', 'curated_internal_recipe', 'official_example', 'official_documentation')"


# ---------------------------------------------------------------- selection


def doc_chunks(spark, sf):
    """Chunks whose uri is their document's."""
    c = T.chunks(spark, sf)
    return c.withColumn("uri", F.concat(F.lit("project://d/"), F.col("document_id").cast("string")))


DOC_CHUNKS_SQL = f"{CHUNKS_SQL}, dc AS (SELECT * REPLACE ('project://d/' || document_id AS uri) FROM chunks)"


def tasks(spark, sf):
    return T.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(" with constraint and example")).alias("task"))


def signal_chunks(spark, sf):
    c = doc_chunks(spark, sf)
    hits = c.where("ordinal = 0").select((F.col("document_id") % 40).alias("qid"), "chunk_id")
    return select.signal_chunks(c, hits, tasks(spark, sf))


_CUE = " + ".join(f"CASE WHEN contains(t, {c!r}) THEN 3 ELSE 0 END" if "\n" not in c else "CASE WHEN contains(t, 'must' || chr(10)) THEN 3 ELSE 0 END" for c in select.CUES)
SIGNAL_SQL = f"""WITH {DOC_CHUNKS_SQL}, h AS (SELECT document_id % 40 AS qid, chunk_id FROM dc WHERE ordinal = 0),
 d AS (SELECT qid, uri FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN authority IN ('official_example', 'official_documentation') THEN 0 ELSE 1 END, {RANK_SQL}, uri) AS n FROM
   (SELECT DISTINCT qid, uri, authority FROM h JOIN dc USING (chunk_id) WHERE {WORTH})) WHERE n <= 4),
 k AS (SELECT item_id AS qid, list_filter(list_transform(regexp_split_to_array(lower(trim(text || ' with constraint and example')), '\\s+'), lambda w: trim(w, '.,;:()[]{{}}\"''')),
   lambda w: strlen(w) >= 4 AND w NOT IN ({", ".join(repr(w) for w in select.IDLE_WORDS)})) AS toks FROM benchmark),
 s AS (SELECT qid, uri, chunk_id, ordinal, {_CUE} + len(list_filter(toks, lambda w: contains(t, w))) AS score FROM
   (SELECT d.qid, c.uri, c.chunk_id, c.ordinal, lower(heading || chr(10) || body) AS t, toks FROM d JOIN dc c ON c.uri = d.uri JOIN k ON k.qid = d.qid
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = d.qid AND h.chunk_id = c.chunk_id)))
SELECT qid, chunk_id, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, uri ORDER BY score DESC, ordinal, chunk_id) AS n FROM s WHERE score > 0) WHERE n <= 2"""


def cited_documents(spark, sf):
    c = T.chunks(spark, sf)
    hits = c.where("ordinal = 0").select((F.col("chunk_id") % 7).alias("qid"), F.upper("uri").alias("uri"))
    return select.cited_documents(hits, c.select((F.col("chunk_id") % 7).alias("qid"), "uri", "authority"))


CITED_SQL = f"""WITH {CHUNKS_SQL} SELECT qid, uri FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, uri) AS n FROM
 (SELECT DISTINCT chunk_id % 7 AS qid, uri, {RANK_SQL} AS r FROM chunks WHERE {WORTH} AND ordinal <> 0)) WHERE n <= 4"""


def hit_bodies(spark, sf):
    c = T.chunks(spark, sf)
    hits = c.select((F.col("chunk_id") % 9).alias("qid"), F.col("chunk_id").alias("rank"), "chunk_id")
    return select.bodies(hits, c).select("qid", "chunk_id", F.sha2("excerpt", 256).alias("sha"))


BODIES_SQL = f"""WITH {CHUNKS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY chunk_id % 9 ORDER BY CASE authority WHEN 'official_example' THEN 0 WHEN 'official_documentation' THEN 1 WHEN 'curated_internal_recipe' THEN 2
   WHEN 'current_project' THEN 3 WHEN 'related_internal_project' THEN 3 ELSE 4 + {RANK_SQL} END, chunk_id) AS n, left(body, 2400) AS head, regexp_extract(left(body, 2400), '^([\\s\\S]*)[ \\n][^ \\n]*$', 1) AS cut FROM chunks)
SELECT chunk_id % 9 AS qid, chunk_id, sha256(CASE WHEN length(body) <= 2400 THEN body ELSE rtrim(CASE WHEN cut <> '' AND strlen(head) - strlen(cut) <= 40 THEN cut ELSE head END) || '…' END) AS sha
FROM p WHERE n <= 12 AND trim(body) <> ''"""


def package_symbols(spark, sf):
    s = T.symbols(spark, sf)
    short = F.regexp_replace(F.substring_index(F.col("name"), "_", -1), r"\(\)$", "")
    kind = F.when(F.col("id") % 3 == 0, "mention").otherwise(F.col("kind"))
    return select.package_symbols(s.select((F.col("id") % 11).alias("qid"), F.col("id").alias("position"), F.left(short, F.lit(8)).alias("name"), "authority", kind.alias("kind")), 12).select("qid", "place", "position")


PACKAGE_SYMBOLS_SQL = rf"""WITH {SYMBOLS_SQL}, s AS (SELECT id % 11 AS qid, id AS position, left(regexp_replace(split_part(name, '_', -1), '\(\)$', ''), 8) AS name, authority, CASE WHEN id % 3 = 0 THEN 'mention' ELSE kind END AS kind FROM symbols),
 f AS (SELECT *, lower(trim(name)) AS k, min(position) OVER (PARTITION BY qid, lower(trim(name))) AS first FROM s WHERE trim(name) <> ''),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY {RANK_SQL}, CASE WHEN kind = 'mention' THEN 1 ELSE 0 END, position) AS n FROM f) WHERE n = 1)
SELECT qid, CAST(place AS INT) AS place, position FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN authority IN ('generated_summary', 'third_party_reference', '') THEN 1 ELSE 0 END, first) AS place FROM b) WHERE place <= 12"""


def roots_by_role(spark, sf):
    n = T.table(spark, sf, "nation")
    roles = F.array(*map(F.lit, [*select.ROLE_ORDER, "other"]))
    m = n.select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("root_name"), F.element_at(roles, F.col("n_nationkey") % 6 + 1).alias("role"), F.col("n_nationkey").alias("position"))
    return select.roots_by_role(m).select("group", "root_name", "place")


ROLES_SQL = """SELECT n_regionkey AS "group", n_name AS root_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 6, n_nationkey) AS INT) AS place FROM nation"""


def citations(spark, sf):
    e = T.evidence(spark, sf)
    uri = F.concat(F.when(F.col("evidence_type") == "recipe", "x://a/_recipes/").when(F.col("evidence_type") == "curated", "x://curated/").otherwise("x://b/"), "evidence_key")
    authority = F.when(F.col("request_id") % 17 == 0, "curated_internal_recipe").when(F.col("request_id") % 19 == 0, "generated_summary").otherwise("unknown")
    return e.where("evidence_type <> 'symbol'").select("request_id", F.col("rank").alias("position"), uri.alias("uri"), authority.alias("authority"), F.lit("src").alias("root_name"))


def cited_symbols(spark, sf):
    return T.evidence(spark, sf).where("evidence_type = 'symbol'").select("request_id", F.col("rank").alias("position"), F.col("evidence_key").alias("name_norm"), F.lit("src").alias("root_name"))


def packaged(spark, sf):
    return T.requests(spark, sf).select("request_id", F.coalesce("returned_tokens", F.lit(0)).alias("tokens"), "curated_count", "recipe_count", "symbol_count", "citation_count")


def evidence_events(spark, sf):
    return select.evidence_events(packaged(spark, sf), citations(spark, sf), cited_symbols(spark, sf))


EVENTS_SQL = f"""{REQUESTS_SQL}, {EVIDENCE_SQL}, e AS (SELECT request_id, rank, evidence_key, evidence_type = 'symbol' AS sym, CASE evidence_type WHEN 'recipe' THEN 'x://a/_recipes/' WHEN 'curated' THEN 'x://curated/' ELSE 'x://b/' END || evidence_key AS uri,
   CASE WHEN request_id % 17 = 0 THEN 'curated_internal_recipe' WHEN request_id % 19 = 0 THEN 'generated_summary' ELSE 'unknown' END AS authority FROM evidence),
 ev AS (SELECT request_id, CASE WHEN sym THEN 'symbol' WHEN authority = 'curated_internal_recipe' OR contains(uri, '/_recipes/') THEN 'recipe' WHEN authority = 'generated_summary' OR contains(uri, 'curated') THEN 'curated' ELSE 'citation' END AS evidence_type,
   CASE WHEN sym THEN evidence_key || '|src' ELSE uri END AS evidence_key, 'src' AS root_key, row_number() OVER (PARTITION BY request_id, sym ORDER BY rank) AS rank, count(*) OVER (PARTITION BY request_id) AS pieces FROM e),
 told AS (SELECT ev.*, coalesce(returned_tokens, 0) AS tokens, CASE WHEN coalesce(returned_tokens, 0) > 0 THEN greatest(returned_tokens // pieces, 1) ELSE 0 END AS share FROM ev JOIN requests USING (request_id))"""
EVIDENCE_EVENTS_SQL = f"WITH {EVENTS_SQL} SELECT request_id, evidence_type, evidence_key, root_key, CAST(rank AS INT) AS rank, CAST(share AS BIGINT) AS estimated_tokens FROM told WHERE rank <= 32"


def token_shares(spark, sf):
    e = evidence_events(spark, sf).where("request_id % 5 <> 0")
    return select.token_shares(packaged(spark, sf), e)


SHARES_SQL = f"""WITH {EVENTS_SQL}, g AS (SELECT request_id, sum(CASE WHEN evidence_type IN ('recipe', 'curated', 'symbol') THEN share ELSE 0 END) AS s, sum(share) AS every FROM told WHERE request_id % 5 <> 0 GROUP BY 1),
 p AS (SELECT request_id, coalesce(returned_tokens, 0) AS t, curated_count + recipe_count + symbol_count AS known, citation_count, coalesce(s, 0) AS s, coalesce(every, 0) AS every FROM requests LEFT JOIN g USING (request_id)),
 q AS (SELECT *, CASE WHEN t <= 0 THEN s WHEN every = 0 THEN CASE WHEN known > 0 AND citation_count = 0 THEN t WHEN known = 0 THEN 0 ELSE t // 2 END ELSE t * s // every END AS part FROM p)
SELECT request_id, CAST(part AS BIGINT) AS structured_tokens, CAST(CASE WHEN t <= 0 THEN every - s ELSE t - part END AS BIGINT) AS raw_document_tokens FROM q"""


def failed_requests(spark, sf):
    e = T.table(spark, sf, "events").where("event_type = 'error'")
    roots = F.array(F.lit(" a "), F.lit("a"), F.lit(""), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")))
    rows = e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("tool_name"), F.repeat(F.concat("props", F.lit("é")), 30).alias("message"), roots.alias("roots"))
    return select.outcome_event(rows, "request_error")


FAILED_SQL = """SELECT event_id AS request_id, event_type AS tool_name, 'request_error' AS result_status,
 CASE WHEN strlen(left(m, n)) <= 240 THEN left(m, n) ELSE left(m, n - 1) END AS error_message, CAST(2 AS INT) AS root_count, false AS root_selection_required
FROM (SELECT *, list_max(list_filter(range(0, 241), lambda k: strlen(left(m, CAST(k AS INT))) <= 240)) AS n FROM (SELECT *, repeat(props || 'é', 30) AS m FROM events WHERE event_type = 'error'))"""


# ---------------------------------------------------------------- catalog and mutations


def catalog_names(spark, sf):
    c, s = T.chunks(spark, sf), T.symbols(spark, sf)
    parts = [catalog.names(df, k).select(F.lit(k).alias("kind"), F.col(k).alias("name")) for df, k in ((c, "root_name"), (c, "uri"), (s, "name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def document_preview(spark, sf):
    c = T.chunks(spark, sf)
    wanted = c.where("authority = 'official_documentation'").select("document_id")
    p = catalog.preview(c, wanted, most_chunks=2, most_chars=900)
    return p.select("document_id", "ordinal", F.sha2("text", 256).alias("sha"), "cut")


PREVIEW_SQL = f"""WITH {CHUNKS_SQL}, r AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(body)) OVER (PARTITION BY document_id ORDER BY ordinal, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
  FROM chunks WHERE document_id IN (SELECT document_id FROM chunks WHERE authority = 'official_documentation') WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, chunk_id))
SELECT document_id, ordinal, sha256(left(body, CAST(900 - held AS INT))) AS sha, length(body) > 900 - held AS cut FROM r WHERE n <= 2 AND held < 900"""


def documents_symbols(spark, sf):
    """Symbols of the documents that benchmark items name by their ids."""
    s = T.symbols(spark, sf).withColumn("document_id", F.expr("id div 4"))
    return catalog.chosen(s, T.table(spark, sf, "benchmark").select(F.col("item_id").alias("document_id")), "document_id").select("document_id", "id", "name")


def groups_with_members(spark, sf):
    r, n = T.table(spark, sf, "region"), T.table(spark, sf, "nation")
    out = catalog.with_parts(r.select(F.col("r_regionkey").alias("group"), "r_name"), n.where("n_nationkey % 5 <> 2").select(F.col("n_regionkey").alias("group"), "n_name"), "group", "n_name", "members")
    return out.select("group", "r_name", F.array_join("members", ",").alias("members"))


def keyed_upsert(spark, sf):
    """Suppliers as old sources, customers of their numbers as newer ones, several of which have one key."""
    old = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(0).cast("long").alias("at"))
    new = T.table(spark, sf, "customer").select((F.col("c_custkey") % 97 + 5).alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at"))
    return mutate.keyed(old, new, "key", order="at")


KEYED_SQL = """WITH n AS (SELECT c_custkey % 97 + 5 AS key, arg_max(c_name, c_custkey) AS name, max(c_custkey) AS "at" FROM customer GROUP BY 1)
SELECT key, name, "at" FROM n UNION ALL SELECT s_suppkey, s_name, CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey NOT IN (SELECT key FROM n)"""


def source_parts(spark, sf):
    """Line items as parts of orders: those of every third order are replaced by one of its own."""
    old = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("part"))
    parents = T.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"))
    return mutate.with_parts(old, parents.select("key", (-F.col("key")).alias("part")), parents, "key")


def without_orphans(spark, sf):
    """Documents without chunks are purged, and then those that labels call toxic are removed."""
    d, l = T.table(spark, sf, "documents").select("doc_id", "source"), T.table(spark, sf, "labels")
    left = mutate.purged(d, T.chunks(spark, sf).select(F.col("chunk_id").alias("doc_id")), "doc_id")
    return mutate.removed(left, l.where("toxic = 1"), "doc_id")


def source_stamps(spark, sf):
    """Users as sources, their events as runs of which errors failed."""
    e = T.table(spark, sf, "events")
    sources = e.select("user_id").distinct().select("user_id", F.lit(None).cast("timestamp").alias("last_attempt"), F.lit(None).cast("timestamp").alias("last_success"), F.lit("new").alias("status"), F.lit("").alias("version"))
    late = e.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id")).join(e.select("event_id", "event_type", "value"), "event_id")
    runs = late.select("user_id", F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").cast("string").alias("version"))
    return mutate.stamped(sources, runs.where("user_id % 3 <> 0"), "user_id")


STAMPS_SQL = """WITH r AS (SELECT user_id, ts AS t, arg_max(event_type, event_id) <> 'error' AS ok, CAST(max(event_id) AS VARCHAR) AS version FROM events WHERE user_id % 3 <> 0 GROUP BY user_id, ts),
 g AS (SELECT user_id, max(t) AS a, arg_max(ok, t) AS ok, max(t) FILTER (WHERE ok) AS s, arg_max(version, t) FILTER (WHERE ok) AS v FROM r GROUP BY 1)
SELECT user_id, a AS last_attempt, s AS last_success, CASE WHEN ok THEN 'ok' WHEN ok IS NOT NULL THEN 'failed' ELSE 'new' END AS status, coalesce(v, '') AS version FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN g USING (user_id)"""


def refresh_report(spark, sf):
    """Pages by their ids: several may have one address."""
    p = T.table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("hash"))
    code = F.when(F.col("page_id") % 7 == 0, 304).when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 13 == 0, 500).otherwise(200)
    seen = p.where("page_id % 5 <> 0").select("page_id", code.alias("code"), F.when(F.col("page_id") % 2 == 0, F.col("hash")).otherwise("x").alias("hash"))
    return mutate.report(mutate.refreshed(p.where("page_id % 9 <> 0").select("page_id", "hash"), seen, "page_id"))


REFRESH_SQL = """SELECT CASE WHEN c IS NULL THEN 'not asked' WHEN c = 304 THEN 'unchanged' WHEN c = 404 THEN 'gone' WHEN c <> 200 THEN 'failed' WHEN page_id % 9 = 0 THEN 'new' WHEN page_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS n
FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 304 WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS c FROM pages) WHERE NOT (page_id % 9 = 0 AND c IS NULL) GROUP BY 1"""


# ---------------------------------------------------------------- excerpts, sections, addresses


def telling_lines(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    tokens = F.array(F.lit("the"), F.lit("ion"), F.lit(""))
    calls = F.concat("t", F.lit("\nPlain RetryPolicy prose.\nint f_open(Path p);\nClient.Connect (host)\n"), F.col("doc_id").cast("string"))
    split = made_once(d, "lines", F.split(F.when(F.col("doc_id") % 3 == 0, calls).otherwise(F.col("t")), "\n"))
    found = made_once(split, "line", excerpts.best_line(F.col("lines"), tokens))  # a text's lines are scored once
    return found.select("doc_id", "line", F.sha2(excerpts.window_at(F.col("lines"), F.col("line"), 6), 256).alias("window_sha"))


_P, _S = (f"'{c}'" for c in excerpts.CALLS)
TELLING_SQL = rf"""WITH l AS (SELECT doc_id, string_split(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || array_to_string(['Plain RetryPolicy prose.', 'int f_open(Path p);', 'Client.Connect (host)', ''], chr(10)) || doc_id ELSE '' END, chr(10)) AS ls FROM documents),
 s AS (SELECT doc_id, ls, list_transform(ls, lambda x: CASE WHEN strlen(x) > 400 AND NOT (regexp_matches(x, {_P}) OR regexp_matches(x, {_S})) AND (contains(lower(x), 'the') OR contains(lower(x), 'ion') OR contains(lower(x), 'f_')) THEN 1 ELSE
   CASE WHEN contains(lower(x), 'the') THEN 2 ELSE 0 END + CASE WHEN contains(lower(x), 'ion') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, {_P}) OR regexp_matches(x, {_S}) THEN 6 ELSE 0 END
   + CASE WHEN contains(lower(x), 'f_') AND contains(x, '(') THEN 4 ELSE 0 END + CASE WHEN contains(lower(x), 'int f_') OR contains(lower(x), 'void f_') OR contains(lower(x), 'long f_') OR contains(lower(x), 'f_file *') THEN 5 ELSE 0 END END) AS sc FROM l),
 b AS (SELECT *, CASE WHEN list_max(sc) > 0 THEN list_position(sc, list_max(sc)) - 1 ELSE -1 END AS best FROM s),
 w AS (SELECT *, greatest(0, least(best - 2, len(ls) - 6)) AS st FROM b),
 v AS (SELECT *, st < best AND strlen(ls[st + 1]) > 400 AND NOT (regexp_matches(ls[st + 1], {_P}) OR regexp_matches(ls[st + 1], {_S})) AS blob, least(st + 6, len(ls)) AS en FROM w)
SELECT doc_id, CAST(best AS INT) AS line, sha256(CASE WHEN best < 0 THEN '' ELSE trim(array_to_string(list_slice(ls, CASE WHEN blob THEN best ELSE st END + 1, CASE WHEN blob AND en <= best THEN least(len(ls), best + 6) ELSE en END), chr(10)), ' ' || chr(9) || chr(13) || chr(10)) END) AS window_sha FROM v"""


def cleaned_pages(spark, sf):
    p = T.table(spark, sf, "pages")
    made = F.concat(F.lit("// Copyright x\n\n#include <a.h>\r\n![i](x.png)\n#include\n # include \n&amp;quot;&quot; a <b_c> &amp;lt;\n"), "html")
    return p.select("page_id", F.sha2(excerpts.clean_body(made), 256).alias("sha"), F.sha2(excerpts.trimmed_excerpt(made, 5), 256).alias("excerpt_sha"))


CLEAN_SQL = r"""WITH p AS (SELECT page_id, '// Copyright x' || chr(10) || chr(10) || '#include <a.h>' || chr(13) || chr(10) || '![i](x.png)' || chr(10) || '#include' || chr(10) || ' # include ' || chr(10) || '&amp;quot;&quot; a <b_c> &amp;lt;' || chr(10) || html AS t FROM pages),
 c AS (SELECT page_id, t, regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '(?m)^([ \t]*#[ \t]*include[ \t]*)<([^>\r\n]+)>', '\1' || chr(1) || '\2' || chr(2), 'g') AS a FROM p),
 d AS (SELECT page_id, t, replace(replace(replace(replace(replace(regexp_replace(a, '</?[A-Za-z][A-Za-z0-9]*\b[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', '''') AS b FROM c),
 e AS (SELECT *, string_split(trim(t, ' ' || chr(9) || chr(13) || chr(10)), chr(10)) AS ls FROM d),
 f AS (SELECT *, list_position(list_transform(ls, lambda x: trim(x) IN ('', '*/', '/*') OR contains(x, 'Copyright') OR starts_with(trim(x), '```')), false) AS k FROM e)
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(translate(regexp_replace(b, '!\[[^\]]*\]\([^)]*\)', '', 'g'), chr(1) || chr(2), '<>'), '(?m)(?:^[ \t]*#[ \t]*include[ \t]*\n){2,}', '/* #include … */' || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10))) AS sha,
 sha256(trim(array_to_string(list_slice(ls, k, k + 4), chr(10)), ' ' || chr(9) || chr(13) || chr(10))) AS excerpt_sha FROM f"""


def pdf_sections(spark, sf):
    """Documents as pages of files of ten; files but every fourth have bookmarks at the pages that three divides."""
    d = T.table(spark, sf, "documents")
    file = F.expr("doc_id div 10")
    pages = d.select(file.cast("string").alias("path"), (F.col("doc_id") % 10 + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    marks = d.where("(doc_id div 10) % 4 <> 0 and (doc_id % 10 + 1) % 3 = 0")
    marks = marks.select(file.cast("string").alias("path"), (F.col("doc_id") % 10).cast("int").alias("position"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("B"), F.col("doc_id").cast("string"))).otherwise("").alias("title"), (F.col("doc_id") % 10 + 1).cast("int").alias("page_from"), F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 10 + 2).cast("int")).otherwise(0).alias("page_thru"))
    out = pdf.sections(pages, marks)
    return out.select("path", "section", "heading", "start_page", "end_page", F.sha2("body", 256).alias("sha"))


SECTIONS_SQL = r"""WITH p AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS path, CAST(doc_id % 10 + 1 AS INT) AS page, coalesce(text, '') AS text FROM documents),
 sp AS (SELECT path, min(page) AS f, max(page) AS l FROM p GROUP BY 1),
 m AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS path, doc_id % 10 AS position, CASE WHEN doc_id % 2 = 0 THEN 'B' || doc_id ELSE '' END AS heading, CAST(doc_id % 10 + 1 AS INT) AS pf, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 10 + 2 AS INT) ELSE 0 END AS pt
   FROM documents WHERE (doc_id // 10) % 4 <> 0 AND (doc_id % 10 + 1) % 3 = 0),
 b AS (SELECT *, lead(pf) OVER (PARTITION BY path ORDER BY position) AS nx FROM m JOIN sp USING (path)),
 c AS (SELECT path, position, heading, greatest(pf, f) AS s, least(CASE WHEN pt <= pf AND nx - 1 >= pf THEN nx - 1 ELSE greatest(pf, pt) END, l) AS e, f, l, pf FROM b),
 a AS (SELECT path, -1 AS position, '' AS heading, min(f) AS s, min(pf) - 1 AS e FROM c GROUP BY path HAVING min(pf) > min(f)),
 w AS (SELECT path, -1 AS position, '' AS heading, f AS s, l AS e FROM sp WHERE path NOT IN (SELECT path FROM c)),
 u AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY position) AS section FROM (SELECT path, position, heading, s, e FROM c WHERE pf <= l AND e >= f UNION ALL SELECT * FROM a UNION ALL SELECT * FROM w)),
 t AS (SELECT u.path, section, heading, s, e, string_agg(text, chr(10) ORDER BY page, text) AS text FROM u JOIN p ON p.path = u.path AND page BETWEEN s AND e AND trim(text) <> '' GROUP BY ALL)
SELECT path, CAST(section AS INT) AS section, heading, CAST(s AS INT) AS start_page, CAST(e AS INT) AS end_page, sha256(trim(CASE WHEN heading <> '' THEN '# ' || heading || chr(10) || chr(10) || text ELSE text END, ' ' || chr(9) || chr(13) || chr(10))) AS sha FROM t"""


def repository_urls(spark, sf):
    """Addresses made of pages' hosts and numbers, on several hosts and in several forms."""
    p = T.table(spark, sf, "pages").select("page_id", web.host(F.col("url")).alias("h"))
    name = F.concat(F.lit("o"), (F.col("page_id") % 9).cast("string"), F.lit("/r"), F.col("page_id").cast("string"))
    forms = F.array(F.concat(F.lit("https://github.com/"), name, F.lit("/blob/main/a.md?x=1")), F.concat(F.lit("git@gitlab.com:"), name, F.lit(".git")), F.concat(F.lit("https://user:tok@"), "h", F.lit("/"), name), F.concat(F.lit("https://"), "h", F.lit("/docs#top")), F.concat(F.lit("file:///srv/"), name))
    u = p.select("page_id", F.explode(forms).alias("url"))
    c = F.col("url")
    return u.select("page_id", "url", git.provider(c).alias("provider"), git.owner(c).alias("owner"), git.repository(c).alias("repository"), git.looks_like_repository(c).alias("git"), git.clone_url(c).alias("clone"), git.redacted(c).alias("shown"))


REPOSITORY_SQL = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h, 'o' || (page_id % 9) AS o, 'r' || page_id AS r FROM pages),
 u AS (SELECT page_id, 'https://github.com/' || o || '/' || r || '/blob/main/a.md?x=1' AS url, 'github' AS provider, o AS owner, r AS repository, true AS git, 'https://github.com/' || o || '/' || r || '.git' AS clone, url AS shown FROM p
  UNION ALL SELECT page_id, 'git@gitlab.com:' || o || '/' || r || '.git' AS url, 'gitlab', o, r, true, url, url FROM p
  UNION ALL SELECT page_id, 'https://user:tok@' || h || '/' || o || '/' || r AS url, 'git', o, r, false, 'https://' || h || '/' || o || '/' || r || '.git', 'https://***@' || h || '/' || o || '/' || r FROM p
  UNION ALL SELECT page_id, 'https://' || h || '/docs#top' AS url, 'git', '', '', false, 'https://' || h || '/docs', url FROM p
  UNION ALL SELECT page_id, 'file:///srv/' || o || '/' || r AS url, 'local', 'srv', o, false, url, url FROM p)
SELECT * FROM u"""


def site_chrome(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", web.relative_path(F.col("url")).alias("path"))
    tails = F.array(*map(F.lit, ["", "/search.html", "/_static/x.js", "/functions_a.html", "/files.html", "/a.php"]))
    path = F.concat("path", F.element_at(tails, (F.col("page_id") % 6 + 1).cast("int")))
    return p.select("page_id", path.alias("path")).select("page_id", web.sphinx_chrome(F.col("path")).alias("sphinx"), web.doxygen_chrome(F.col("path")).alias("doxygen"), web.content_kind(F.col("path"), F.lit("text/html")).alias("kind"))


CHROME_SQL = r"""WITH q AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/', '') AS p FROM pages),
 p AS (SELECT page_id, lower(CASE WHEN p = '' OR ends_with(p, '/') THEN p || 'index.html' ELSE p END || (['', '/search.html', '/_static/x.js', '/functions_a.html', '/files.html', '/a.php'])[page_id % 6 + 1]) AS p FROM q),
 b AS (SELECT *, split_part(p, '/', -1) AS base FROM p)
SELECT page_id, contains(p, 'search.html') OR contains(p, 'genindex.html') OR contains(p, 'py-modindex.html') OR contains(p, '_sources/') OR contains(p, 'searchindex.js') OR contains(p, '_static/') AS sphinx,
 base IN ('classes.html', 'files.html', 'namespaces.html', 'doxygen_crawl.html', 'search.html', 'dir_*.html', 'jquery.js') OR ends_with(base, '.php') OR contains(p, '/search/') OR starts_with(base, 'namespacemembers') OR starts_with(base, 'functions_') OR starts_with(base, 'globals_') OR starts_with(base, 'annotated') OR starts_with(base, 'search_') AS doxygen,
 CASE WHEN regexp_matches(p, '\.(html?|xhtml)$') THEN 'html' WHEN regexp_matches(p, '\.(md|markdown|mdx)$') THEN 'markdown' WHEN regexp_matches(p, '\.(txt|rst|text)$') THEN 'text' ELSE 'html' END AS kind FROM b"""

QUERIES = {
    "signal_chunks": (signal_chunks, SIGNAL_SQL),
    "cited_documents": (cited_documents, CITED_SQL),
    "hit_bodies": (hit_bodies, BODIES_SQL),
    "package_symbols": (package_symbols, PACKAGE_SYMBOLS_SQL),
    "roots_by_role": (roots_by_role, ROLES_SQL),
    "evidence_events": (evidence_events, EVIDENCE_EVENTS_SQL),
    "token_shares": (token_shares, SHARES_SQL),
    "failed_requests": (failed_requests, FAILED_SQL),
    "catalog_names": (catalog_names, f"WITH {CHUNKS_SQL}, {SYMBOLS_SQL} SELECT DISTINCT 'root_name' AS kind, root_name AS name FROM chunks UNION ALL SELECT DISTINCT 'uri', uri FROM chunks UNION ALL SELECT DISTINCT 'name', name FROM symbols"),
    "document_preview": (document_preview, PREVIEW_SQL),
    "documents_symbols": (documents_symbols, f"WITH {SYMBOLS_SQL} SELECT id // 4 AS document_id, id, name FROM symbols WHERE id // 4 IN (SELECT item_id FROM benchmark)"),
    "groups_with_members": (groups_with_members, "SELECT r_regionkey AS \"group\", r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS members FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 2) ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "keyed_upsert": (keyed_upsert, KEYED_SQL),
    "source_parts": (source_parts, "SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, -o_orderkey FROM orders WHERE o_orderkey % 3 = 0"),
    "purged_documents": (without_orphans, "SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "source_stamps": (source_stamps, STAMPS_SQL),
    "refresh_report": (refresh_report, REFRESH_SQL),
    "telling_lines": (telling_lines, TELLING_SQL),
    "cleaned_pages": (cleaned_pages, CLEAN_SQL),
    "pdf_sections": (pdf_sections, SECTIONS_SQL),
    "repository_urls": (repository_urls, REPOSITORY_SQL),
    "site_chrome": (site_chrome, CHROME_SQL),
}
