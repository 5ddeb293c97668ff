"""Corpus maintenance, chunking and classification over the input tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, ranking, text
from ..operators import chunking, corpus
from ..operators import index as ix
from ..sources import tables as T
from ..sources.tables import CHUNKS_SQL
from .retrieval import BOOST_SQL, RANK_SQL


def snapshots(spark, sf):
    """An old and a new snapshot: the new one lacks every tenth document and changes every seventh."""
    d = T.table(spark, sf, "documents").select(F.concat(F.lit("project://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("uri"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "doc_id")
    old = d.where("doc_id % 5 <> 0").select("uri", "hash")
    new = d.where("doc_id % 10 <> 3").select("uri", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")).alias("hash"))
    return old, new


SNAP_SQL = """d AS (SELECT 'project://' || source || '/' || doc_id AS uri, sha256(coalesce(text, '')) AS hash, doc_id FROM documents),
 old AS (SELECT uri, hash FROM d WHERE doc_id % 5 <> 0), new AS (SELECT uri, CASE WHEN doc_id % 7 = 0 THEN sha256(hash || '!') ELSE hash END AS hash FROM d WHERE doc_id % 10 <> 3)"""


def upsert(spark, sf):
    return corpus.upsert(*snapshots(spark, sf))


def change_status(spark, sf):
    return corpus.change_status(*snapshots(spark, sf), key="uri")


def delete_prefix(spark, sf):
    c = T.chunks(spark, sf)
    kept = corpus.without_prefix(c.select("uri", "chunk_id"), "project://src1")
    return corpus.cascade(c.select("chunk_id", "root_name"), kept, "chunk_id").groupBy("root_name").agg(F.count(F.lit(1)).alias("chunks"))


def orphan_docs(spark, sf):
    d, l = T.table(spark, sf, "documents").select("doc_id", "source"), T.table(spark, sf, "labels").select("doc_id")
    return corpus.orphans(d, l, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(20)


def trust_update(spark, sf):
    c = T.chunks(spark, sf).select("uri", "authority", "deprecated")
    u = T.chunks(spark, sf).where("chunk_id % 4 = 0").select("uri", F.when(F.col("chunk_id") % 8 == 0, "official_documentation").otherwise("").alias("authority"), (F.col("chunk_id") % 12 == 0).alias("deprecated"))
    return corpus.trust_update(c, u).groupBy("authority", "deprecated").agg(F.count(F.lit(1)).alias("n"))


def generations(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", "url")
    state = p.where("page_id % 3 <> 0").select("url", F.lit(1).alias("generation"), (F.col("page_id") % 2).cast("int").alias("missing"))
    return corpus.advance(state, p.where("page_id % 4 = 0").select("url"), 2)


def root_counts(spark, sf):
    c = T.chunks(spark, sf)
    s = c.where("chunk_id % 3 = 1").select("root_name")
    return corpus.root_counts(c.select("document_id", "root_name").distinct(), c, s)


def crosscheck(spark, sf):
    """Ids of all documents and labels."""
    d, l = T.table(spark, sf, "documents"), T.table(spark, sf, "labels")
    return corpus.crosscheck(d.select("doc_id"), l.select("doc_id"), "doc_id")


def folder_prefix(spark, sf):
    p = T.table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://(.*)$", 1).alias("path"))
    folders = p.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct().withColumn("id", F.xxhash64("folder") * 0)
    return corpus.folder_join(p, folders).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def near_items(c):
    tail = F.concat(F.lit("part"), (F.col("chunk_id") % 7).cast("string"), F.lit("/doc-"), (F.col("chunk_id") % 83).cast("string"), F.lit(".md"))
    return c.select(F.col("chunk_id").alias("id"), F.col("root_name").alias("root"), tail.alias("path"), text.title_key(F.col("heading")).alias("title_key"))


def near_duplicates(spark, sf):
    """All chunks, with made-up paths that many share."""
    return corpus.near_duplicates(near_items(T.chunks(spark, sf)))


NEAR_SQL = f"""WITH {CHUNKS_SQL}, i AS (SELECT chunk_id AS id, root_name AS root, 'part' || (chunk_id % 7) || '/doc-' || (chunk_id % 83) || '.md' AS path, 'doc-' || (chunk_id % 83) || '.md' AS base,
  regexp_replace(lower(heading), '[^a-z0-9]', '', 'g') AS title_key FROM chunks),
 p AS (SELECT a.id, count(*) AS links FROM i a JOIN i b ON a.root <> b.root AND (a.base = b.base OR a.title_key = b.title_key AND strlen(a.title_key) >= 8
  OR (ends_with(a.path, b.path) AND strlen(b.path) >= 12 AND contains(b.path, '/')) OR (ends_with(b.path, a.path) AND strlen(a.path) >= 12 AND contains(a.path, '/'))) GROUP BY 1)
SELECT i.id, coalesce(links, 0) AS links, min(i.id) OVER (PARTITION BY base) AS base_class, CASE WHEN strlen(title_key) >= 8 THEN min(i.id) OVER (PARTITION BY title_key) END AS title_class FROM i LEFT JOIN p ON p.id = i.id"""


def inventory(spark, sf):
    """Documents, pages and conversations as one list of sources."""
    d = T.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("items")).withColumn("kind", F.lit("local"))
    p = T.table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("name")).agg(F.count(F.lit(1)).alias("items")).withColumn("kind", F.lit("web"))
    c = T.table(spark, sf, "conversations").groupBy(F.col("role").alias("name")).agg(F.count(F.lit(1)).alias("items")).withColumn("kind", F.lit("chat"))
    return d.unionByName(p).unionByName(c)


def chunk_bounded(spark, sf):
    c = chunking.chunk(T.table(spark, sf, "documents").select("doc_id", "text"))
    return c.select("doc_id", "ordinal", "start_line", "end_line", F.sha2("body", 256).alias("body_sha"))


CHUNK_SQL = """WITH RECURSIVE l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS ls FROM documents),
 r(doc_id, k, start, size, ended) AS (
  SELECT doc_id, 0, 1, 0, CAST([] AS STRUCT(s INT, e INT)[]) FROM l
  UNION ALL SELECT doc_id, k + 1, CASE WHEN soft THEN k + 2 ELSE st END, CASE WHEN soft THEN 0 ELSE held END, CASE WHEN soft THEN list_append(done, {'s': st, 'e': k + 1}) ELSE done END FROM
   (SELECT *, line = '' AND held >= 1750 AS soft FROM (SELECT doc_id, k, line, CASE WHEN full_ THEN k + 1 ELSE start END AS st, CASE WHEN full_ THEN b ELSE size + b END AS held,
     CASE WHEN full_ THEN list_append(ended, {'s': start, 'e': k}) ELSE ended END AS done FROM
      (SELECT r.*, ls[k + 1] AS line, strlen(ls[k + 1]) + 1 AS b, size > 0 AND size + strlen(ls[k + 1]) + 1 > 3500 AS full_ FROM r JOIN l USING (doc_id) WHERE k < len(ls))))),
 f AS (SELECT r.doc_id, ls, CASE WHEN k >= start THEN list_append(ended, {'s': start, 'e': k}) ELSE ended END AS cs FROM r JOIN l USING (doc_id) WHERE k = len(ls)),
 u AS (SELECT doc_id, ls, unnest(cs) AS c, unnest(range(len(cs))) AS ordinal FROM f)
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, c.s AS start_line, c.e AS end_line, sha256(array_to_string(list_slice(ls, c.s, c.e), chr(10))) AS body_sha FROM u"""


def md_chunks(spark, sf):
    """Documents whose every third line is made a heading, as chunks of at most 600 bytes."""
    made = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l, i: F.when(i % 3 == 1, F.concat(F.lit("# "), F.left(l, F.lit(12)))).otherwise(l)), "\n")
    c = chunking.markdown_chunk(T.table(spark, sf, "documents").select("doc_id", made.alias("text")), most=600)
    return c.select("doc_id", "ordinal", "heading", "start_line", "end_line", F.sha2("body", 256).alias("body_sha"))


#: Sections of at most three lines: a chunk ends before a line that would pass 600 bytes, and after a blank line from 300 on.
MD_CHUNKS_SQL = """WITH l AS (SELECT doc_id, string_split(regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i % 3 = 2 THEN '# ' || left(x, 12) ELSE x END), chr(10)), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS ls FROM documents),
 t AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
 h AS (SELECT *, CASE WHEN regexp_matches(rtrim(line, ' ' || chr(9)), '^(#{1,6})(?:[ \t]+(.*))?$') THEN trim(rtrim(trim(regexp_extract(rtrim(line, ' ' || chr(9)), '^(#{1,6})(?:[ \t]+(.*))?$', 2), ' ' || chr(9)), '#'), ' ' || chr(9)) END AS title FROM t),
 s AS (SELECT *, max(CASE WHEN title IS NOT NULL OR pos = 0 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec, strlen(line) + 1 AS b FROM h),
 r AS (SELECT doc_id, sec, coalesce(arg_min(title, pos) FILTER (WHERE pos = sec), '') AS heading, list(struct_pack(p := pos, b := b, e := line = '') ORDER BY pos) AS rows FROM s GROUP BY doc_id, sec),
 f AS (SELECT doc_id, sec, heading, list_reduce(list_prepend({'done': CAST([] AS STRUCT(s BIGINT, e BIGINT)[]), 'st': CAST(sec AS BIGINT), 'size': CAST(0 AS BIGINT), 'at': CAST(sec - 1 AS BIGINT), 'p': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'e': false},
    list_transform(rows, lambda x: {'done': CAST([] AS STRUCT(s BIGINT, e BIGINT)[]), 'st': CAST(0 AS BIGINT), 'size': CAST(0 AS BIGINT), 'at': CAST(0 AS BIGINT), 'p': CAST(x.p AS BIGINT), 'b': CAST(x.b AS BIGINT), 'e': x.e})),
    lambda a, x: CASE WHEN a.size > 0 AND a.size + x.b > 600
      THEN {'done': CASE WHEN x.e AND x.b >= 300 THEN list_concat(a.done, [{'s': a.st, 'e': a.at}, {'s': x.p, 'e': x.p}]) ELSE list_append(a.done, {'s': a.st, 'e': a.at}) END, 'st': CASE WHEN x.e AND x.b >= 300 THEN x.p + 1 ELSE x.p END, 'size': CASE WHEN x.e AND x.b >= 300 THEN 0 ELSE x.b END, 'at': x.p, 'p': x.p, 'b': x.b, 'e': x.e}
      ELSE {'done': CASE WHEN x.e AND a.size + x.b >= 300 THEN list_append(a.done, {'s': a.st, 'e': x.p}) ELSE a.done END, 'st': CASE WHEN x.e AND a.size + x.b >= 300 THEN x.p + 1 ELSE a.st END, 'size': CASE WHEN x.e AND a.size + x.b >= 300 THEN 0 ELSE a.size + x.b END, 'at': x.p, 'p': x.p, 'b': x.b, 'e': x.e} END) AS z FROM r),
 g AS (SELECT doc_id, sec, heading, unnest(CASE WHEN z.at >= z.st THEN list_append(z.done, {'s': z.st, 'e': z.at}) ELSE z.done END) AS c FROM f)
SELECT g.doc_id, CAST(row_number() OVER (PARTITION BY g.doc_id ORDER BY c.s) - 1 AS INT) AS ordinal, heading, CAST(c.s + 1 AS INT) AS start_line, CAST(c.e + 1 AS INT) AS end_line, sha256(array_to_string(list_slice(ls, c.s + 1, c.e + 1), chr(10))) AS body_sha FROM g JOIN l ON l.doc_id = g.doc_id"""


def md_sections(spark, sf):
    """Sections of documents whose every third line is made a heading."""
    made = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l, i: F.when(i % 3 == 1, F.concat(F.lit("## "), F.left(l, F.lit(20)), F.lit(" ##"))).otherwise(l)), "\n")
    return chunking.sections(T.table(spark, sf, "documents").select("doc_id", made.alias("text")), "doc_id")


SECTIONS_SQL = """WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 h AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 1 THEN trim(rtrim(trim(left(line, 20) || ' ##', ' ' || chr(9)), '#'), ' ' || chr(9)) END AS title FROM l),
 s AS (SELECT *, CAST(sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS section FROM h)
SELECT doc_id, section, coalesce(max(title), '') AS heading, CAST(min(pos) + 1 AS INT) AS start_line, count(*) AS n_lines FROM s GROUP BY doc_id, section"""


def header_lines(spark, sf):
    """Documents as pages of files, whole texts, with a header above two of three."""
    made = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" Header "), (F.col("doc_id") % 40).cast("string"), F.lit(" \n"), "text")).otherwise(F.col("text"))
    return corpus.edge_lines(T.table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("file"), F.col("doc_id").alias("page"), made.alias("text")))


HEADER_SQL = """WITH p AS (SELECT doc_id % 40 AS file, CASE WHEN doc_id % 3 <> 0 THEN ' Header ' || (doc_id % 40) || ' ' || chr(10) || text ELSE text END AS text FROM documents),
 l AS (SELECT file, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p),
 e AS (SELECT file, unnest(list_distinct([ls[1], ls[-1]])) AS line FROM l WHERE len(ls) > 0)
SELECT file, line, count(*) AS n FROM e JOIN (SELECT file, count(*) AS pages FROM p GROUP BY 1 HAVING count(*) >= 2) USING (file) GROUP BY file, line, pages HAVING count(*) >= greatest(2, (pages + 1) // 2) AND length(line) <= 120"""


def authority_rank(spark, sf):
    a = F.col("authority")
    return T.chunks(spark, sf).select("chunk_id", ranking.authority_rank(a).cast("long").alias("ar"), ranking.authority_boost(a).alias("boost"), ranking.worth_hydrating(a).alias("hydrate"))


def version_preference(spark, sf):
    v = ranking.version_preference(F.col("product_version"), F.lit("1.2"))
    return T.chunks(spark, sf).groupBy("product_version").agg(F.sum(v).alias("bias"), F.count(F.lit(1)).alias("n"))


def path_classes(spark, sf):
    """Classes of made-up paths, one for each document."""
    dirs = ["vendor", "src", "docs", "examples", "tests", "include", "generated", "a/test", "config"]
    names = ["x.go", "readme.md", "license", "test_a.py", "b.json", "c.h", "makefile", "d.pb.go", "e.sql", "f.bin", "g_test.go"]
    made = F.concat(F.element_at(F.array(*map(F.lit, dirs)), (F.col("doc_id") % 9 + 1).cast("int")), F.lit("/"), F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 11 + 1).cast("int")))
    d = T.table(spark, sf, "documents").select(made.alias("path")).distinct()
    return d.select("path", classify.path_class(F.col("path")).alias("class"), classify.language(F.col("path")).alias("language"), classify.infer_authority(F.lit("sdk"), F.col("path")).alias("authority"))


PATHS_SQL = r"""WITH p AS (SELECT DISTINCT (['vendor', 'src', 'docs', 'examples', 'tests', 'include', 'generated', 'a/test', 'config'])[doc_id % 9 + 1] || '/' ||
  (['x.go', 'readme.md', 'license', 'test_a.py', 'b.json', 'c.h', 'makefile', 'd.pb.go', 'e.sql', 'f.bin', 'g_test.go'])[doc_id % 11 + 1] AS path FROM documents),
 b AS (SELECT path, split_part(path, '/', -1) AS base, CASE WHEN contains(split_part(path, '/', -1), '.') THEN '.' || split_part(path, '.', -1) ELSE '' END AS ext FROM p)
SELECT path, CASE WHEN path LIKE 'vendor/%' THEN 'third_party'
  WHEN path LIKE 'tests/%' OR path LIKE '%/test/%' OR base LIKE '%\_test.go' ESCAPE '\' OR base LIKE 'test\_%' ESCAPE '\' THEN 'test' WHEN path LIKE 'examples/%' THEN 'example'
  WHEN base = 'license' THEN 'project_meta' WHEN path LIKE '%/docs/%' OR ext = '.md' THEN 'documentation' WHEN base = 'makefile' THEN 'build_file' WHEN ext = '.json' THEN 'configuration'
  WHEN path LIKE '%/generated/%' OR path LIKE '%.pb.go%' THEN 'generated' WHEN ext = '.h' THEN 'public_header' WHEN ext IN ('.go', '.sql', '.py') THEN 'source' ELSE 'unknown' END AS class,
 CASE ext WHEN '.go' THEN 'go' WHEN '.h' THEN 'c' WHEN '.py' THEN 'python' ELSE '' END AS language,
 CASE WHEN path LIKE 'examples/%' THEN 'official_example' WHEN path LIKE 'docs/%' THEN 'official_documentation' ELSE 'unknown' END AS authority FROM b"""


def trust_mapping(spark, sf):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.expr(f"doc_id div {k}") % len(xs) + 1).cast("int"))
    d = T.table(spark, sf, "documents").select(pick(["validated", "invalid", "present"], 1).alias("state"), pick(["verified", "draft", "inferred", "deprecated", ""], 3).alias("status"), pick(["E1", "E3", "E4", ""], 15).alias("evidence"), pick(["index", "library"], 60).alias("class")).distinct()
    a, dep = classify.trust(F.col("state"), F.col("status"), F.col("evidence"), F.col("class"))
    return d.select("state", "status", "evidence", "class", a.alias("authority"), dep.alias("deprecated"))


TRUST_SQL = """WITH d AS (SELECT DISTINCT (['validated', 'invalid', 'present'])[doc_id % 3 + 1] AS state, (['verified', 'draft', 'inferred', 'deprecated', ''])[doc_id // 3 % 5 + 1] AS status,
  (['E1', 'E3', 'E4', ''])[doc_id // 15 % 4 + 1] AS evidence, (['index', 'library'])[doc_id // 60 % 2 + 1] AS class FROM documents)
SELECT *, CASE WHEN status = 'deprecated' THEN 'unknown' WHEN state = 'invalid' THEN CASE WHEN status = 'draft' OR evidence = 'E4' THEN 'unknown' ELSE 'official_documentation' END
 WHEN state = 'validated' AND status = 'verified' AND evidence = 'E1' THEN 'curated_internal_recipe' WHEN status = 'verified' AND evidence NOT IN ('E1', '') THEN 'official_documentation'
 WHEN status = 'inferred' OR evidence = 'E3' THEN 'official_documentation' WHEN status = 'draft' OR evidence = 'E4' THEN 'unknown' WHEN class = 'index' THEN 'generated_summary' ELSE 'official_documentation' END AS authority,
 status = 'deprecated' AS deprecated FROM d"""


def package_judgement(spark, sf):
    """Coverage, freshness and the need of a web search for each root's documents taken as a package."""
    c = T.chunks(spark, sf).groupBy("root_name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("product_version").alias("versions"), F.collect_set("authority").alias("authorities"), F.sum(F.col("archived").cast("int")).alias("archived"))
    cov = classify.coverage_of(F.col("n") % 2, F.col("n") % 3, F.col("n"), F.col("n") % 5, F.lit(0))
    fresh = classify.freshness_of(F.col("versions"), F.col("authorities"), F.col("archived"), F.lit(""))
    return c.select("root_name", "n", cov.alias("coverage"), fresh.alias("freshness"), classify.needs_web(cov, fresh).alias("web"))


PACKAGE_SQL = f"""WITH {CHUNKS_SQL}, g AS (SELECT root_name, count(*) AS n, count(DISTINCT product_version) AS v, sum(archived::INT) AS a FROM chunks GROUP BY 1),
 s AS (SELECT *, CASE WHEN n % 2 > 0 THEN 2 ELSE 0 END + CASE WHEN n % 3 > 0 THEN 2 ELSE 0 END + CASE WHEN n >= 3 THEN 1 ELSE 0 END + CASE WHEN n % 5 > 0 THEN 1 ELSE 0 END AS p FROM g),
 t AS (SELECT root_name, n, CASE WHEN p >= 5 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS coverage, CASE WHEN a > 0 THEN 'stale' WHEN v > 1 THEN 'mixed' ELSE 'version-specific' END AS freshness FROM s)
SELECT *, coverage = 'low' OR freshness IN ('stale', 'mixed') AS web FROM t"""


def documents_page(spark, sf):
    return T.table(spark, sf, "documents").where("source = 'src0'").orderBy(F.desc("n_chars"), F.desc("doc_id")).offset(5).limit(25).select("doc_id", "n_chars", "lang")


def best_citation(spark, sf):
    c = T.chunks(spark, sf)
    return corpus.best_per_key(c, ["document_id"], [ranking.authority_rank(F.col("authority")), F.desc("heading"), F.col("chunk_id")]).select("document_id", "chunk_id", "authority")


QUERIES = {
    "upsert_by_hash": (upsert, f"WITH {SNAP_SQL}, f AS (SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.uri = new.uri AND old.hash = new.hash)) SELECT uri, hash, false AS written FROM old WHERE uri NOT IN (SELECT uri FROM f) UNION ALL SELECT uri, hash, true FROM f"),
    "page_change_status": (change_status, f"WITH {SNAP_SQL} SELECT coalesce(o.uri, n.uri) AS uri, CASE WHEN o.uri IS NULL THEN 'new' WHEN n.uri IS NULL THEN 'missing' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.uri = n.uri"),
    "delete_prefix": (delete_prefix, f"WITH {CHUNKS_SQL} SELECT root_name, count(*) AS chunks FROM chunks WHERE NOT starts_with(uri, 'project://src1') GROUP BY 1"),
    "docs_without_labels": (orphan_docs, "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "trust_update": (trust_update, f"WITH {CHUNKS_SQL} SELECT CASE WHEN chunk_id % 8 = 0 THEN 'official_documentation' ELSE authority END AS authority, CASE WHEN chunk_id % 4 = 0 THEN chunk_id % 12 = 0 ELSE deprecated END AS deprecated, count(*) AS n FROM chunks GROUP BY 1, 2"),
    "prune_pages": (generations, """WITH s AS (SELECT url, page_id % 2 AS missing FROM pages WHERE page_id % 3 <> 0), n AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 = 0)
      SELECT coalesce(s.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN 2 ELSE 1 END AS generation, CAST(CASE WHEN n.url IS NOT NULL THEN 0 ELSE missing + 1 END AS INT) AS missing FROM s FULL JOIN n ON s.url = n.url WHERE n.url IS NOT NULL OR missing + 1 < 2"""),
    "root_counts": (root_counts, f"WITH {CHUNKS_SQL} SELECT root_name, count(DISTINCT document_id) AS documents, count(*) AS chunks, count(*) FILTER (WHERE chunk_id % 3 = 1) AS symbols FROM chunks GROUP BY 1"),
    "id_crosscheck": (crosscheck, "WITH l AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'only right' ELSE 'only left' END AS problem FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE l.doc_id IS NULL OR r.doc_id IS NULL"),
    "folder_prefix_join": (folder_prefix, r"WITH p AS (SELECT regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages), f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM p) SELECT folder, count(*) AS files FROM p JOIN f ON path = folder OR starts_with(path, folder || '/') GROUP BY 1"),
    "near_duplicates": (near_duplicates, NEAR_SQL),
    "source_inventory": (inventory, "SELECT source AS name, count(*) AS items, 'local' AS kind FROM documents GROUP BY 1 UNION ALL SELECT regexp_extract(url, '^https?://([^/]+)', 1), count(*), 'web' FROM pages GROUP BY 1 UNION ALL SELECT role, count(*), 'chat' FROM conversations GROUP BY 1"),
    "chunk_size_bounded": (chunk_bounded, CHUNK_SQL),
    "md_sections": (md_sections, SECTIONS_SQL),
    "md_chunks": (md_chunks, MD_CHUNKS_SQL),
    "header_footer_lines": (header_lines, HEADER_SQL),
    "authority_rank": (authority_rank, f"WITH {CHUNKS_SQL} SELECT chunk_id, CAST({RANK_SQL} AS BIGINT) AS ar, CAST({BOOST_SQL} AS DOUBLE) AS boost, {RANK_SQL} < 5 AS hydrate FROM chunks"),
    "version_preference": (version_preference, f"WITH {CHUNKS_SQL} SELECT product_version, CAST(sum(CASE WHEN product_version = '1.2' THEN 5 ELSE -8 END) AS DOUBLE) AS bias, count(*) AS n FROM chunks GROUP BY 1"),
    "path_classes": (path_classes, PATHS_SQL),
    "trust_mapping": (trust_mapping, TRUST_SQL),
    "package_judgement": (package_judgement, PACKAGE_SQL),
    "documents_page": (documents_page, "SELECT doc_id, n_chars, lang FROM documents WHERE source = 'src0' ORDER BY n_chars DESC, doc_id DESC LIMIT 25 OFFSET 5"),
    "best_citation": (best_citation, f"WITH {CHUNKS_SQL} SELECT document_id, chunk_id, authority FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {RANK_SQL}, heading DESC, chunk_id) AS r FROM chunks) WHERE r = 1"),
}
