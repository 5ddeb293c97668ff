"""Retrieval queries over the input tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, ranking, text
from ..functions.text import QUERY_STOPWORDS, TERM_STOPWORDS
from ..operators import corpus, evaluate, index, search, symbols, upkeep
from ..sources import tables as T
from ..sources.shared import fresh
from ..sources.tables import AUTHORITY_NAMES, CHUNKS_SQL, SYMBOLS_SQL


def _in(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


#: Terms of a text column as a DuckDB list.
def terms_sql(col: str) -> str:
    split = r"regexp_replace(regexp_replace(w, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g')"
    parts = f"list_transform(list_filter(string_split({split}, '_'), lambda p: p <> ''), lambda p: lower(p))"
    expand = f"list_concat([lower(w)], CASE WHEN len({parts}) >= 2 THEN list_filter({parts}, lambda p: p <> lower(w)) ELSE [] END)"
    raw = rf"regexp_extract_all({col}, '[\p{{L}}\p{{Nd}}_]+')"
    return f"list_filter(flatten(list_transform({raw}, lambda w: {expand})), lambda t: strlen(t) >= 3 AND t NOT IN ({_in(TERM_STOPWORDS)}))"


VECTORS_SQL = f"""vectors AS (SELECT chunk_id, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, term) AS r FROM
  (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({terms_sql("heading || chr(10) || body")}) AS term FROM chunks) GROUP BY ALL)) WHERE r <= 48)"""
QTERMS_SQL = f"""qterms AS (SELECT qid, term FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tf DESC, term) AS r FROM
  (SELECT qid, term, count(*) AS tf FROM (SELECT item_id AS qid, unnest({terms_sql("text")}) AS term FROM benchmark) GROUP BY ALL)) WHERE r <= 48)"""
ROOTS = "CASE WHEN qid % 5 <> 0 THEN list_slice(['src' || (qid % 20), 'src' || ((qid + 1) % 20), 'src' || ((qid + 7) % 20)], 1, 2 + qid % 2) END"


def lookup_sql(scoped: bool = False) -> str:
    """qn: the chunks of each query's roots; lookup: its terms with weights, and those that look up postings."""
    within = "WHERE qid % 5 = 0 OR list_contains(roots, root_name)" if scoped else ""
    return f"""roots_of AS (SELECT item_id AS qid, {ROOTS.replace("qid", "item_id") if scoped else "NULL"} AS roots FROM benchmark),
 qn AS (SELECT qid, count(*) AS n FROM roots_of, chunks {within} GROUP BY qid),
 dfs AS (SELECT q.qid, q.term, count(*) AS df FROM qterms q JOIN vectors v ON v.term = q.term JOIN chunks c ON c.chunk_id = v.chunk_id JOIN roots_of r ON r.qid = q.qid {within.replace("qid %", "q.qid %")} GROUP BY ALL),
 lookup AS (SELECT qid, term, w, CASE WHEN max(rare) OVER (PARTITION BY qid) THEN rare AND r <= 16 ELSE r <= 3 END AS picked FROM
  (SELECT *, row_number() OVER (PARTITION BY qid, rare ORDER BY w DESC, term) AS r FROM
   (SELECT q.qid, q.term, ln(1 + CAST(greatest(n, 1) AS DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS w, coalesce(df, 0) <= n * 0.15 AS rare
    FROM qterms q JOIN qn ON qn.qid = q.qid LEFT JOIN dfs d ON q.term = d.term AND q.qid = d.qid)))"""


BOOST_SQL = "CASE authority " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in ranking.AUTHORITIES) + " ELSE 0 END"
RANK_SQL = "CASE authority " + " ".join(f"WHEN '{a}' THEN {i}" for i, (a, _) in enumerate(ranking.AUTHORITIES)) + " ELSE 7 END"
KIND_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranking.KIND_ORDER.items()) + " ELSE 5 END"
def semantic_sql(pool: int = 500, scoped: bool = False) -> str:
    within = "AND (l.qid % 5 = 0 OR list_contains(roots, c.root_name))" if scoped else ""
    return f"""sims AS (SELECT p.qid, p.chunk_id, sum(w) / (max(q_norm) * sqrt(max(size))) AS similarity FROM
   (SELECT qid, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m DESC, chunk_id) AS r FROM
     (SELECT l.qid, v.chunk_id, count(*) AS m FROM vectors v JOIN lookup l ON v.term = l.term AND picked JOIN chunks c ON c.chunk_id = v.chunk_id JOIN roots_of r ON r.qid = l.qid {within} GROUP BY l.qid, v.chunk_id)) WHERE r <= {pool}) p
   JOIN vectors v ON v.chunk_id = p.chunk_id JOIN lookup l ON l.qid = p.qid AND l.term = v.term
   JOIN (SELECT chunk_id, count(*) AS size FROM vectors GROUP BY chunk_id) s ON s.chunk_id = p.chunk_id
   JOIN (SELECT qid, sqrt(sum(w * w)) AS q_norm FROM lookup GROUP BY qid) nn ON nn.qid = p.qid GROUP BY p.qid, p.chunk_id),
 semantic AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, similarity, score FROM
   (SELECT qid, s.chunk_id, similarity, round(2 * similarity + {BOOST_SQL}, 9) AS score FROM sims s JOIN chunks c ON c.chunk_id = s.chunk_id WHERE similarity >= 0.12))"""


WITH = f"WITH {CHUNKS_SQL}, {VECTORS_SQL}"


def words_sql(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{Nd}}]+')"


def asked_sql(content: bool, scoped: bool = False) -> str:
    """asked0: each query's words, phrases and roots; flat: each chunk's words; tf, and the sums of matching chunks."""
    toks = content_sql("text") if content else r"list_filter(regexp_split_to_array(trim(text), '\s+'), lambda t: t <> '')"
    within = "WHERE roots IS NULL OR list_contains(roots, root_name)" if scoped else ""
    return f"""asked0 AS (SELECT qid, query, roots, list_distinct(flatten(each)) AS ws, list_distinct(list_filter(each, lambda x: len(x) > 1)) AS ph FROM
   (SELECT item_id AS qid, text AS query, {ROOTS.replace("qid", "item_id") if scoped else "CAST(NULL AS VARCHAR[])"} AS roots, list_transform({toks}, lambda t: {words_sql("t")}) AS each FROM benchmark)),
 asked AS (SELECT qid, roots, unnest(ws) AS word, len(ws) AS n_words FROM asked0),
 occurs AS (SELECT chunk_id, unnest({words_sql("heading")}) AS word, 10.0 AS x FROM chunks UNION ALL SELECT chunk_id, unnest({words_sql("body")}), 1.0 FROM chunks),
 flat AS (SELECT chunk_id, root_name, ' ' || array_to_string({words_sql("heading")}, ' ') || ' ' AS h, ' ' || array_to_string({words_sql("body")}, ' ') || ' ' AS b, len({words_sql("heading")}) + len({words_sql("body")}) AS len FROM chunks),
 tf AS (SELECT word, chunk_id, sum(x) AS tf FROM occurs WHERE word IN (SELECT word FROM asked) GROUP BY ALL),
 sums AS (SELECT qid, tf.chunk_id, count(*) AS c, n_words, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS rank
   FROM tf JOIN (SELECT word, count(*) AS df FROM tf GROUP BY word) d ON d.word = tf.word JOIN asked ON asked.word = tf.word JOIN flat ON flat.chunk_id = tf.chunk_id,
     (SELECT count(*) AS n, avg(len) AS avg_len FROM flat) {within} GROUP BY qid, tf.chunk_id, n_words),
 every AS (SELECT s.qid, s.chunk_id, rank FROM sums s JOIN asked0 a ON a.qid = s.qid JOIN flat f ON f.chunk_id = s.chunk_id
   WHERE c = n_words AND len(list_filter(ph, lambda p: NOT contains(h, ' ' || array_to_string(p, ' ') || ' ') AND NOT contains(b, ' ' || array_to_string(p, ' ') || ' '))) = 0),
 lex AS (SELECT qid, chunk_id, rank, 'and' AS mode FROM every UNION ALL SELECT qid, chunk_id, rank, 'or' FROM sums WHERE qid NOT IN (SELECT qid FROM every))"""


def words_sql(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{Nd}}]+')"


def content_sql(col: str) -> str:
    """A query's content tokens as a DuckDB list."""
    toks = rf"list_filter(regexp_split_to_array(trim({col}), '\s+'), lambda t: t <> '' AND upper(t) NOT IN ('AND', 'OR', 'NOT', 'NEAR'))"
    bare = "lower(trim(t, '.,;:()[]{}\"'''))"
    kept = f"list_filter({toks}, lambda t: strlen({bare}) >= 3 AND {bare} NOT IN ({_in(QUERY_STOPWORDS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {toks} END"


def term_vectors(spark, sf):
    v = index.vectors_of(T.chunks(spark, sf), ["chunk_id"], "heading", "body")
    return v.where(F.size("v") > 0).select("chunk_id", F.array_join(F.array_sort("v.term"), " ").alias("terms"), F.size("v").cast("long").alias("n"))


def term_df(spark, sf):
    v = index.term_vectors(T.chunks(spark, sf), ["chunk_id", "root_name"], "heading", "body")
    return index.document_frequency(v, "root_name")


def kept_up(spark, sf):
    """An index of three quarters of the documents, brought up to date by two batches: new and replaced ones, then removed ones."""
    chunks, part = T.chunks(spark, sf), F.col("document_id") % 4
    ix = upkeep.TermIndex(spark, fresh(spark, "upkeep"))
    ix.create(chunks.where(part != 0))
    body = F.when(part == 1, F.concat(F.lit("updated "), "body", F.lit(" revised"))).otherwise(F.col("body"))
    ids = chunks.select("document_id").distinct()
    ix.apply(ids.where(part <= 1), chunks.withColumn("body", body).where(part <= 1))
    ix.apply(ids.where(part == 2), chunks.limit(0))
    held = ix.postings().groupBy("root_name", "term").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tf"))
    return ix.frequency().join(held, ["root_name", "term"], "full").join(ix.roots().withColumnRenamed("n", "chunks"), "root_name", "full")


def index_stats(spark, sf):
    return corpus.index_stats(T.index(spark, sf).postings)


def lookup_terms(spark, sf):
    out = search.lookup_terms(T.search_queries(spark, sf), T.index(spark, sf))
    return out.select("qid", "term", F.round("w", 6).alias("w"), "picked")


def semantic_topk(spark, sf):
    return search.semantic_candidates(T.index(spark, sf), T.search_queries(spark, sf))


def semantic_scoped(spark, sf):
    """Within the roots of each query, by which its terms are weighed too."""
    return search.semantic_candidates(T.index(spark, sf), T.scoped_queries(spark, sf))


def bm25_search(spark, sf):
    w = Window.partitionBy("qid").orderBy("r", "chunk_id")
    hits = index.bm25(T.index(spark, sf), T.search_queries(spark, sf), most=50).withColumn("r", F.round("rank", 9))
    return hits.withColumn("pos", F.row_number().over(w)).where("pos <= 50").select("qid", "pos", "chunk_id", F.round("rank", 6).alias("rank"))


def search_ranked(spark, sf):
    return search.search(T.index(spark, sf), T.search_queries(spark, sf), limit=10, preferred_version="1.1", semantic=True)


def search_scoped(spark, sf):
    return search.search(T.index(spark, sf), T.scoped_queries(spark, sf), limit=10, preferred_version="1.1", semantic=True)


def search_sql(scoped: bool = False) -> str:
    """Lexical, path and semantic candidates of whole queries, in one ranking."""
    inside = "AND (roots IS NULL OR list_contains(roots, root_name))" if scoped else ""
    return f"""WITH {CHUNKS_SQL}, {VECTORS_SQL}, {QTERMS_SQL}, {lookup_sql(scoped)}, {semantic_sql(250, scoped)}, {asked_sql(True, scoped)},
 lexical AS (SELECT qid, chunk_id, rank, 0 AS origin FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), chunk_id) AS pos FROM lex) WHERE pos <= 40),
 paths AS (SELECT qid, chunk_id, 0.0 AS rank, 1 AS origin FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS r FROM chunks, asked0
   WHERE ordinal = 0 AND trim(query) <> '' AND (contains(lower(path), lower(query)) OR contains(lower(title), lower(query)) OR contains(lower(uri), lower(query))) {inside}) WHERE r <= 40),
 near AS (SELECT qid, chunk_id, 0.0 AS rank, 2 AS origin FROM semantic WHERE rank <= 10),
 found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY origin) AS r FROM (FROM lexical UNION ALL FROM paths UNION ALL FROM near)) WHERE r = 1),
 hits AS (SELECT f.*, c.document_id, {RANK_SQL} AS ar, lower(trim(query)) AS q, lower(split_part(path, '/', -1)) AS base, lower(path) AS p, lower(title) AS t, lower(heading) AS h, product_version,
   {BOOST_SQL} AS boost, archived, deprecated, body, left(body, 240) AS head, regexp_extract(left(body, 240), '^([\\s\\S]*)[ \\n][^ \\n]*$', 1) AS cut,
   list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda w: w <> '' AND upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR') AND (regexp_matches(w, '[:.#()/<>_]') OR regexp_matches(w, '[A-Z]') AND (regexp_matches(w, '[a-z]') OR strlen(w) > 2))) AS syms
   FROM found f JOIN chunks c ON c.chunk_id = f.chunk_id JOIN asked0 USING (qid)),
 scored AS (SELECT *, CASE WHEN base = q OR regexp_replace(base, '\\.[^.]*$', '') = q THEN 28 WHEN contains(base, q) THEN 18 WHEN contains(p, q) THEN 12 ELSE 0 END AS names,
   CASE WHEN base = q OR regexp_replace(base, '\\.[^.]*$', '') = q OR contains(base, q) THEN 'filename' WHEN contains(p, q) THEN 'path'
        WHEN contains(t, q) OR contains(h, q) THEN 'heading' ELSE 'body' END AS k,
   lower(CASE WHEN length(body) <= 240 THEN body WHEN cut <> '' AND strlen(head) - strlen(cut) <= 40 THEN cut ELSE head END) AS snip FROM hits),
 seen AS (SELECT *, len(list_filter(syms, lambda w: contains(h, lower(w)) OR contains(t, lower(w)) OR contains(snip, lower(w)))) AS n_seen, len(list_filter(syms, lambda w: contains(base, lower(w)))) AS n_base FROM scored),
 final AS (SELECT *, CASE WHEN n_seen > 0 THEN 'symbol' WHEN origin = 1 AND k = 'body' THEN 'path' ELSE k END AS match_kind,
   round(-rank + boost + names + CASE WHEN contains(t, q) THEN 6 ELSE 0 END + CASE WHEN contains(h, q) THEN 10 ELSE 0 END
     - CASE WHEN archived THEN 25 ELSE 0 END - CASE WHEN deprecated THEN 20 ELSE 0 END + CASE WHEN origin = 1 AND k = 'body' AND n_seen = 0 THEN 8 ELSE 0 END
     + 14 * n_seen + 8 * n_base + CASE WHEN product_version = '1.1' THEN 5 ELSE -8 END, 9) AS score FROM seen),
 per AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY ar, score DESC, round(rank, 9), origin, chunk_id) AS d FROM final)
SELECT qid, CAST(n AS INT) AS rank, chunk_id, document_id, round(score, 6) AS score, match_kind FROM
 (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ar, score DESC, round(rank, 9), origin, chunk_id) AS n FROM per WHERE d <= 3) WHERE n <= 10"""


def or_fallback(spark, sf):
    """Hits are counted by query before they meet; the search for some words is for the queries without hits on all alone."""
    ix, q, at = T.index(spark, sf), T.search_queries(spark, sf), fresh(spark, "fallback")

    def counts(asked, all_words: bool):
        hits = index.bm25(ix, asked, all_words=all_words, content=True)
        return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.min("chunk_id").alias("first")).select("qid", F.lit("and" if all_words else "or").alias("mode"), "hits", "first")

    counts(q, True).write.parquet(at)
    every = spark.read.parquet(at)
    return search.or_fallback(every, counts(q.join(every.select("qid"), "qid", "left_anti"), False))


def phrase_search(spark, sf):
    """Chunks that hold a whole benchmark item, word after word."""
    q = T.search_queries(spark, sf).select(F.col("qid").alias("pid"), index.words(F.col("query")).alias("ws"), F.lit(None).cast("array<string>").alias("roots"))
    return index.phrase_hits(T.index(spark, sf), q).select(F.col("pid").alias("qid"), "chunk_id")


PHRASE_SQL = f"""WITH {CHUNKS_SQL}, f AS (SELECT chunk_id, ' ' || array_to_string({words_sql("heading")}, ' ') || ' ' AS h, ' ' || array_to_string({words_sql("body")}, ' ') || ' ' AS b FROM chunks)
SELECT qid, chunk_id FROM f, (SELECT item_id AS qid, ' ' || array_to_string({words_sql("text")}, ' ') || ' ' AS p FROM benchmark) WHERE contains(b, p) OR contains(h, p)"""


def snippets(spark, sf):
    """The excerpt around the first content word of the three first hits of each query."""
    ix, q = T.index(spark, sf), T.search_queries(spark, sf)
    w = Window.partitionBy("qid").orderBy(F.round("rank", 9), "chunk_id")
    top = index.bm25(ix, q, all_words=False, content=True, most=3).withColumn("r", F.row_number().over(w)).where("r <= 3").select("qid", "chunk_id")
    return search.snippets(ix, top, q)


SNIPPET_SQL = rf"""WITH {CHUNKS_SQL}, {asked_sql(True)},
 top AS (SELECT qid, chunk_id FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), chunk_id) AS r FROM sums) WHERE r <= 3),
 f AS (SELECT qid, chunk_id, ws, list_filter(regexp_split_to_array(body, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS fs FROM top JOIN chunks USING (chunk_id) JOIN asked0 USING (qid)),
 m AS (SELECT *, list_transform(fs, lambda w: list_has_any({words_sql("w")}, ws)) AS hit FROM f),
 s AS (SELECT *, greatest(0, least(coalesce(list_position(hit, true), 1) - 1 - {search.SNIPPET_WORDS // 2}, len(fs) - {search.SNIPPET_WORDS})) AS st FROM m)
SELECT qid, chunk_id, CASE WHEN st > 0 THEN '… ' ELSE '' END || array_to_string(list_transform(fs[st + 1:st + {search.SNIPPET_WORDS}], lambda w, i: CASE WHEN hit[st + i] THEN '<b>' || w || '</b>' ELSE w END), ' ')
 || CASE WHEN st + {search.SNIPPET_WORDS} < len(fs) THEN ' …' ELSE '' END AS snippet FROM s"""


def symbol_forms(spark, sf):
    return symbols.with_forms(T.symbols(spark, sf)).select("id", "name_norm", "unqualified_name", "namespace")


_BARE = r"regexp_replace(trim(name), '\(\)$', '')"
_TAIL = f"CASE WHEN contains({_BARE}, '::') THEN split_part({_BARE}, '::', -1) WHEN contains({_BARE}, '.') THEN split_part({_BARE}, '.', -1) WHEN contains({_BARE}, '#') THEN split_part({_BARE}, '#', -1) ELSE {_BARE} END"
_SEP = f"CASE WHEN contains({_BARE}, '::') THEN 2 WHEN contains({_BARE}, '.') OR contains({_BARE}, '#') THEN 1 ELSE 0 END"
FORMS_SQL = rf"""forms AS (SELECT *, lower(regexp_replace({_BARE}, '\s+', '', 'g')) AS name_norm, {_TAIL} AS unqualified_name,
  CASE WHEN {_SEP} = 0 THEN '' ELSE left({_BARE}, length({_BARE}) - length({_TAIL}) - {_SEP}) END AS namespace FROM symbols)"""


def symbol_names(s):
    """(qid, name): every symbol's name, its last part, and a typo of that; qid is three times the id, and the form."""
    forms = [F.col("name"), text.unqualified(F.col("name")), F.concat(F.left(text.unqualified(F.col("name")), F.lit(6)), F.lit("x"), F.expr("substring(name, 99, 9)"))]
    return s.select("id", F.posexplode(F.array(*forms)).alias("form", "name")).select((3 * F.col("id") + F.col("form")).alias("qid"), "name")


def symbol_lookup(spark, sf):
    """Every symbol looked up in each form."""
    s = T.symbols(spark, sf)
    return symbols.find(s, symbol_names(s))


SYMBOL_LOOKUP_SQL = rf"""WITH {SYMBOLS_SQL}, {FORMS_SQL},
 names AS (SELECT 3 * id AS qid, name FROM symbols UNION ALL SELECT 3 * id + 1, unqualified_name FROM forms UNION ALL SELECT 3 * id + 2, left(unqualified_name, 6) || 'x' FROM forms),
 q AS (SELECT qid, trim(name) AS raw, lower(regexp_replace({_BARE}, '\s+', '', 'g')) AS qn, lower({_TAIL}) AS qu, {_SEP} > 0 OR regexp_matches(trim(name), '[.#]') AS qualified FROM names),
 staged AS (SELECT *, CASE WHEN name_norm = qn THEN 0 WHEN qualified AND lower(trim(name)) = qn THEN 1 WHEN lower(unqualified_name) = qu OR name_norm = qu THEN 2
   WHEN starts_with(name_norm, qn) AND (contains(name_norm, qu) OR name_norm = qn) THEN 3 WHEN strlen(qu) >= 3 AND ends_with(name_norm, qu) THEN 4
   WHEN strlen(qu) >= 3 AND contains(name_norm, qu) THEN 5 END AS stage FROM forms, q),
 fuzzy AS (SELECT *, levenshtein(qu, lower(unqualified_name)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {KIND_SQL}, start_line, id) AS r FROM forms, q
   WHERE strlen(qu) >= 4 AND (starts_with(lower(unqualified_name), left(qu, 3)) OR starts_with(name_norm, left(qu, 3)))) WHERE r <= 50),
 u AS (SELECT qid, stage, id, kind, authority, start_line,
   CASE WHEN stage = 0 AND name = raw THEN CASE WHEN qualified THEN 'exact_qualified' ELSE 'exact' END
     ELSE (['exact_normalized', 'exact_qualified', 'exact_unqualified', 'prefix', 'suffix', 'token'])[stage + 1] END AS match_type,
   CASE WHEN stage = 0 AND name = raw AND qualified THEN 0.98 ELSE ([1.0, 0.98, 0.92, 0.75, 0.7, 0.55])[stage + 1] END AS confidence FROM staged WHERE stage IS NOT NULL
   UNION ALL SELECT qid, 6, id, kind, authority, start_line, 'fuzzy', greatest(0.45 - 0.1 * d, 0.25) FROM fuzzy WHERE d BETWEEN 1 AND 2),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY stage) AS r FROM u) WHERE r = 1)
SELECT qid, CAST(rank AS INT) AS rank, id, match_type, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM
 (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, {KIND_SQL}, {RANK_SQL}, start_line, id) AS rank FROM o) WHERE rank <= 20"""


def token_estimate(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", text.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


def camel_split(spark, sf):
    s = T.symbols(spark, sf)
    return s.select("id", F.array_join(text.identifier_parts(text.unqualified(F.col("name"))), "|").alias("parts"))


CAMEL_SQL = rf"""WITH {SYMBOLS_SQL}, {FORMS_SQL} SELECT id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(unqualified_name, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g'), '_'), lambda p: p <> ''), '|') AS parts FROM forms"""


def query_parse(spark, sf):
    return T.search_queries(spark, sf).select("qid", text.match_query(F.col("query")).alias("match"), text.match_query(F.col("query"), " OR ").alias("match_or"))


def parse_sql(joiner: str) -> str:
    some = content_sql("text")
    clean = f"list_filter(list_transform({some}, lambda t: trim(replace(t, '\"', ''))), lambda t: t NOT IN ('', '*'))"
    return f"array_to_string(list_transform({clean}, lambda t: '\"' || t || '\"'), '{joiner}')"


def citation_diversity(spark, sf):
    c = T.chunks(spark, sf).withColumn("qid", F.col("root_name"))
    bucket = F.when(F.col("authority").isin("current_project", "related_internal_project"), "project").when(F.col("authority").isin("generated_summary", "third_party_reference", "unknown"), "weak").otherwise(F.col("authority"))
    out = corpus.reserved(c, bucket, [ranking.authority_rank(F.col("authority")), F.col("chunk_id")], 12)
    return out.select("root_name", "position", "chunk_id", "authority")


DIVERSITY_SQL = f"""WITH {CHUNKS_SQL}, b AS (SELECT *, CASE WHEN authority IN ('current_project', 'related_internal_project') THEN 'project'
  WHEN authority IN ('generated_summary', 'third_party_reference', 'unknown') THEN 'weak' ELSE authority END AS bucket, {RANK_SQL} AS ar FROM chunks),
 c AS (SELECT *, row_number() OVER (PARTITION BY root_name, bucket ORDER BY ar, chunk_id) AS n FROM b)
SELECT root_name, CAST(position AS INT) AS position, chunk_id, authority FROM
 (SELECT *, row_number() OVER (PARTITION BY root_name ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, ar, chunk_id) AS position FROM c) WHERE position <= 12"""


def root_inference(spark, sf):
    """Roots scored by cues in documents' texts: the share of the best that is kept is 60 %."""
    cues = spark.createDataFrame([("the", "src0", 80), ("ing", "src1", 75), ("ción", "src2", 85), ("ment", "src3", 70), ("ung", "src1", 60)], "cue string, root string, weight int")
    d = T.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    s = d.join(F.broadcast(cues), F.contains("t", "cue")).groupBy("doc_id", "root").agg(F.sum("weight").alias("score"))
    top = s.withColumn("top", F.max("score").over(Window.partitionBy("doc_id")))
    return top.where(F.col("score") * 100 >= F.col("top") * 60).select("doc_id", "root", "score")


INFERENCE_SQL = """WITH cues(cue, root, weight) AS (VALUES ('the', 'src0', 80), ('ing', 'src1', 75), ('ción', 'src2', 85), ('ment', 'src3', 70), ('ung', 'src1', 60)),
 s AS (SELECT doc_id, root, CAST(sum(weight) AS BIGINT) AS score FROM documents, cues WHERE contains(lower(text), cue) GROUP BY ALL)
SELECT doc_id, root, score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM s) WHERE score * 100 >= top * 60"""


def eval_recall(spark, sf):
    """Benchmark items found verbatim in documents: the share of items with a source, and sources per item."""
    b, d = T.table(spark, sf, "benchmark"), T.table(spark, sf, "documents").where("text is not null")
    held = evaluate.containing(d, b.select(F.col("item_id").alias("id"), F.col("text").alias("needle")), T.index(spark, sf))
    hit = held.groupBy(F.col("id").alias("item_id")).agg(F.count(F.lit(1)).alias("sources"))
    return b.join(hit, "item_id", "left").select("item_id", F.coalesce("sources", F.lit(0)).alias("sources"), F.col("sources").isNotNull().alias("found"))


KEPT_UP_SQL = f"""WITH {CHUNKS_SQL.replace("text AS body", "CASE WHEN doc_id // 3 % 4 = 1 THEN 'updated ' || text || ' revised' ELSE text END AS body").replace("text IS NOT NULL)", "text IS NOT NULL AND doc_id // 3 % 4 <> 2)")}, {VECTORS_SQL},
 held AS (SELECT root_name, count(*) AS chunks FROM chunks GROUP BY root_name)
SELECT root_name, term, count(*) AS df, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tf, max(held.chunks) AS chunks FROM vectors JOIN chunks USING (chunk_id) JOIN held USING (root_name) GROUP BY root_name, term"""

QUERIES = {
    "semantic_topk": (semantic_topk, f"{WITH}, {QTERMS_SQL}, {lookup_sql()}, {semantic_sql()} SELECT qid, rank, chunk_id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM semantic WHERE rank <= 20"),
    "semantic_scoped": (semantic_scoped, f"{WITH}, {QTERMS_SQL}, {lookup_sql(True)}, {semantic_sql(500, True)} SELECT qid, rank, chunk_id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM semantic WHERE rank <= 20"),
    "term_vector_top48": (term_vectors, f"{WITH} SELECT chunk_id, string_agg(term, ' ' ORDER BY term) AS terms, count(*) AS n FROM vectors GROUP BY chunk_id"),
    "term_df": (term_df, f"{WITH} SELECT root_name, term, count(*) AS df FROM vectors JOIN chunks USING (chunk_id) GROUP BY ALL"),
    "index_upkeep": (kept_up, KEPT_UP_SQL),
    "index_stats": (index_stats, f"{WITH} SELECT count(DISTINCT chunk_id) AS vectors, count(*) AS postings, count(DISTINCT term) AS terms, round(count(*) / count(DISTINCT chunk_id), 6) AS avg_terms FROM vectors"),
    "lookup_terms_pruned": (lookup_terms, f"{WITH}, {QTERMS_SQL}, {lookup_sql()} SELECT qid, term, round(w, 6) AS w, picked FROM lookup"),
    "bm25_search": (bm25_search, f"WITH {CHUNKS_SQL}, {asked_sql(False)} SELECT qid, CAST(pos AS INT) AS pos, chunk_id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), chunk_id) AS pos FROM every) WHERE pos <= 50"),
    "search_ranked": (search_ranked, search_sql()),
    "search_scoped": (search_scoped, search_sql(True)),
    "or_fallback": (or_fallback, f"WITH {CHUNKS_SQL}, {asked_sql(True)} SELECT qid, mode, count(*) AS hits, min(chunk_id) AS first FROM lex GROUP BY ALL"),
    "phrase_search": (phrase_search, PHRASE_SQL),
    "search_snippets": (snippets, SNIPPET_SQL),
    "symbol_forms": (symbol_forms, f"WITH {SYMBOLS_SQL}, {FORMS_SQL} SELECT id, name_norm, unqualified_name, namespace FROM forms"),
    "symbol_staged_lookup": (symbol_lookup, SYMBOL_LOOKUP_SQL),
    "camel_split": (camel_split, CAMEL_SQL),
    "token_estimate": (token_estimate, "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents"),
    "query_parse": (query_parse, f"SELECT item_id AS qid, {parse_sql(' AND ')} AS match, {parse_sql(' OR ')} AS match_or FROM benchmark"),
    "citation_diversity": (citation_diversity, DIVERSITY_SQL),
    "root_inference": (root_inference, INFERENCE_SQL),
    "eval_recall": (eval_recall, "SELECT item_id, count(d.doc_id) AS sources, count(d.doc_id) > 0 AS found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id"),
}
