"""Context packages of all benchmark items as tasks, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import AUTHORITIES
from ..operators import batch_context as B
from ..operators import recipes
from ..operators.index import set_down
from ..sources import tables as T
from ..sources.tables import CHUNKS_SQL, SYMBOLS_SQL
from .retrieval import search_ranked, search_sql


def context_packages(spark, sf):
    """Each item as a task with one of three budgets; its hits, the symbol of its number, and for every fourth a recipe."""
    b = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("task"))
    tasks = b.withColumns({"version": F.lit("1.1"), "most_tokens": F.when(F.col("qid") % 3 == 0, 300).when(F.col("qid") % 3 == 1, 900).otherwise(B.MOST_TOKENS)})
    found = T.symbols(spark, sf).select(F.col("id").alias("qid"), F.lit(1).alias("place"), "name", "kind").join(b.select("qid"), "qid", "left_semi")
    n = F.col("qid").cast("string")
    body = F.concat(F.lit("## Prerequisites\n- sdk "), n, F.lit("\n## Required APIs\n- `Call"), n, F.lit(".Run`\n## Steps\n1. open "), n, F.lit("\n2. close "), n, F.lit("\n## Example\n"), "task")
    made = recipes.read(b.where("qid % 4 = 0").select("qid", body.alias("body")), "qid").withColumn("subject", F.concat(F.lit("Item "), n))
    out = B.assembled(tasks, set_down(search_ranked(spark, sf), "hits"), T.index(spark, sf).chunks, found, made)
    return out.select("qid", "cuts", "estimated_tokens", "coverage", "freshness", F.array_join("roots", ",").alias("roots"), "fingerprint")


def clean_sql(x: str) -> str:
    """functions.excerpts.clean_body."""
    out = rf"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '(?m)^([ \t]*#[ \t]*include[ \t]*)<([^>\r\n]+)>', '\1' || chr(1) || '\2' || chr(2), 'g')"
    out = rf"regexp_replace({out}, '</?[A-Za-z][A-Za-z0-9]*\b[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = rf"translate(regexp_replace({out}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), chr(1) || chr(2), '<>')"
    out = rf"regexp_replace({out}, '(?m)(?:^[ \t]*#[ \t]*include[ \t]*\n){{2,}}', '/* #include … */' || chr(10), 'g')"
    return rf"trim(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10))"


def clip_sql(x: str, n: str | int) -> str:
    """operators.recipes.clip."""
    tail = f"reverse(right(left({x}, {n}), 40))"
    back = f"list_min(list_filter([instr({tail}, ' '), instr({tail}, chr(10))], lambda k: k > 0))"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE left({x}, CAST(CASE WHEN {n} > 41 THEN {n} - coalesce({back}, 0) ELSE {n} END AS BIGINT)) || '…' END"


def once(x: str) -> str:
    """A list's distinct elements in order."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def has(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def of_task(value: str, cond: str) -> str:
    return once(f"coalesce(list({value} ORDER BY rank, chunk_id) FILTER (WHERE {cond}), [])")


def cut_sql(field: str) -> str:
    """A field after the cut k."""
    out = field
    for k, (name, rule) in enumerate(B.CUTS, 1):
        if name != field:
            continue
        if isinstance(rule, int):
            new = f"{field}[1:len({field}) - 1]"
        elif rule == "clear":
            new = "''" if field == "note" else f"{field}[1:0]"
        elif field == "summary":
            new = f"left(summary, {B.SUMMARY}) || '…'"
        elif field == "examples":
            new = f"list_transform(examples, lambda e: struct_pack(uri := e.uri, title := e.title, excerpt := {clip_sql('e.excerpt', 'strlen(e.excerpt) // 2')}))"
        else:
            new = f"[{clip_sql(f'{field}[1]', f'strlen({field}[1]) // 2')}]"
        out = f"CASE WHEN k = {k} THEN {new} ELSE {out} END"
    return f"{out} AS {field}"


def which_sql() -> str:
    """The cut that comes next; 0 for none."""
    cases = []
    for k, (field, rule) in enumerate(B.CUTS, 1):
        if isinstance(rule, int):
            cond = f"len({field}) > {rule}"
        elif field in ("summary", "note"):
            cond = f"length({field}) > {B.SUMMARY + 1 if rule == 'shorten' else 0}"
        elif rule == "clear":
            cond = f"len({field}) = 1"
        else:
            cond = f"len({field}) = 1 AND strlen({field}[1]{'.excerpt' if field == 'examples' else ''}) > {B.LONG_TEXT}"
        cases.append(f"WHEN {cond} THEN {k}")
    return f"CASE WHEN most <= 0 OR {SIZE} <= most THEN 0 {' '.join(cases)} ELSE 0 END"


JSON = "to_json(struct_pack(" + ", ".join(f"{f} := {f}" for f in B.FIELDS) + "))"
SIZE = f"CAST(ceil(length({JSON}) / {B.PER_TOKEN}) AS INT)"
STATE = ", ".join(B.FIELDS)
OFFICIAL = ", ".join(f"'{a}'" for a, _ in AUTHORITIES[:4])
CONTEXT_SQL = rf"""WITH RECURSIVE ranked AS ({search_sql()}), {CHUNKS_SQL}, {SYMBOLS_SQL},
 h0 AS (SELECT r.qid, r.rank, c.chunk_id, uri, title, coalesce(heading, '') AS section, authority, root_name, coalesce(product_version, '') AS version, coalesce(archived, false) AS archived, {clean_sql("body")} AS clean FROM ranked r JOIN chunks c USING (chunk_id)),
 h1 AS (SELECT *, {clip_sql("clean", B.EXCERPT)} AS excerpt FROM h0),
 h2 AS (SELECT *, lower(section || ' ' || excerpt) AS low, {clip_sql("excerpt", B.SIGNAL)} AS signal, {clip_sql("excerpt", B.CONVENTION)} AS short, list_transform(string_split(excerpt, chr(10)), lambda l: ltrim(l)) AS ls,
   struct_pack(uri := uri, title := title, section := section, authority := authority, root_name := root_name, version := version) AS cite, row_number() OVER (PARTITION BY qid, uri ORDER BY rank, chunk_id) AS nth FROM h1),
 h3 AS (SELECT *, list_concat(list_transform(list_filter(ls, lambda l: regexp_matches(l, '^[0-9]+[.)][ \t]') AND trim(regexp_replace(l, '^[0-9]+[.)][ \t]', '')) <> ''), lambda l: trim(regexp_replace(l, '^[0-9]+[.)][ \t]', ''))),
   list_transform(list_filter(ls, lambda l: regexp_matches(l, '^[-*+][ \t]') AND trim(l[3:]) <> ''), lambda l: trim(l[3:]))) AS its, list_filter(list_transform(string_split(excerpt, chr(10)), lambda l: trim(l)), lambda l: starts_with(l, '#include')) AS inc FROM h2),
 g AS (SELECT qid, {of_task("signal", has(B.CONSTRAINT))} AS constraints, {of_task("signal", has(B.PITFALL))} AS pitfalls, {of_task("short", "authority = 'current_project'")} AS conventions,
   coalesce(list(struct_pack(uri := uri, title := title, excerpt := excerpt) ORDER BY rank, chunk_id) FILTER (WHERE authority IN ({OFFICIAL}) OR contains(low, 'example')), []) AS examples,
   coalesce(list(cite ORDER BY rank, chunk_id) FILTER (WHERE nth = 1), [])[1:{B.MOST_CITATIONS}] AS citations, bool_or(archived) AS archived, flatten(list(inc ORDER BY rank, chunk_id)) AS includes,
   arg_min(title, rank) AS title, (list(its ORDER BY rank, chunk_id) FILTER (WHERE {has(B.WORKFLOW)} AND len(its) >= 2))[1] AS steps FROM h3 GROUP BY qid),
 t AS (SELECT item_id AS qid, trim(text) AS task, text AS raw, CASE item_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 900 ELSE {B.MOST_TOKENS} END AS most, item_id % 4 = 0 AS made,
   list_filter(list_transform(string_split_regex(trim(text), '\s+'), lambda w: trim(w, '`,.;()<>"''')), lambda w: length(w) >= 3 AND (contains(w, '::') OR contains(w, '.') OR contains(w, '_') OR regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]'))) AS words FROM benchmark),
 a AS (SELECT t.qid, task, most, CASE WHEN made THEN 'Item ' || t.qid ELSE coalesce(title, '') END AS summary,
   list_concat(CASE WHEN made THEN ['Call' || t.qid || '.Run'] ELSE [] END, CASE WHEN s.id IS NULL THEN [] ELSE [s.name] END, words) AS apis0, CASE WHEN s.id IS NULL THEN [] ELSE [struct_pack(name := s.name, kind := s.kind)] END AS symbols,
   coalesce(includes, []) AS inc0, CASE WHEN made THEN ['sdk ' || t.qid] ELSE [] END AS prerequisites, CASE WHEN made THEN ['open ' || t.qid, 'close ' || t.qid] ELSE coalesce(steps, []) END AS sequence,
   list_concat(CASE WHEN made THEN [struct_pack(uri := '', title := 'Item ' || t.qid, excerpt := {clip_sql("trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(10))", recipes.MOST_EXAMPLE)})] ELSE [] END, coalesce(examples, []))[1:{B.MOST_EXAMPLES}] AS examples,
   coalesce(constraints, []) AS constraints, coalesce(pitfalls, []) AS pitfalls, coalesce(conventions, []) AS conventions, coalesce(citations, []) AS citations, coalesce(archived, false) AS archived
   FROM t LEFT JOIN g USING (qid) LEFT JOIN symbols s ON s.id = t.qid),
 c AS (SELECT *, {once("apis0")} AS apis, {once("inc0")} AS includes, 2 * CAST(len(apis0) + len(symbols) > 0 AS INT) + 2 * CAST(len(examples) > 0 AS INT) + CAST(len(citations) >= 3 AS INT) + CAST(len(constraints) + len(pitfalls) > 0 AS INT) + CAST(len(sequence) > 0 AS INT) AS points,
   list_distinct(list_filter(list_transform(citations, lambda c: lower(trim(c.version))), lambda v: v NOT IN ('', 'unknown'))) AS vs FROM a),
 f AS (SELECT *, CASE WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS coverage, CASE WHEN len(citations) = 0 THEN 'unknown' WHEN archived THEN 'stale' WHEN len(vs) > 1 OR len(vs) > 0 AND NOT list_contains(vs, '1.1') THEN 'mixed' WHEN len(vs) = 0 THEN 'unknown' ELSE 'version-specific' END AS freshness FROM c),
 p AS (SELECT *, list_filter([CASE WHEN len(symbols) = 0 THEN 'No symbols matched the task.' END, CASE WHEN len(sequence) = 0 THEN 'No source-grounded call sequence was located.' END, CASE WHEN freshness = 'unknown' THEN 'The version of the sources is not known.' END], lambda m: m IS NOT NULL) AS missing,
   CASE WHEN coverage = 'low' OR freshness IN ('stale', 'mixed', 'unknown') THEN ['Search the web: local sources don''t cover this.'] ELSE [] END AS follow_ups, '{B.NOTE}' AS note FROM f),
 z AS (SELECT qid, most, 0 AS n, {", ".join(f"{f}[1:{B.MOST_APIS if f == 'apis' else B.MOST_SYMBOLS}] AS {f}" if f in ("apis", "symbols") else f for f in B.FIELDS)} FROM p
   UNION ALL SELECT qid, most, n + 1, {", ".join(cut_sql(f) for f in B.FIELDS)} FROM (SELECT *, {which_sql()} AS k FROM z WHERE n < {B.STEPS}) WHERE k > 0),
 e AS (SELECT * FROM z QUALIFY n = max(n) OVER (PARTITION BY qid))
SELECT qid, n AS cuts, {SIZE} AS estimated_tokens, coverage, freshness, array_to_string({once("list_transform(citations, lambda c: c.root_name)")}, ',') AS roots, sha256(CAST({JSON} AS VARCHAR)) AS fingerprint FROM e"""

QUERIES = {"context_packages": (context_packages, CONTEXT_SQL)}
