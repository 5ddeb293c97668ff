"""Selection for a context package: which documents and chunks are added to hits, in which order, and which symbols stay.

All work on a batch of tasks: hits, symbols and citations carry qid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import authority_rank, mapped, worth_hydrating
from ..functions.text import TRIMMED, clip_excerpt

#: Limits of what is added to a package, and characters of an added excerpt.
MOST_DOCUMENTS, CHUNKS_EACH, MOST_BODIES, EXCERPT, MOST_TRACE, MOST_EVIDENCE, MOST_SYMBOLS = 4, 2, 12, 2400, 48, 32, 8
#: Cues of a telling chunk and what one counts, and words of a task that tell nothing.
CUES, CUE_WORTH = ("example", "must ", "must\n", "require", "constraint", "pitfall", "sequence", "steps", "initialization", "call order"), 3
IDLE_WORDS, LEAST_TOKEN = ("that", "with", "from", "this", "have", "into", "using", "create", "server"), 4
#: The order in which bodies are read, and that of roots by their role in a group.
BODY_ORDER = {"official_example": 0, "official_documentation": 1, "curated_internal_recipe": 2, "current_project": 3, "related_internal_project": 3}
ROLE_ORDER = {"official_example": 0, "official_docs": 1, "curated_knowledge": 2, "current_project": 3, "related_project": 4}
OFFICIAL = ("official_example", "official_documentation")
WEAK = ("generated_summary", "third_party_reference", "")


def uri_key(uri: Column | str) -> Column:
    return F.lower(F.trim(uri))


def first_rows(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def task_tokens(task: Column) -> Column:
    """The words of a task that a telling chunk may repeat, in lower case; one that comes twice counts twice."""
    bare = F.transform(F.split(F.lower(F.trim(task)), r"\s+"), lambda t: F.btrim(t, F.lit(TRIMMED)))
    return F.filter(bare, lambda t: (F.octet_length(t) >= LEAST_TOKEN) & ~t.isin(*IDLE_WORDS))


def signal_score(text: Column, tokens: Column) -> Column:
    """What a chunk tells: three for each cue in it, one for each token of the task."""
    low = F.lower(text)
    cues = sum((F.contains(low, F.lit(c)).cast("int") for c in CUES), F.lit(0))
    return CUE_WORTH * cues + F.size(F.filter(tokens, lambda t: F.contains(low, t)))


def signal_chunks(chunks: DataFrame, hits: DataFrame, tasks: DataFrame) -> DataFrame:
    """(qid, chunk_id, score): telling chunks of documents among the hits, which are no hits themselves.

    Of each task's documents worth reading the first MOST_DOCUMENTS count (official ones, then by authority and uri), and
    of each the CHUNKS_EACH chunks of the highest score, by ordinal among equals. chunks has chunk_id, uri, authority,
    ordinal, heading and body; hits has qid and chunk_id; tasks has qid and task.
    """
    narrow = chunks.select("chunk_id", "uri", "authority")
    found = hits.select("qid", "chunk_id").distinct()
    docs = found.join(narrow, "chunk_id").where(worth_hydrating(F.col("authority")) & (F.trim("uri") != "")).select("qid", "uri", "authority").distinct()
    order = [F.when(F.col("authority").isin(*OFFICIAL), 0).otherwise(1), authority_rank(F.col("authority")), F.col("uri")]
    docs = first_rows(docs, ["qid"], order, MOST_DOCUMENTS).select("qid", "uri")
    others = docs.join(chunks.select("chunk_id", "uri", "ordinal", "heading", "body"), "uri").join(found, ["qid", "chunk_id"], "left_anti")
    scored = others.join(tasks.select("qid", task_tokens(F.col("task")).alias("tokens")), "qid")
    scored = scored.withColumn("score", signal_score(F.concat("heading", F.lit("\n"), "body"), F.col("tokens"))).where("score > 0")
    return first_rows(scored, ["qid", "uri"], [F.desc("score"), F.col("ordinal"), F.col("chunk_id")], CHUNKS_EACH).select("qid", "chunk_id", "score")


def cited_documents(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, uri): documents that are cited but not among the hits, worth reading, the first by authority and uri.

    hits has qid and uri; cited (symbols' and citations' documents) has qid, uri and authority.
    """
    c = cited.where((F.trim("uri") != "") & worth_hydrating(F.col("authority"))).withColumn("_key", uri_key("uri"))
    c = c.join(hits.select("qid", uri_key("uri").alias("_key")).distinct(), ["qid", "_key"], "left_anti")
    c = c.groupBy("qid", "_key").agg(F.min(F.struct(authority_rank(F.col("authority")).alias("r"), F.col("uri").alias("uri"))).alias("c"))
    return first_rows(c.select("qid", "c.r", "c.uri"), ["qid"], [F.col("r"), F.col("uri")], MOST_DOCUMENTS).select("qid", "uri")


def bodies(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id, excerpt): clipped bodies of the first MOST_BODIES hits: examples, then documentation, recipes, projects.

    hits has qid, rank and chunk_id; chunks has chunk_id, authority and body.
    """
    rows = hits.select("qid", "rank", "chunk_id").join(chunks.select("chunk_id", "authority"), "chunk_id")
    place = F.coalesce(mapped(F.col("authority"), BODY_ORDER, None).cast("int"), 4 + authority_rank(F.col("authority")))
    first = first_rows(rows, ["qid"], [place, F.col("rank"), F.col("chunk_id")], MOST_BODIES).select("qid", "chunk_id")
    read = first.join(chunks.select("chunk_id", "body").where(F.trim("body") != ""), "chunk_id")
    return read.select("qid", "chunk_id", clip_excerpt(F.col("body"), EXCERPT).alias("excerpt"))


def roots_by_role(members: DataFrame) -> DataFrame:
    """members (group, root_name, role, position) with place: by role, then as they were."""
    w = Window.partitionBy("group").orderBy(mapped(F.col("role"), ROLE_ORDER, len(ROLE_ORDER)), "position", "root_name")
    return members.withColumn("place", F.row_number().over(w))


def package_symbols(symbols: DataFrame, limit: int = MOST_SYMBOLS) -> DataFrame:
    """The best symbol of each name (authority, then no mere mention, then position); weak ones after all others; at most limit.

    symbols has qid, position, name, authority and kind; the rows come back with place, from 1.
    """
    named = symbols.withColumn("_name", F.lower(F.trim("name"))).where("_name <> ''")
    order = [authority_rank(F.col("authority")), (F.col("kind") == "mention").cast("int"), F.col("position")]
    first = named.withColumn("_at", F.min("position").over(Window.partitionBy("qid", "_name")))
    best = first_rows(first, ["qid", "_name"], order, 1)
    w = Window.partitionBy("qid").orderBy(F.col("authority").isin(*WEAK).cast("int"), "_at")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("_name", "_at")


def cue_tokens(hits: DataFrame, tasks: DataFrame, is_api) -> DataFrame:
    """(qid, token): words of hits' headings and snippets, base names, and words of tasks that may name a symbol.

    hits has qid, heading, snippet and path; is_api tells an API name (a column function).
    """
    def words(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, r"\s+"), lambda t: F.btrim(t, F.lit(TRIMMED))), lambda t: t != "")

    plain = F.regexp_replace(F.col("snippet"), "</?b>", "")
    base = F.regexp_replace(F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1), r"\.[^.]*$", "")
    seen = hits.select("qid", F.explode(F.filter(F.concat(words(F.concat_ws(" ", "heading", plain)), F.array(base)), is_api)).alias("token"))
    long = lambda t: (F.octet_length(t) >= 6) | ((F.octet_length(t) >= 5) & is_api(t))
    asked = tasks.select("qid", F.explode(F.filter(words(F.col("task")), long)).alias("token"))
    return seen.unionByName(asked).distinct()


def harvest(hits: DataFrame, symbols: DataFrame, found: DataFrame, limit: int = MOST_SYMBOLS) -> DataFrame:
    """(qid, id, place): symbols for a task without names: those of the hits' documents, then those found by cue tokens.

    hits has qid and document_id; symbols has id, document_id, kind, name; found (qid, id, kind, rank) is a lookup of
    the cue tokens. Calls come only where nothing came before them.
    """
    own = hits.select("qid", "document_id").distinct().join(symbols, "document_id").select("qid", "id", "kind", F.lit(0).alias("_origin"), F.lit(0).alias("_rank"))
    more = found.select("qid", "id", "kind", F.lit(1).alias("_origin"), F.col("rank").alias("_rank"))
    each = own.unionByName(more).groupBy("qid", "id").agg(F.min(F.struct("_origin", "_rank", "kind")).alias("f")).select("qid", "id", "f.*")
    order = [F.col("_origin"), (F.col("kind") == "call").cast("int"), F.col("_rank"), F.col("id")]
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return each.where((F.col("kind") != "call") | (F.col("place") == 1)).where(F.col("place") <= limit).select("qid", "id", "place")


def pins(marked: DataFrame) -> DataFrame:
    """(qid, uri, reason): the first reason (by position) for which a uri is pinned; marked has qid, uri, reason, position."""
    m = marked.where(F.trim("uri") != "").withColumn("_key", uri_key("uri"))
    best = m.groupBy("qid", "_key").agg(F.min(F.struct("position", "uri", "reason")).alias("f"))
    return best.select("qid", "f.uri", "f.reason")


def traced(reasons: DataFrame) -> DataFrame:
    """The first MOST_TRACE reasons of each task; reasons has qid and position."""
    return first_rows(reasons, ["qid"], [F.col("position")], MOST_TRACE)


def shown_status(status: Column, evidence: Column) -> Column:
    """What is shown of a document's status: inferred ones and those of weak evidence never pass for verified."""
    return F.when((status == "verified") & evidence.isin("E3", "E4"), "inferred").otherwise(status)


def line_label(start: Column, end: Column) -> Column:
    """12, 12-20, or nothing."""
    one = start.cast("string")
    return F.when((start <= 0) & (end <= 0), "").when((end <= 0) | (end == start), one).otherwise(F.concat_ws("-", one, end.cast("string")))


# ---------------------------------------------------------------- events of a package


def evidence_kind(uri: Column, authority: Column) -> Column:
    """What a citation counts as."""
    u, a = F.trim(uri), F.trim(authority)
    recipe = (a == "curated_internal_recipe") | F.contains(u, F.lit("/_recipes/"))
    return F.when(recipe, "recipe").when((a == "generated_summary") | F.contains(u, F.lit("curated")), "curated").otherwise("citation")


def evidence_events(packages: DataFrame, citations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, evidence_type, evidence_key, root_key, rank, estimated_tokens) of packages' citations and symbols.

    packages has request_id and tokens; citations has request_id, position, uri, authority and root_name; symbols has
    request_id, position, name_norm and root_name. The tokens are shared out evenly, at least one a piece; a request
    records MOST_EVIDENCE pieces of a kind at most.
    """
    c = citations.select("request_id", evidence_kind(F.col("uri"), F.col("authority")).alias("evidence_type"), F.trim("uri").alias("evidence_key"), F.col("root_name").alias("root_key"), "position", F.lit(0).alias("side"))
    s = symbols.select("request_id", F.lit("symbol").alias("evidence_type"), F.concat(F.trim("name_norm"), F.lit("|"), F.trim("root_name")).alias("evidence_key"), F.col("root_name").alias("root_key"), "position", F.lit(1).alias("side"))
    rows = c.unionByName(s)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "side").orderBy("position")))
    pieces = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("pieces"))
    share = F.when(F.col("tokens") > 0, F.greatest(F.expr("tokens div pieces"), F.lit(1))).otherwise(F.lit(0)).cast("long")
    out = rows.join(pieces, "request_id").join(packages.select("request_id", "tokens"), "request_id")
    return out.where(F.col("rank") <= MOST_EVIDENCE).select("request_id", "evidence_type", "evidence_key", "root_key", "rank", share.alias("estimated_tokens"))


def token_shares(packages: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, structured_tokens, raw_document_tokens): what evidence took, scaled to the tokens that were returned.

    Without evidence all is structured where only symbols or recipes count, raw where none do, and half of each else.
    packages has request_id, tokens, curated_count, recipe_count, symbol_count and citation_count.
    """
    structured = F.sum(F.when(F.col("evidence_type").isin("recipe", "curated", "symbol"), F.col("estimated_tokens")).otherwise(0))
    e = evidence.groupBy("request_id").agg(structured.alias("s"), F.sum("estimated_tokens").alias("all"))
    p = packages.join(e, "request_id", "left").na.fill(0, ["s", "all"])
    known = F.col("curated_count") + F.col("recipe_count") + F.col("symbol_count")
    without = F.when((known > 0) & (F.col("citation_count") == 0), F.col("tokens")).when(known == 0, F.lit(0)).otherwise(F.expr("tokens div 2"))
    part = F.when(F.col("tokens") <= 0, F.col("s")).when(F.col("all") == 0, without).otherwise(F.expr("tokens * s div all"))
    raw = F.when(F.col("tokens") <= 0, F.col("all") - F.col("s")).otherwise(F.col("tokens") - part)
    return p.select("request_id", part.cast("long").alias("structured_tokens"), raw.cast("long").alias("raw_document_tokens"))


def outcome_event(rows: DataFrame, status: str, message_bytes: int = 240) -> DataFrame:
    """Events of requests without a package: rows (request_id, tool_name, message, roots) with status, error and root count.

    A message is cut to so many bytes, at a whole character; roots are counted once each, without blanks.
    """
    names = F.array_distinct(F.filter(F.transform(F.coalesce("roots", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != ""))
    text = F.coalesce("message", F.lit(""))
    whole = F.filter(F.sequence(F.lit(message_bytes), F.lit(0), F.lit(-1)), lambda n: F.octet_length(F.left(text, n)) <= message_bytes)
    return rows.select("request_id", "tool_name", F.lit(status).alias("result_status"), F.left(text, F.get(whole, F.lit(0))).alias("error_message"), F.size(names).alias("root_count"), F.lit(status == "root_selection_required").alias("root_selection_required"))
