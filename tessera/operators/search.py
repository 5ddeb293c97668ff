"""Retrieval over a batch of queries: sparse-semantic candidates, path and title candidates, merged ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import authority_boost, authority_rank, composite_score, version_preference
from ..functions.text import clip_excerpt, fold_ascii, idf, marked_excerpt
from ..sources.shared import fresh
from .index import HEAD, Index, allowed, asked_words, bm25, gram_of, looked_up, of, scoped, set_down, term_vectors

#: Fixed values of the candidate rules.
LEAST_POOL, MOST_POOL, POOL_PER_RESULT = 250, 1500, 25
MOST_LOOKUP, FALLBACK_LOOKUP, MOST_DF_SHARE, LEAST_SIMILARITY = 16, 3, 0.15, 0.12
DEFAULT_LIMIT, MOST_RESULTS, PER_DOCUMENT, CANDIDATES_PER_RESULT = 20, 100, 3, 4
MOST_QUERY_RUNES, MOST_QUERY_TOKENS = 512, 64
SNIPPET_WORDS = 32


def pool_size(limit: int) -> int:
    """Candidates that the semantic stage takes for so many results."""
    return min(MOST_POOL, max(LEAST_POOL, (limit if limit >= 1 else DEFAULT_LIMIT) * POOL_PER_RESULT))


def clamp_limit(requested: int, configured: int = 0) -> int:
    """The number of results: the configured (or default) one if none is asked for, and never above the maxima."""
    n = requested if requested > 0 else (configured if configured > 0 else DEFAULT_LIMIT)
    n = min(n, MOST_RESULTS)
    return min(n, configured) if configured > 0 else n


def check_query(query: str) -> str:
    """The trimmed query; ValueError if it is empty or too long."""
    q = query.strip()
    if not q:
        raise ValueError("query is required")
    if len(q) > MOST_QUERY_RUNES:
        raise ValueError(f"query exceeds {MOST_QUERY_RUNES} characters")
    if len([t for t in q.split() if t.upper() not in ("AND", "OR", "NOT", "NEAR")]) > MOST_QUERY_TOKENS:
        raise ValueError(f"query exceeds {MOST_QUERY_TOKENS} searchable tokens")
    return q


def scope_sizes(queries: DataFrame, ix: Index) -> DataFrame:
    """(qid, n): how many chunks the roots of each query have; of a query without roots, all."""
    q = scoped(queries).select("qid", "roots")
    some = q.where(F.size("roots") > 0).select("qid", F.explode(F.array_distinct("roots")).alias("root_name")).join(ix.roots, "root_name").groupBy("qid").agg(F.sum("n").alias("n"))
    everything = ix.roots.agg(F.sum("n").alias("total"))  # one row
    return q.select("qid", "roots").join(some, "qid", "left").join(F.broadcast(everything)).select("qid", F.coalesce(F.when(F.size("roots") > 0, F.coalesce("n", F.lit(0))).otherwise(F.col("total")), F.lit(0)).alias("n"))


def lookup_terms(queries: DataFrame, chunks: DataFrame | Index) -> DataFrame:
    """(qid, term, w, picked): each query's terms with their weights; picked ones look up postings.

    Weights are of the query's roots, if it has any. Terms in too many chunks are passed over; if all of a query's
    are, its rarest few are picked.
    """
    ix = of(chunks)
    q = set_down(term_vectors(scoped(queries), ["qid", "roots"], "query").select("qid", "roots", "term"), "terms")
    df = ix.frequency.join(q, "term").where(allowed()).groupBy("qid", "term").agg(F.sum("df").alias("df"))
    weighed = q.select("qid", "term").join(df, ["qid", "term"], "left").join(scope_sizes(queries, ix), "qid").select("qid", "term", F.coalesce("df", F.lit(0)).alias("df"), "n")
    weighed = weighed.withColumn("w", idf(F.col("n"), F.col("df"))).withColumn("rare", F.col("df") <= F.col("n") * MOST_DF_SHARE)
    order = [F.desc("w"), F.col("term")]
    weighed = weighed.withColumn("r", F.row_number().over(Window.partitionBy("qid", "rare").orderBy(*order)))
    weighed = weighed.withColumn("any_rare", F.max("rare").over(Window.partitionBy("qid")))
    picked = F.when(F.col("any_rare"), F.col("rare") & (F.col("r") <= MOST_LOOKUP)).otherwise(F.col("r") <= FALLBACK_LOOKUP)
    return weighed.select("qid", "term", "w", picked.alias("picked"))


def semantic_candidates(chunks: DataFrame | Index, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(qid, rank, chunk_id, similarity, score): the chunks nearest to each query by its weighted terms.

    The query's side is weighted by rarity and the chunk's side by presence. Postings of the picked terms give the
    pool; only its chunks' term vectors are read. Roots (if queries has them) limit the chunks and the weights.
    """
    ix = of(chunks)
    q = set_down(lookup_terms(queries, ix), "lookup")
    weights = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"), F.collect_list(F.struct("term", "w")).alias("q_terms"))  # MOST_TERMS at most
    picked = set_down(q.where("picked").select("qid", "term").join(scoped(queries).select("qid", "roots"), "qid"), "picked")
    matches = looked_up(ix.postings, picked, "term").where(allowed()).groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("qid").orderBy(F.desc("m"), "chunk_id")
    pool = matches.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool_size(limit)).select("qid", "chunk_id")
    pool = set_down(pool, "pool")
    read = pool.join(ix.vectors.select("chunk_id", "authority", F.col("v.term").alias("terms")), "chunk_id").join(weights, "qid")
    dot = F.aggregate(F.filter("q_terms", lambda x: F.array_contains(F.col("terms"), x["term"])), F.lit(0.0), lambda a, x: a + x["w"])
    sim = read.select("qid", "chunk_id", "authority", (dot / (F.col("q_norm") * F.sqrt(F.size("terms")))).alias("similarity")).where(F.col("similarity") >= LEAST_SIMILARITY)
    sim = sim.withColumn("score", F.round(2 * F.col("similarity") + authority_boost(F.col("authority")), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    top = sim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.select("qid", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def path_candidates(chunks: DataFrame | Index, queries: DataFrame, limit: int) -> DataFrame:
    """(qid, chunk_id): first chunks whose path, title or uri holds the query, compared as LIKE does; by id.

    Chunks are found by the rarest run of three characters in the query, and then looked at. A query longer than all of
    these holds nowhere, and isn't looked for.
    """
    ix = of(chunks)
    longest = ix.chunks.where("ordinal = 0").agg(F.max(F.greatest(*[F.char_length(c) for c in ("path", "title", "uri")]))).first()[0] or 0
    q = set_down(scoped(queries).select("qid", "roots", fold_ascii(F.trim("query")).alias("q")).where((F.col("q") != "") & (F.char_length("q") <= longest)), "places")
    if not q.limit(1).count():
        return q.select("qid", F.lit(None).cast(dict(ix.chunks.dtypes)["chunk_id"]).alias("chunk_id"))
    grams = q.select("qid", F.explode(gram_of(F.col("q"))).alias("gram")).join(ix.place_frequency, "gram", "left")
    rare = grams.groupBy("qid").agg(F.min_by(F.struct("gram", "df"), F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("g")).where("g.df is not null")
    found = looked_up(ix.places, q.join(rare.select("qid", F.col("g.gram").alias("gram")), "qid"), "gram")
    first = ix.chunks.where("ordinal = 0").select("chunk_id", "root_name", "path", "title", "uri")
    holds = F.lit(False)
    for c in ("path", "title", "uri"):
        holds = holds | F.contains(fold_ascii(F.col(c)), F.col("q"))
    found = found.join(first, "chunk_id").where(holds & allowed())
    w = Window.partitionBy("qid").orderBy("chunk_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select("qid", "chunk_id")


def lexical_candidates(chunks: DataFrame | Index, queries: DataFrame, limit: int) -> DataFrame:
    """(qid, chunk_id, rank, mode): chunks with all of a query's content words, phrases side by side; if none has, with some."""
    ix, spark = of(chunks), queries.sparkSession
    w = Window.partitionBy("qid").orderBy(F.round("rank", 9), "chunk_id")

    def first(asked: DataFrame, all_words: bool) -> DataFrame:
        hits = bm25(ix, asked, all_words=all_words, content=True, most=limit).withColumn("mode", F.lit("and" if all_words else "or"))
        return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).drop("pos")

    at = fresh(spark, "candidates")  # at most limit rows a query, read twice: the other search is for the rest alone
    first(queries, True).write.parquet(at)
    every = spark.read.parquet(at)
    rest = queries.join(every.select("qid").distinct(), "qid", "left_anti")
    return every.unionByName(first(rest, False)) if rest.limit(1).count() else every


def search(chunks: DataFrame | Index, queries: DataFrame, limit: int = DEFAULT_LIMIT, per_document: int = PER_DOCUMENT, preferred_version: str = "", semantic: bool = False) -> DataFrame:
    """(qid, rank, chunk_id, document_id, score, match_kind): lexical, path and semantic candidates in one ranking.

    queries has qid, query and perhaps roots (an array; null or empty: all roots). Lexical candidates hold all of a
    query's content words; for a query without any, those that hold some of them. Candidates found twice keep their
    first origin. The order is authority, score, lexical rank, origin and id; a document gives at most per_document
    chunks (negative: any number).
    """
    ix = of(chunks)
    most = limit * CANDIDATES_PER_RESULT if per_document > 0 else limit
    zero = F.lit(0.0).alias("rank")
    found = lexical_candidates(ix, queries, most).select("qid", "chunk_id", "rank", F.lit(0).alias("origin"))
    found = found.unionByName(path_candidates(ix, queries, most).select("qid", "chunk_id", zero, F.lit(1).alias("origin")))
    if semantic:
        found = found.unionByName(semantic_candidates(ix, queries, limit).select("qid", "chunk_id", zero, F.lit(2).alias("origin")))
    once = set_down(found.groupBy("qid", "chunk_id").agg(F.min(F.struct("origin", "rank")).alias("f")).select("qid", "chunk_id", "f.origin", "f.rank"), "found")
    hits = once.join(ix.heads, "chunk_id").join(queries.select("qid", "query"), "qid")  # without bodies
    score, kind = composite_score(F.col("query"), F.col("rank"), *map(F.col, ("authority", "path", "title", "heading")), clip_excerpt(F.col("head"), HEAD), F.col("archived"), F.col("deprecated"))
    hits = hits.withColumn("match_kind", kind).withColumn("score", score)
    from_path = (F.col("origin") == 1) & (F.col("match_kind") == "body")
    hits = hits.withColumn("score", F.col("score") + F.when(from_path, 8.0).otherwise(0.0)).withColumn("match_kind", F.when(from_path, "path").otherwise(F.col("match_kind")))
    hits = hits.withColumn("score", F.round(F.col("score") + version_preference(F.col("product_version"), F.lit(preferred_version)), 9))
    order = [authority_rank(F.col("authority")), F.desc("score"), F.round("rank", 9), F.col("origin"), F.col("chunk_id")]
    return diversify(hits, order, limit, per_document).select("qid", F.col("_rank").alias("rank"), "chunk_id", "document_id", F.round("score", 6).alias("score"), "match_kind")


def snippets(chunks: DataFrame | Index, hits: DataFrame, queries: DataFrame, n: int = SNIPPET_WORDS) -> DataFrame:
    """hits (qid, chunk_id ...) with snippet: the n words of the body around the first content word found, which are marked."""
    ws = asked_words(queries, content=True).select("qid", "ws")
    bodies = of(chunks).chunks.select("chunk_id", F.col("body").alias("_body"))
    return set_down(hits, "hits").join(ws, "qid").join(bodies, "chunk_id").withColumn("snippet", marked_excerpt(F.col("_body"), F.col("ws"), n)).drop("_body", "ws")


def diversify(hits: DataFrame, order: list, limit: int, per_document: int) -> DataFrame:
    """The first `limit` hits of each query in the order, at most per_document of one document; _rank from 1."""
    if per_document >= 0:
        hits = hits.withColumn("_d", F.row_number().over(Window.partitionBy("qid", "document_id").orderBy(*order))).where(F.col("_d") <= per_document).drop("_d")
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("_rank") <= limit)


def or_fallback(all_words: DataFrame, any_word: DataFrame) -> DataFrame:
    """Each query's hits on all words; for queries without any, the hits on some word. Both have qid."""
    return all_words.unionByName(any_word.join(all_words.select("qid").distinct(), "qid", "left_anti"))
