"""The corpus as snapshots: upserts, deletions, trust, generations of a crawl, inventories and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A page is pruned once it was missing from so many generations; a title key and a path shorter than these match nothing.
MOST_MISSING, LEAST_TITLE_KEY, LEAST_SUFFIX = 2, 8, 12


def upsert(old: DataFrame, new: DataFrame, key: str = "uri", digest: str = "hash") -> DataFrame:
    """The merged snapshot: new rows replace old ones of their key unless the digest is the same; `written` says which did.

    Of new rows with one key the last (largest digest) counts.
    """
    w = Window.partitionBy(key).orderBy(F.desc(digest))
    last = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    same = last.join(old.select(key, digest), [key, digest], "left_semi").select(key)
    fresh = last.join(same, key, "left_anti").withColumn("written", F.lit(True))
    return old.join(fresh.select(key), key, "left_anti").withColumn("written", F.lit(False)).unionByName(fresh)


def without_prefix(df: DataFrame, prefix: str, column: str = "uri") -> DataFrame:
    """Rows whose column doesn't start with the prefix, taken literally."""
    return df.where(~F.startswith(F.col(column), F.lit(prefix)))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without any child."""
    return parents.join(children.select(key), key, "left_anti")


def trust_update(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """docs with authority and deprecated replaced where updates (uri, authority, deprecated) have a value."""
    u = updates.select("uri", F.nullif(F.col("authority"), F.lit("")).alias("_a"), F.col("deprecated").alias("_d"))
    out = docs.join(u, "uri", "left")
    return out.withColumns({"authority": F.coalesce("_a", "authority"), "deprecated": F.coalesce("_d", "deprecated")}).select(docs.columns)


def change_status(old: DataFrame, new: DataFrame, key: str = "url", digest: str = "hash") -> DataFrame:
    """(key, status): new, changed, unchanged or missing, from two crawls."""
    both = old.select(key, F.col(digest).alias("_o")).join(new.select(key, F.col(digest).alias("_n")), key, "full_outer")
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "missing").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


def next_generation(pages: DataFrame) -> DataFrame:
    """One row: the next generation's number, 1 for the first."""
    return pages.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def advance(state: DataFrame, seen: DataFrame, generation: int, key: str = "url") -> DataFrame:
    """The state (key, generation, missing) after a crawl: seen pages are current, others miss once more or are pruned."""
    s = state.join(seen.select(key, F.lit(True).alias("_seen")).distinct(), key, "full_outer")
    there = F.coalesce("_seen", F.lit(False))
    out = s.select(key, F.when(there, generation).otherwise(F.col("generation")).alias("generation"), F.when(there, 0).otherwise(F.coalesce("missing", F.lit(0)) + 1).alias("missing"))
    return out.where(F.col("missing") < MOST_MISSING)


def diff_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(path, change) of name-status lines: A and M and T, D, and a rename as a deletion and an addition."""
    p = F.split(column, "\t")
    kind = F.left(p[0], F.lit(1))
    one = lambda path, change: F.struct(path.alias("path"), F.lit(change).alias("change"))
    rows = (
        F.when(kind == "A", F.array(one(p[1], "added")))
        .when(kind.isin("M", "T"), F.array(one(p[1], "modified")))
        .when(kind == "D", F.array(one(p[1], "deleted")))
        .when(kind == "R", F.array(one(p[1], "deleted"), one(F.get(p, F.lit(2)), "added")))
    )
    return lines.select(F.explode(rows).alias("r")).select("r.*")


def root_counts(docs: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(root_name, documents, chunks, symbols)."""
    parts = [t.groupBy("root_name").agg(F.count(F.lit(1)).alias(n)) for t, n in ((docs, "documents"), (chunks, "chunks"), (symbols, "symbols"))]
    out = parts[0].join(parts[1], "root_name", "full_outer").join(parts[2], "root_name", "full_outer")
    return out.na.fill(0)


def index_stats(vectors: DataFrame) -> DataFrame:
    """One row: vectors, postings, distinct terms and terms per vector."""
    sizes = vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("c"))
    a = sizes.agg(F.count(F.lit(1)).alias("vectors"), F.coalesce(F.sum("c"), F.lit(0)).alias("postings"))
    b = vectors.select("term").distinct().agg(F.count(F.lit(1)).alias("terms"))
    return a.crossJoin(b).withColumn("avg_terms", F.round(F.try_divide(F.col("postings"), F.col("vectors")), 6))  # one row each


def near_duplicates(items: DataFrame) -> DataFrame:
    """(id, links, base_class, title_class): with how many items of other roots an item shares its base name or a long title key.

    items has id, root, path, title_key, all folded to lower case; ids are unique, and items without a root share
    nothing. A path that is the end of another one has its base name, so both rules on paths are this one. Items of one
    base name (or title key) are a class, named by its smallest id. Links are counted from the sizes of classes: no pair
    is made.
    """
    base = F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)
    key = F.when(F.octet_length("title_key") >= LEAST_TITLE_KEY, F.col("title_key"))
    x = items.select("id", "root", F.when(base != "", base).alias("base"), key.alias("title"), (F.coalesce("root", F.lit("")) != "").alias("rooted"))
    out = x
    for name, by in (("b", ["base"]), ("t", ["title"]), ("bt", ["base", "title"])):
        cells = x.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by, "root").agg(F.count(F.when(F.col("rooted"), 1)).alias("_c"), F.min("id").alias("_m"))
        whole = cells.groupBy(*by).agg(F.sum("_c").alias("_all"), F.min("_m").alias(f"{name}_class"))
        others = cells.join(whole, by).select(*by, "root", (F.col("_all") - F.col("_c")).alias(f"{name}_n"), f"{name}_class")
        out = out.join(others, [*by, "root"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    links = F.when(F.col("rooted"), n("b_n") + n("t_n") - n("bt_n")).otherwise(F.lit(0))
    return out.select("id", links.cast("long").alias("links"), F.col("b_class").alias("base_class"), F.col("t_class").alias("title_class"))


def folder_join(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, folder, id): each file with the folders that are it or hold it, over its ancestors: an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    a = files.select("path", F.explode(above).alias("folder"))
    return a.join(folders.select(F.regexp_replace("folder", "/+$", "").alias("folder"), "id").where("folder <> ''"), "folder").select("path", "folder", "id")


def crosscheck(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids that only one side has."""
    both = left.select(key, F.lit(1).alias("_l")).distinct().join(right.select(key, F.lit(1).alias("_r")).distinct(), key, "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(key, F.when(F.col("_l").isNull(), "only right").otherwise("only left").alias("problem"))


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def reserved(citations: DataFrame, bucket: Column, order: list[Column], limit: int) -> DataFrame:
    """(…, position): citations with the best of each bucket first, then the rest, in the order; at most limit a group.

    citations has the group column qid.
    """
    c = citations.withColumn("_bucket", bucket)
    c = c.withColumn("_b", F.row_number().over(Window.partitionBy("qid", "_bucket").orderBy(*order)))
    w = Window.partitionBy("qid").orderBy(F.when(F.col("_b") == 1, 0).otherwise(1), *order)
    return c.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("_bucket", "_b")


#: Bins that values are dealt into before one of them is sorted.
BINS = 64


def percentiles(df: DataFrame, value: str, ps: dict[str, float], *by: str) -> DataFrame:
    """(by, a column for each of ps): the values at the ranks floor((n - 1) p), without interpolation.

    Values are dealt into bins at approximate quantiles; the bins that hold the ranks are found from their counts, and
    only these are sorted, each by itself. Nulls don't count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    cuts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], 100 * BINS).alias("_cuts"))
    joined = rows.join(cuts, list(by)) if by else rows.crossJoin(F.broadcast(cuts))  # one row
    dealt = joined.select(*by, "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_bin"))
    w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = dealt.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col("_n") - 1) * p).alias("r")) for k, p in ps.items()])
    asked = cuts.select(*by, F.explode(ranks).alias("x")).select(*by, "x.k", "x.r")
    held = (bins.join(asked, list(by)) if by else bins.crossJoin(F.broadcast(asked))).where((F.col("_before") <= F.col("r")) & (F.col("r") < F.col("_before") + F.col("_c")))
    sorted_rows = dealt.join(held.select(*by, "_bin", "_before").distinct(), [*by, "_bin"]).withColumn("r", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_v")) - 1)
    found = sorted_rows.join(held.select(*by, "_bin", "k", "r"), [*by, "_bin", "r"])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("_v"))).alias(k) for k in ps])


def percentile_floor(df: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """(by, p): the value at the rank floor((n - 1) p)."""
    return percentiles(df, value, {"p": p}, *by)


def edge_lines(pages: DataFrame, most_chars: int = 120) -> DataFrame:
    """(file, line, n): first or last lines that at least half a file's pages (two at least) share: headers and footers.

    pages has file, page and text.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = pages.select("file", F.get(lines, F.lit(0)).alias("first"), F.element_at(F.when(F.size(lines) > 0, lines), -1).alias("last"))
    total = pages.groupBy("file").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2")
    edge = p.select("file", F.explode(F.array_distinct(F.filter(F.array("first", "last"), lambda x: x.isNotNull()))).alias("line"))
    counts = edge.groupBy("file", "line").agg(F.count(F.lit(1)).alias("n")).join(total, "file")
    return counts.where((F.col("n") >= F.greatest(F.lit(2), F.expr("(pages + 1) div 2"))) & (F.char_length("line") <= most_chars)).select("file", "line", "n")
