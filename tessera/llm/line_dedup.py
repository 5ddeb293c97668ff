"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table in the shared folder, dealt into buckets by key hash and sorted in each, with each key's number of
documents. Batches, runs and merges all have the same buckets, so runs are joined and merged where they lie, by merging
sorted files, without exchange or sort. A batch's keys are merge-anti-joined with the keys that a run already holds as
frequent, and the rest becomes a run of its own on level 0. When a level has `fanout` runs they are merged into one run
a level up. A key's document count is its sum over the runs; once all batches are in, the keys at the threshold are
joined with the lines' hashes, and each document loses the positions that match. Texts are read twice and dealt out once;
hot lines are pre-aggregated before their hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, stored, stored_sorted, table

#: What a line's key is stripped of.
BLANK = " \t\n\r\x0b\x0c"
#: Frequent keys up to this many (16 bytes each) are broadcast; beyond it the join is dealt out by hash.
BROADCAST_KEYS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def hashed(df: DataFrame, key: str = "key") -> DataFrame:
    """Replaces the column key by its 128-bit hash in h1 and h2."""
    rest = [c for c in df.columns if c != key]
    return df.select(*rest, F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """The levels: each a list of runs (h1, h2, n), n the number of documents that hold the key."""

    def __init__(self, threshold: int, fanout: int = 3) -> None:
        self.threshold, self.fanout, self.levels = threshold, fanout, []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def write(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored_sorted(counts, f"lines-{level}", "h1", "h2"))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self.write(self.summed(merged), level + 1)
            for r in merged:
                drop_stored(r)

    @staticmethod
    def summed(runs: list[DataFrame]) -> DataFrame:
        """Runs merged, their counts added."""
        out = runs[0]
        for r in runs[1:]:
            both = out.join(r.select("h1", "h2", F.col("n").alias("m")).hint("merge"), ["h1", "h2"], "full_outer")
            out = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, keys: DataFrame) -> None:
        """A new batch: one row (h1, h2) for each document and distinct key."""
        fresh = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("n") >= self.threshold).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.write(fresh, 0)

    def frequent(self) -> DataFrame:
        """The keys (h1, h2) held by `threshold` documents or more."""
        return self.summed(self.runs()).where(F.col("n") >= self.threshold).select("h1", "h2")


def batches_of(docs: DataFrame, order: str, n: int) -> list[Column]:
    """Conditions that part docs into at most n batches by ranges of a column, nulls in the first."""
    cuts = docs.select(F.percentile_approx(order, [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    c = F.col(order)
    edges = [None, *cuts, None]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        cond = F.lit(True)
        if a is not None:
            cond = cond & (c > a)
        if b is not None:
            cond = cond & (c <= b)
        out.append(cond | c.isNull() if a is None else cond)
    return out


def dedup_lines(docs: DataFrame, threshold: int = 10, min_chars: int = 1, batches: int = 4, copies: bool = True, nulls: bool = False) -> DataFrame:
    """Drops, from every document, the lines whose key at least `threshold` documents hold.

    docs has doc_id and text; its columns come back with text replaced by the lines kept, joined by newlines, and
    n_lines (before) and n_dropped added (a column of such a name is replaced). Each row counts as a document, repeated
    rows too; with copies=False documents of equal texts count as one, so that copies alone make no line frequent, and
    batches are parted by a hash of the text rather than by doc_id. A null or empty text is one empty line, and comes
    back empty unless nulls keeps it null; keys shorter than min_chars are never dropped, so empty lines stay. A text
    that loses all its lines becomes empty. An empty table gives an empty one. Any other names may stand in docs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = LineRuns(threshold)
    narrow = docs.select("doc_id", "text")
    seal = F.xxhash64(F.lit(2), text)
    for cond in batches_of(docs, "doc_id", batches) if copies else [F.pmod(seal, F.lit(batches)) == k for k in range(batches)]:
        keys = narrow.where(cond).select(seal.alias("seal"), F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), key_of))).alias("key"))
        keys = hashed(keys.where(F.char_length("key") >= min_chars))
        runs.add(keys.select("h1", "h2") if copies else keys.distinct().select("h1", "h2"))
    frequent = stored(runs.frequent(), "frequent-lines")
    for r in runs.runs():
        drop_stored(r)
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    ids = [F.xxhash64("doc_id", text), F.xxhash64(F.lit(1), "doc_id", text)]
    places = docs.select(*(c.alias(k) for c, k in zip(ids, ("_a", "_b"), strict=True)), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    places = hashed(places.select("_a", "_b", "pos", key_of(F.col("line")).alias("key")))
    hit = places.join(frequent, ["h1", "h2"], "left_semi").groupBy("_a", "_b").agg(F.collect_set("pos").alias("_out"))
    kept_columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_doc"), lines_of(F.col("text")).alias("_lines"), F.col("text").isNull().alias("_null"), *(c.alias(k) for c, k in zip(ids, ("_a", "_b"), strict=True)))
    out = whole.join(hit, ["_a", "_b"], "left")
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_out"))
    kept = F.when(F.col("_out").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col("_lines"), i)), "\n"))
    kept = F.when(~F.col("_null"), kept) if nulls else kept
    done = {"text": kept, **{c: F.col(f"_doc.`{c}`") for c in kept_columns}}
    return out.select(
        *(done[c].alias(c) for c in docs.columns if c in done),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_out"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of lines, of lines dropped, and the digest of what is kept."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""
