"""How far the sources of a language lie from each other, and which terms set them apart.

Terms with the same counts in every source contribute the same to every comparison. So terms are grouped by their
sparse vector of counts by source, every pair of sources is evaluated once for each distinct vector, and the result is
multiplied by the number of its terms. Pairs of which neither source holds a vector need no evaluation: they differ by
their two smoothed zeros. Terms are ranked by ranking vectors first and looking up the terms of those at the top.

Texts are counted in Arrow batches, of which each gives its own sums; after that, rows are vectors. They are dealt out
by language and salt and meet the language's sources there, so that no task takes a whole language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, drop_stored, give_back, raw, stored, strings, table

#: Probabilities are counted in parts of SCALE = 1000 ** 3, after adding SMOOTHING to each count.
SCALE, SMOOTHING = 1_000_000_000, 5
#: Which bytes terms are made of: ASCII letters and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Bytes of text that are counted at a time; numbers that one block of vectors by sources takes, and vectors that one
#: task takes on average.
BLOCK_TEXT, BLOCK, TASK_VECTORS = 1 << 23, 1 << 20, 1 << 13


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every term of the rows' texts, in order, A-Z lower-cased."""
    solid = LETTERS[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = solid[starts]
    at = np.flatnonzero(first)
    kept = LOWER[data[solid]]
    places = np.append((np.cumsum(solid) - 1)[at], len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return np.searchsorted(offsets, at, side="right") - 1, found


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (lang, source, term, n, d): a block's occurrences of a term, and its rows with it."""
    for batch in batches:
        data, offsets = raw(strings(batch, "text"))
        for i, j in blocks(offsets, BLOCK_TEXT):
            row, found = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(row):
                continue
            names = [strings(batch, c).slice(i, j - i).dictionary_encode() for c in ("lang", "source")]
            width = len(names[1].dictionary)
            groups, group = np.unique(names[0].indices.to_numpy().astype(np.int64) * width + names[1].indices.to_numpy(), return_inverse=True)
            found = found.dictionary_encode()
            k = len(found.dictionary)
            pair, n = np.unique(row * k + found.indices.to_numpy(), return_counts=True)
            del row
            key, back = np.unique(group[pair // k] * k + pair % k, return_inverse=True)
            code = groups[key // k]
            out = {
                "lang": names[0].dictionary.take(pa.array(code // width)),
                "source": names[1].dictionary.take(pa.array(code % width)),
                "term": found.dictionary.take(pa.array(key % k)).cast(pa.string()),
                "n": pa.array(np.bincount(back, n, len(key)).astype(np.int64)),  # sums of a block: exact as doubles
                "d": pa.array(np.bincount(back, minlength=len(key))),
            }
            yield pa.RecordBatch.from_pydict(out)
            del out, found, pair, back
        give_back()


def counted(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, v): the kept terms, each with its sorted vector of (source, n)."""
    counts = docs.mapInArrow(summed, "lang string, source string, term string, n long, d long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    whole = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("v"))
    return whole.where(F.col("d") >= least_docs).select("lang", "term", "v")


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), by long division: exact in 64 bits."""
    below = total + SMOOTHING * kept
    out, rest = np.divmod(count + SMOOTHING, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


FACED = "lang string, x string, y string, far long, met long, id long, value long"


def faced(top: int):
    """A function of one language's vectors (id, times, v) under one salt, and its sources (source, total, kept).

    Gives, for each two sources of which one holds a vector, (x, y, the sum of their differences, the number of terms),
    and for each source (x, vector id, value) of the vectors that may be among its first.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.array(right["source"].to_pylist(), object))
        sources = right["source"].combine_chunks().take(pa.array(order))
        total, kept = right["total"].to_numpy()[order], int(right["kept"][0].as_py()) if len(right) else 0
        size, whole = len(sources), total.sum()
        made = []

        def add(x, y, far, met, ids, value):
            n = len(x)
            none = pa.nulls(n, pa.int64())
            names = [sources.take(pa.array(x)), sources.take(pa.array(y)) if y is not None else pa.nulls(n, pa.string())]
            made.append(pa.table([pa.array([key[0].as_py()] * n, pa.string()), *(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in names), *(pa.array(c, pa.int64()) if c is not None else none for c in (far, met, ids, value))], names=[f.split()[0] for f in FACED.split(", ")]))

        sums, mets = np.zeros((2, size, size), np.int64) if size * size <= BLOCK else (None, None)
        step = max(1, BLOCK // max(size, 1))
        for i in range(0, len(left) if size else 0, step):
            part = left.slice(i, step).combine_chunks()
            v = part["v"].combine_chunks()
            row = pc.list_parent_indices(v).to_numpy()
            flat = v.flatten()
            col = pc.index_in(flat.field("source"), sources).to_numpy(zero_copy_only=False)
            n = np.zeros((len(part), size), np.int64)
            n[row, col] = flat.field("n").to_numpy()
            times, ids = part["times"].to_numpy(), part["id"].to_numpy()
            p = share(n, total[None, :], kept)
            above = p - share(n.sum(1), whole, kept)[:, None]
            for a in range(size):
                held = np.flatnonzero(n[:, a])
                if not len(held):
                    continue
                mine = p[held]
                weight = np.where((n[held] > 0) & (np.arange(size) < a), 0, times[held][:, None])  # both hold it: counted once
                weight[:, a] = 0
                far, met = (weight * np.abs(mine - mine[:, a : a + 1])).sum(0), weight.sum(0)
                if sums is not None:
                    sums[a] += far
                    mets[a] += met
                else:
                    b = np.flatnonzero(met)
                    add(np.minimum(a, b), np.maximum(a, b), far[b], met[b], None, None)
                gain = above[held, a]
                best = np.flatnonzero(gain > 0)
                if len(best) > top:
                    best = best[gain[best] >= np.partition(gain[best], len(best) - top)[len(best) - top]]
                add(np.full(len(best), a), None, None, None, ids[held[best]], gain[best])
        if sums is not None:
            a, b = np.nonzero(mets)
            add(np.minimum(a, b), np.maximum(a, b), sums[a, b], mets[a, b], None, None)
        add(np.zeros(0, np.int64), None, None, None, None, None)  # a table, though nothing was found
        return pa.concat_tables(made)

    return run


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) that occurs, with or without terms.

    docs has text, lang and source; null counts as empty in each, and each row as a document. part `pair`: item is
    each other source of the language, value the sum over the language's kept terms (in at least least_docs of its
    documents) of the two groups' absolute difference in probability, in parts of SCALE; 0 where no term is kept. part
    `term`: item is each kept term that the group holds more often than the language does, value by how much, the top
    ones only. Ranks go by value, then by item in UTF-8. A language of one source has no pairs; an empty table gives no
    rows. Other columns of docs, of any names, are ignored.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = stored(counted(docs, least_docs), "kept-terms")
    vectors = stored(kept.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("id", F.monotonically_increasing_id()), "count-vectors")
    sizes = vectors.groupBy("lang").agg(F.sum("times").alias("kept"))
    held = vectors.select("lang", "times", F.explode("v").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("times") * F.col("e.n")).alias("total"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "source-groups")

    salts = max(1, -(-vectors.count() // TASK_VECTORS))
    dealt = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).groupBy("lang", "salt")
    met = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("lang", "salt")
    found = stored(dealt.cogroup(met).applyInArrow(faced(top), FACED), "faced-sources")

    below = F.col("total") + SMOOTHING * F.col("kept")
    none = F.when(F.col("kept") > 0, F.lit(1).cast("long") + F.floor(F.lit(SCALE * SMOOTHING).cast("long") / below)).otherwise(0)
    two = [groups.select("lang", F.col("source").alias(k), none.alias(f"none_{k}"), *(["kept"] if k == "x" else [])) for k in ("x", "y")]
    pairs = found.where("y is not null").groupBy("lang", "x", "y").agg(F.sum("far").alias("far"), F.sum("met").alias("met"))
    pairs = two[0].join(two[1], "lang").where("x < y").join(pairs, ["lang", "x", "y"], "left")
    rest = (F.col("kept") - F.coalesce("met", F.lit(0))) * F.abs(F.col("none_x") - F.col("none_y"))
    pairs = pairs.select("lang", "x", "y", (F.coalesce("far", F.lit(0)) + rest).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("s"), "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(best))

    first = found.where("id is not null").select("lang", F.col("x").alias("source"), "id", "value")
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("place") <= top)
    named = kept.join(vectors.select("lang", "v", "id"), ["lang", "v"]).select("lang", "id", F.col("term").alias("item"))
    ranked = first.drop("place").join(named, ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = stored(pairs.unionByName(ranked).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int")), "divergence")
    for made in (kept, vectors, groups, found):
        drop_stored(made)
    return out


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and the terms that set it apart."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total, count(*) AS kept FROM x GROUP BY lang, source),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * kept) AS p FROM x JOIN s USING (lang, source)),
y AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term),
l AS (SELECT lang, sum(n) AS total, count(*) AS kept FROM y GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * kept) AS q FROM y JOIN l USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far AS f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
