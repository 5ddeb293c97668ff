"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is then indexed. Exact copies of a vector share one
entry, which keeps as many of their smallest ids as a result can show, so a common vector is no hot list. A list is
split into blocks of bounded size by a hash of its entries; a query goes to the blocks of its nearest lists. How many
lists that are follows from the true neighbours, among all entries, of a bounded sample of the queries. Each block
scores its entries for all its queries by asymmetric distance tables. How far a score may be off is known from the
length of what the codes leave over, so an entry is passed over only where enough others are nearer for certain; the rest
are reranked by the exact cosine of the original vectors. The last step keeps the best of all blocks for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Bounds: sampled vectors for fitting, lists, entries of a block.
SAMPLE, MOST_LISTS, BLOCK = 20_000, 4096, 8192
#: Sub-vectors of the residual, and codes of each.
SUBS, CODES = 16, 64
#: Sampled queries that the number of probes is tuned on, and the share of their true neighbours that it must reach.
TUNE, REACH = 512, 0.97
#: What rounding may add to the bound of a score.
SLACK = 1e-9


@dataclass
class Index:
    """Coarse centroids (of unit vectors) and the codebooks of the residuals' parts."""

    centroids: np.ndarray
    books: list[np.ndarray]

    @property
    def cuts(self) -> list[tuple[int, int]]:
        d, k = self.centroids.shape[1], len(self.books)
        return [(d * i // k, d * (i + 1) // k) for i in range(k)]

    def lists(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each unit vector, nearest first."""
        far = (self.centroids**2).sum(1)[None] - 2 * x @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, : min(n, len(self.centroids))]

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The residuals' codes."""
        r = x - self.centroids[at]
        return np.stack([((b**2).sum(1)[None] - 2 * r[:, i:j] @ b.T).argmin(1) for b, (i, j) in zip(self.books, self.cuts, strict=True)], 1).astype(np.uint8)

    def left_over(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """The length of what each unit vector of a list has beyond its codes: a unit query's score is off by no more."""
        r = x - self.centroids[at]
        return np.sqrt(sum(((r[:, i:j] - b[codes[:, s]]) ** 2).sum(1) for s, (b, (i, j)) in enumerate(zip(self.books, self.cuts, strict=True))))

    def tables(self, q: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Asymmetric tables: each query's product with a list's centroid, and with every code of every part."""
        return q @ self.centroids[at], np.stack([np.pad(q[:, i:j] @ b.T, ((0, 0), (0, CODES - len(b)))) for b, (i, j) in zip(self.books, self.cuts, strict=True)], 1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from a seeded choice of distinct rows; an empty cluster restarts at the worst-served row."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]].astype(float)
    for _ in range(rounds):
        d = (c**2).sum(1)[None] - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for e in np.flatnonzero(n == 0):
            c[e] = x[int(rng.integers(len(x)))]
    return c


def true_neighbours(entries: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(q, list, score): the k entries nearest to each of a few unit queries (with their ids), in each partition of entries."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        for b in batches:
            if b.num_rows:
                near = q @ unit(matrix(b.column("v"), q.shape[1])).T
                only = {x[0]: j for j, x in enumerate(b.column("ids").to_pylist()) if len(x) == 1}
                for i, name in enumerate(ids):
                    if name in only:
                        near[i, only[name]] = -np.inf
                every = np.concatenate([best, near], 1)
                lists = np.concatenate([held, np.broadcast_to(b.column("list").to_numpy(), near.shape)], 1)
                top = np.argpartition(-every, k - 1, axis=1)[:, :k]
                best, held = np.take_along_axis(every, top, 1), np.take_along_axis(lists, top, 1)
        at, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_pydict({"q": pa.array(at, pa.int32()), "list": pa.array(held[at, j], pa.int32()), "score": pa.array(best[at, j], pa.float64())})

    return entries.mapInArrow(nearest, "q int, list int, score double")


def tuned(index: Index, entries: DataFrame, asked: DataFrame, dim: int, k: int) -> int:
    """The least number of lists that reaches REACH of the k true neighbours, among all entries, of at most TUNE queries asked."""
    some = asked.select("_id", "v").orderBy(F.xxhash64("_id"), "_id", "v").limit(TUNE).toArrow()
    if not some.num_rows:
        return 1
    ids, q = some.column("_id").to_numpy(), unit(matrix(some.column("v").combine_chunks(), dim))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    true = true_neighbours(entries, ids, q, k).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "list").toArrow()  # TUNE * k rows at most
    if not true.num_rows:
        return 1
    rank = np.argsort(index.lists(q, len(index.centroids)), axis=1)[true.column("q").to_numpy(), true.column("list").to_numpy()]
    return int(np.quantile(rank, REACH, method="higher")) + 1


def fit(sample: np.ndarray, n: int) -> Index:
    """Fits lists and codebooks on a sample of unit vectors, for n vectors to be indexed."""
    lists = max(1, min(MOST_LISTS, len(sample) // 8, round(math.sqrt(n) / 2)))
    centroids = kmeans(sample, lists, 8, 1)
    whole = Index(centroids, [])
    r = sample - centroids[whole.lists(sample)[:, 0]]
    parts = min(SUBS, sample.shape[1])
    cuts = [(sample.shape[1] * i // parts, sample.shape[1] * (i + 1) // parts) for i in range(parts)]
    return Index(centroids, [kmeans(r[:, i:j], CODES, 8, 2 + i) for i, j in cuts])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column without nulls, in double precision."""
    return np.asarray(column.flatten()).astype(float).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has finite components only, not all zero, and the most frequent dimension (ties: the smaller)."""
    v = F.col(vec).cast("array<double>")
    fine = F.col(vec).isNotNull() & F.col("_id").isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    good = df.where(F.coalesce(fine, F.lit(False)))
    dims = good.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return good.where(F.size(vec) == dims[0].d) if dims else good.limit(0)


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec: str = "embedding", probes: int | None = None) -> DataFrame:
    """Each query's k nearest rows by cosine: query_id, rank (from 1), vec_id, score (the exact cosine in double precision).

    rows and queries have id_col and vec; other columns are ignored. A query never finds a row of its own id. Vectors
    that are null, zero, of another dimension than most, or with null or non-finite components take no part, nor do null
    ids. Ties go to the smaller id; repeated rows count once. With fewer than k candidates all are given. probes is tuned on
    queries where it is not given. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("v"))
    base = valid(base, "v")
    w = Window.partitionBy("v").orderBy("_id")
    few = base.distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("_id")).alias("ids")), "vectors")
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    span = 1 << 24
    chosen = entries.where(F.pmod(F.xxhash64("v"), F.lit(span)) < math.ceil(min(1.0, SAMPLE / n) * span)).select("v").limit(2 * SAMPLE)
    got = chosen.toArrow().column("v").combine_chunks()
    if not len(got):
        got = entries.select("v").limit(SAMPLE).toArrow().column("v").combine_chunks()
    dim = len(got[0])
    index = fit(unit(matrix(got, dim)), n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column("v"), dim))
                at = index.lists(x)[:, 0]
                yield pa.RecordBatch.from_pydict({"list": pa.array(at, pa.int32()), "codes": pa.array([c.tobytes() for c in index.encode(x, at)], pa.binary()), "v": b.column("v"), "ids": b.column("ids")})

    kind = entries.schema["v"].dataType.simpleString()
    built = stored(entries.mapInArrow(placed, f"list int, codes binary, v {kind}, ids array<bigint>"), "index")
    sizes = {r["list"]: max(1, math.ceil(r.n / BLOCK)) for r in built.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_LISTS rows at most
    split = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])

    asked = valid(queries.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("v")), "v").distinct().where(F.size("v") == dim)
    probes = probes or tuned(index, built, asked, dim, k)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = index.lists(unit(matrix(b.column("v"), dim)), probes)
                to = [[(int(a), p) for a in r for p in range(split[a])] for r in near]
                row = np.repeat(np.arange(len(to)), [len(t) for t in to])
                yield pa.RecordBatch.from_pydict({"list": pa.array([a for t in to for a, _ in t], pa.int32()), "block": pa.array([p for t in to for _, p in t], pa.int32()), "q": b.column("_id").take(pa.array(row)), "v": b.column("v").take(pa.array(row))})

    asked = asked.mapInArrow(probed, f"list int, block int, q long, v {kind}")
    blocks = F.coalesce(*[F.when(F.col("list") == a, F.lit(b)) for a, b in sizes.items() if b > 1], F.lit(1))
    held = built.withColumn("block", F.pmod(F.xxhash64("v", F.lit(5)), blocks).cast("int"))

    def ranked(key, left, right):
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        own = np.stack(left.v.to_numpy()).astype(float)
        length = np.linalg.norm(own, axis=1)
        codes = np.frombuffer(b"".join(left.codes), np.uint8).reshape(len(left), -1)
        first = np.array([x[0] for x in left.ids])
        order = np.argsort(first, kind="stable")  # equal distances in order of id
        own, length, codes, ids = own[order], length[order], codes[order], left.ids.to_numpy()[order]
        off = index.left_over(own / length[:, None], int(key[0]), codes) + SLACK
        most = min(k + 1, len(own))  # one may be the query itself
        out = []
        for a in range(0, len(right), 256):
            q = np.stack(right.v.iloc[a : a + 256].to_numpy()).astype(float)
            names = right.q.iloc[a : a + 256].to_numpy()
            size = np.linalg.norm(q, axis=1)
            head, tab = index.tables(q / size[:, None], int(key[0]))
            near = np.repeat(head[:, None], len(own), 1)
            for s in range(codes.shape[1]):
                near += tab[:, s, :][:, codes[:, s]]
            keep = near + off >= np.partition(near - off, -most, axis=1)[:, -most, None]  # the others are farther than as many for certain
            for i, name in enumerate(names):
                at = np.flatnonzero(keep[i])
                exact = own[at] @ q[i] / (length[at] * size[i])
                top = np.flatnonzero(exact >= np.partition(exact, -most)[-most])
                top = top[np.argsort(-exact[top], kind="stable")[:most]]
                found = [(-e, int(x)) for e, j in zip(exact[top], at[top], strict=True) for x in ids[j] if x != name]
                out += [(name, x, -e) for e, x in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    found = held.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInPandas(ranked, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
