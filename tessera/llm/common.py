"""Helpers shared by the training-data operators: tables, scratch space, Arrow text access, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at a time; one longer text is taken alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch space


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or one of our own where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-scratch/{tag}-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append(path)
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path; a session that has ended already is no error."""
    if spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: The scratch paths made within each passing() that is open.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Deletes, at its end, the scratch paths that were made within it."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            remove_path(spark, path)


#: Spark deletes an execution's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, what an execution shuffles is deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


#: Narrow rows that one file takes.
FILE_ROWS = 500_000


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors.

    rows, a bound on the number of (narrow) rows where one is known, keeps a small table from being many files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // FILE_ROWS))
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Lets a scan of a bucketed table, of which each bucket is one sorted file, count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def stored_sorted(df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """As stored(), dealt into buckets by the keys (as many as the session's shuffle partitions) and sorted in each.

    Joins and sums by these keys need neither exchange nor sort; so does writing df, if it comes from one of them.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, tag), f"tessera_{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    spark.conf.set(ORDERED, "true")
    with tidy(spark):
        df.write.bucketBy(partitions(spark), *keys).sortBy(*keys).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._scratch_path, out._scratch_table = path, name
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() or stored_sorted() wrote for df, once nothing will read it again."""
    if name := getattr(df, "_scratch_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path := getattr(df, "_scratch_path", None):
        remove_path(df.sparkSession, path)


# ---------------------------------------------------------------- Arrow text access


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with null as the empty string."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets has one more entry than the column has rows."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and their peaks would add up over stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a libc without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Yields (first row, end row) of runs of rows that hold about `most` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64 = BASE) -> np.uint64:
    """The inverse of an odd base modulo 2^64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


_SCALES: list[np.ndarray] = []


def scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, kept between calls."""
    if not _SCALES or len(_SCALES[0]) < n:
        n = max(n, BLOCK_BYTES + (1 << 16))
        _SCALES[:] = powers(n), powers(n, inverse())
    return _SCALES[0], _SCALES[1]


#: Bytes with A-Z in lower case, and which bytes part words: \x20 and \x09-\x0D.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every word of the rows' texts, in order, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = SPACE[data]
    solid = ~space
    starts = offsets[:-1][np.diff(offsets) > 0]
    first = solid.copy()
    first[1:] &= space[:-1]
    first[starts] = solid[starts]
    last = solid.copy()
    last[:-1] &= space[1:]
    last[starts[1:] - 1] = solid[starts[1:] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = scales(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return np.searchsorted(offsets, s, side="right") - 1, mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


# ---------------------------------------------------------------- Spark helpers


def ascii_lower(col: Column | str) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A node of more than this share of the edges is a hub: there are at most 2 / HUB of them.
HUB = 1e-4


def with_least(edges: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """edges (u, v) with m, the node that least (u, m) has for u. Hubs' edges stay where they are: hubs (u, hub) is small."""
    marked = edges.join(F.broadcast(hubs), "u", "left")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(marked.where("hub is null").select("u", "v").join(least, "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is the component's smallest node.

    Alternating large-star and small-star steps: each moves every node's edges to a smaller neighbour, so edges
    never outnumber the input. A node's smallest neighbour is found by partial minima; the few hubs' are broadcast, and
    the rest joined. Each round is a table in the shared folder. An empty table of edges gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "cc")
    most = 2 * e.count()  # edges never get more

    def starred(both: DataFrame, of) -> DataFrame:
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-low", most)
        total = low.agg(F.sum("n")).first()[0] or 0
        hubs = low.where(F.col("n") > max(16.0, total * HUB)).select("u", F.col("m").alias("hub"))
        out = stored(of(with_least(both, low.select("u", "m"), hubs)).distinct(), "cc", most)
        drop_stored(low)
        return out

    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = starred(both, lambda x: x.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        after = starred(large, lambda x: x.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v"))
        drop_stored(large)
        # done when every node has one parent and no parent has a parent
        parents = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        chained = after.select("v").distinct().join(after.select(F.col("u").alias("v")), "v", "left_semi")
        done = not parents.where("n > 1").limit(1).count() and not chained.limit(1).count()
        drop_stored(e)
        e = after
        if done:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
