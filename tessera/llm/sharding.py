"""Sharding by size-tiered compaction. DataFrame functions only.

A store is a folder with immutable shard files and versioned manifests. An append writes its arrivals as small runs, one
folder a run, in one pass and without a shuffle. Compaction takes the tiers of similarly sized runs (by powers of the
fanout) that hold `fanout` runs or more, reads them together and writes files of about the target size; what has reached
the target is left alone. Both end by committing a new manifest: its table is written aside, and then a pointer to it is
published under the next version's number, whole and never in another's place; so of two writers one fails and leaves
nothing. Readers see the files of the highest version, so a job that is lost half-way leaves the store
as it was. Older versions can be read until vacuum, which keeps the latest ones.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Pointers
from .common import scratch_path, table

MANIFEST = "run string, shard string, tier int, n_docs long, n_bytes long"


class Store:
    """A sharded store below `root`, which all executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int, fanout: int = 4) -> None:
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.pointers = Pointers(spark, f"{self.root}/manifest")
        self.path, self.fs = self.pointers.path, self.pointers.fs

    # -------------------------------------------------------------- manifests

    def versions(self) -> list[int]:
        """The versions committed, ascending."""
        return self.pointers.whole()

    def version(self) -> int:
        """The highest version committed; 0 for a new store."""
        return self.pointers.last()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the highest): run, shard (file), tier, n_docs, n_bytes (of text)."""
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/tables/{self.pointers.name(v)}") if v else self.spark.createDataFrame([], MANIFEST)

    def commit(self, shards: DataFrame, after: int) -> int:
        """Makes shards the manifest of the version that follows `after`; FileExistsError if another writer was first."""
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.root}/tables/{name}")
        try:
            return self.pointers.publish(name, after)
        except FileExistsError:
            self.fs.delete(self.path(f"{self.root}/tables/{name}"), True)
            raise

    def tier(self, n_bytes: Column) -> Column:
        """0 up to target / fanout^3, one more for each factor of fanout; 3 and more: at the target."""
        return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(n_bytes, F.lit(1)) / (self.target / self.fanout**3)) / math.log(self.fanout))).cast("int")

    def measured(self, folder: str) -> DataFrame:
        """The manifest rows of the shards below a folder; reads the text's lengths only."""
        rows = self.spark.read.parquet(f"{self.root}/data/{folder}")
        rows = rows.select(F.col("_metadata.file_path").alias("shard"), F.col("n_bytes"))
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
        run = F.regexp_extract("shard", r"/data/(.*)/[^/]*$", 1)
        return sizes.select(run.alias("run"), "shard", self.tier(F.col("n_bytes")).alias("tier"), "n_docs", "n_bytes")

    # -------------------------------------------------------------- operations

    def append(self, docs: DataFrame, arrival: Column | None = None) -> int:
        """Adds docs as runs, one for each value of arrival (one if there is none), and commits. The version, after.

        Every row is kept as it is, nulls and repeated rows too. No rows: a version with nothing new.
        """
        v, folder = self.version(), f"a{uuid.uuid4().hex}"
        run = F.coalesce(arrival.cast("string"), F.lit("")) if arrival is not None else F.lit("0")
        doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rows = docs.select(doc.alias("doc"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), run.alias("run"))
        rows.write.option("compression", "zstd").partitionBy("run").parquet(f"{self.root}/data/{folder}")
        new = self.measured(folder) if rows.limit(1).count() else self.spark.createDataFrame([], MANIFEST)
        return self.commit(self.manifest().unionByName(new), v)

    def compact(self) -> int:
        """Merges each tier that has `fanout` runs or more into target-sized files, and commits. The version, after."""
        v, live = self.version(), self.manifest()
        runs = live.groupBy("run").agg(F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("most"))
        small = runs.where(F.col("most") < self.target / 2).withColumn("tier", self.tier(F.col("n_bytes")))
        full = small.groupBy("tier").agg(F.count(F.lit(1)).alias("c"), F.sum("n_bytes").alias("n_bytes")).where(F.col("c") >= self.fanout)
        tiers = full.orderBy("tier").collect()  # a row a tier
        if not tiers:
            return v
        merged = []
        for t in tiers:
            shards = live.join(small.where(F.col("tier") == t.tier).select("run"), "run", "left_semi")
            paths = [r.run for r in shards.select("run").distinct().collect()]  # the runs of a tier: bounded by what arrived since its last merge
            rows = self.spark.read.parquet(*[f"{self.root}/data/{p}" for p in paths])
            n = max(1, round(t.n_bytes / self.target))
            folder = f"m{uuid.uuid4().hex}/t{t.tier + 1}"
            even = F.xxhash64("doc.doc_id", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
            rows.select("doc", "n_bytes", even.alias("even")).repartition(n, "even").drop("even").sortWithinPartitions("doc.doc_id").write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
            merged.append(folder)
        rest = live.join(small.join(full.select("tier"), "tier").select("run"), "run", "left_anti")
        for folder in merged:
            rest = rest.unionByName(self.measured(folder))
        return self.commit(rest, v)

    def vacuum(self, keep: int = 1) -> None:
        """Forgets all but the latest `keep` versions, and deletes run folders that none of these lists."""
        old, kept = (vs := self.versions())[:-keep], vs[-keep:]
        live = {r.run for v in kept for r in self.manifest(v).select("run").distinct().collect()}  # runs, not files or rows
        for v in old:
            name = self.pointers.name(v)
            self.pointers.forget(v)
            self.fs.delete(self.path(f"{self.root}/tables/{name}"), True)
        at = self.path(f"{self.root}/data")
        for x in self.fs.listStatus(at) if self.fs.exists(at) else []:
            for y in self.fs.listStatus(x.getPath()):
                if y.isDirectory() and f"{x.getPath().getName()}/{y.getPath().getName()}" not in live:
                    self.fs.delete(y.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the highest): doc, a struct of the columns appended, and shard, the file that it is in."""
        runs = [r.run for r in self.manifest(version).select("run").distinct().collect()]
        if not runs:
            return self.spark.createDataFrame([], "doc struct<doc_id: long, text: string>, shard string")
        rows = self.spark.read.parquet(*[f"{self.root}/data/{p}" for p in runs])
        return rows.select("doc", F.col("_metadata.file_path").alias("shard"))


#: Arrivals that a table is dealt into, bytes of text in a target-sized file, runs that make a tier full.
ARRIVALS, TARGET, FANOUT = 8, 32 << 20, 4


def shard(docs: DataFrame, arrivals: int = ARRIVALS, target: int = TARGET, fanout: int = FANOUT) -> tuple[Store, DataFrame]:
    """Appends docs as `arrivals` runs to a new store, compacts it, and gives the store and its shards' rows.

    docs has doc_id and text; other columns, of any names, are stored too, in one struct. The rows are (doc_id, shard, tier, version, n_docs, n_bytes),
    one for each row of docs; null ids and texts and repeated rows are kept, a null text counting 0 bytes. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, scratch_path(spark, "shards"), target, fanout)
    store.append(docs, F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(arrivals)))
    v, last = store.compact(), 0
    while v != last:  # what a merge made may fill the next tier
        v, last = store.compact(), v
    store.vacuum()
    live = store.manifest().select("shard", "tier", F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"))
    rows = store.read().select("doc.doc_id", "shard").join(live, "shard", "left")
    name = F.regexp_extract("shard", r"/data/(.*)$", 1)
    return store, rows.select("doc_id", name.alias("shard"), "tier", F.lit(v).cast("long").alias("version"), "shard_docs", "shard_bytes")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after its arrival and compaction."""
    return shard(table(spark, sf_dir, "documents"))[1]
