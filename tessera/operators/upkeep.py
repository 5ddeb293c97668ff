"""Upkeep of a stored term index: batches of changed documents add delta runs, and document frequencies follow.

The index is four tables in buckets: the documents' term vectors (by document), postings and document frequencies (by
term), and the chunks of each root. A version is a manifest that says which runs hold each bucket, so what a batch
doesn't touch is neither read nor written again. A batch reads the old vectors of its documents from their buckets alone,
nets them with the new ones, and writes what is left as a run of postings: added, replaced (the count of a term changed)
or taken away. Frequencies of the terms in it are the old ones plus the net sum; those that fall to zero vanish. A
bucket with FANOUT runs is merged into one without what was taken away.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Versions
from .index import counted_terms

#: Rows that one bucket takes when the index is made, the fewest buckets, and runs that make a bucket due for a merge.
BUCKET_ROWS, LEAST_BUCKETS, FANOUT = 4_000_000, 16, 4
#: Documents of a batch up to which their ids go to every task, so that no term of another document is counted.
SMALL_BATCH = 1 << 16
MANIFEST = "name string, bucket int, run string, buckets int"
#: The tables and what they are dealt out by.
BY = {"forward": "document_id", "postings": "term", "frequency": "term", "roots": "root_name"}


class Entry(NamedTuple):
    """A run that holds rows of a bucket of a table; buckets: how many the index has."""

    name: str
    bucket: int
    run: str
    buckets: int


class TermIndex:
    """The index below a folder that all executors share. Readers see the version that was last when they began."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, folder)

    # -------------------------------------------------------------- reading

    def manifest(self) -> list[Entry]:
        """The rows of the last version's manifest: as many as buckets and their runs."""
        at = self.versions.tables()
        if at is None:
            raise FileNotFoundError(f"no index below {self.folder}")
        return [Entry(*r) for r in self.spark.read.schema(MANIFEST).parquet(f"{at}/manifest").collect()]

    def rows(self, manifest: list[Entry], name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A table's rows from all runs, of some buckets only if these are given; None if there are none."""
        at = [f"{self.folder}/data/{r.run}/{name}/bucket={r.bucket}" for r in manifest if r.name == name and (buckets is None or r.bucket in buckets)]
        return self.spark.read.parquet(*at) if at else None

    @staticmethod
    def bucket(key: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str, buckets: int) -> set[int]:
        """The buckets that rows' keys fall into: at most as many as there are."""
        return {r.bucket for r in rows.select(self.bucket(key, buckets).alias("bucket")).distinct().collect()}

    def live_postings(self, rows: DataFrame) -> DataFrame:
        """(term, root_name, chunk_id, tf) of runs of postings."""
        net = rows.groupBy("term", "root_name", "chunk_id").agg(F.sum("sign").alias("s"), F.max_by("tf", "seq").alias("tf"))
        return net.where("s > 0").select("term", "root_name", "chunk_id", "tf")

    def live_forward(self, rows: DataFrame) -> DataFrame:
        """(document_id, chunk_id, root_name, v, seq) of runs of vectors: each document as its last run has it."""
        last = rows.groupBy("document_id").agg(F.max("seq").alias("seq"))
        return rows.join(last, ["document_id", "seq"]).where("chunk_id is not null").select("document_id", "chunk_id", "root_name", "v", "seq")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, root_name, chunk_id, tf): of all terms, or of the buckets of some."""
        return self.read("postings", "term string, root_name string, chunk_id long, tf long", terms, self.live_postings)

    def frequency(self, terms: list[str] | None = None) -> DataFrame:
        """(root_name, term, df): of all terms, or of the buckets of some."""
        return self.read("frequency", "root_name string, term string, df long", terms, lambda rows: rows.select("root_name", "term", "df"))

    def roots(self) -> DataFrame:
        """(root_name, n): chunks by root."""
        return self.read("roots", "root_name string, n long", None, lambda rows: rows.select("root_name", "n"))

    def read(self, name: str, schema: str, terms: list[str] | None, live) -> DataFrame:
        manifest = self.manifest()
        buckets = None
        if terms is not None:
            buckets = self.touched(self.spark.createDataFrame([(t,) for t in terms], "term string"), "term", manifest[0].buckets)
        rows = self.rows(manifest, name, buckets)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        out = live(rows)
        return out.where(F.col("term").isin(terms)) if terms is not None else out

    # -------------------------------------------------------------- writing

    def write(self, rows: DataFrame, name: str, run: str, buckets: int) -> list[Entry]:
        """Writes a run of a table, hot buckets as several files; its manifest rows."""
        at = f"{self.folder}/data/{run}/{name}"
        dealt = rows.withColumn("bucket", self.bucket(BY[name], buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", BY[name])
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(at)
        path = self.versions.path(at)
        names = [x.getPath().getName() for x in self.versions.fs.listStatus(path)]
        return [Entry(name, int(n.partition("=")[2]), run, buckets) for n in names if n.startswith("bucket=")]

    def commit(self, rows: list[Entry], after: int) -> int:
        draft = self.versions.draft()
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{draft}/manifest")
        return self.versions.commit(draft, after)

    @staticmethod
    def vectors(chunks: DataFrame, seq: int) -> DataFrame:
        return counted_terms(chunks, "document_id", "chunk_id", "root_name").withColumn("seq", F.lit(seq).cast("long"))

    def kept(self, rows: DataFrame, name: str, run: str) -> DataFrame:
        """rows, computed once: a table beside the run's, for as long as the batch takes."""
        at = f"{self.folder}/data/{run}/kept/{name}"
        rows.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def forget_kept(self, run: str) -> None:
        self.versions.fs.delete(self.versions.path(f"{self.folder}/data/{run}/kept"), True)

    def create(self, chunks: DataFrame, buckets: int | None = None) -> int:
        """The first version, of chunks (document_id, chunk_id, root_name, heading, body); FileExistsError if there is one."""
        if self.versions.all():
            raise FileExistsError(self.folder)
        run = uuid.uuid4().hex
        if buckets is None:
            n = chunks.select(F.sum(F.octet_length("body"))).first()[0] or 0  # a term takes eight bytes or so of text
            buckets = max(LEAST_BUCKETS, -(-n // 8 // BUCKET_ROWS))
        out = self.write(self.vectors(chunks, 0), "forward", run, buckets)
        made = self.rows(out, "forward")
        if made is not None:
            each = made.select("root_name", "chunk_id", F.explode("v").alias("t"))
            out += self.write(each.select("t.term", "root_name", "chunk_id", "t.tf", F.lit(1).alias("sign"), F.lit(0).cast("long").alias("seq")), "postings", run, buckets)
            postings = self.rows(out, "postings")
            if postings is not None:
                out += self.write(postings.groupBy("root_name", "term").agg(F.count(F.lit(1)).alias("df")), "frequency", run, buckets)
            out += self.write(made.groupBy("root_name").agg(F.count(F.lit(1)).alias("n")), "roots", run, buckets)
        return self.commit(out or [Entry("none", -1, run, buckets)], 0)

    def apply(self, changed: DataFrame, chunks: DataFrame) -> int:
        """A batch: the documents of changed (document_id) have from now on the chunks given, and those without any are gone.

        Chunks of documents that aren't in changed are ignored. An unknown document without chunks changes nothing. Null
        ids are ignored; a repeated chunk_id within the batch isn't allowed. Of two writers one fails with
        FileExistsError, and nothing of it is seen. The version, after.
        """
        last, manifest = self.versions.pointers.last(), self.manifest()
        run, buckets, seq = uuid.uuid4().hex, manifest[0].buckets, last + 1
        ids = self.kept(changed.where("document_id is not null").select("document_id").distinct(), "changed", run)
        if ids.count() <= SMALL_BATCH:
            chunks = chunks.join(F.broadcast(ids), "document_id", "left_semi")
        # texts stay where they are, their vectors are joined; a document without chunks keeps a row without any
        fresh = ids.join(self.vectors(chunks, seq).drop("seq"), "document_id", "left").withColumn("seq", F.lit(seq).cast("long"))
        out = self.write(fresh, "forward", run, buckets)
        written = self.rows(out, "forward")
        if written is None:
            self.forget_kept(run)
            return last
        old = self.rows(manifest, "forward", {r.bucket for r in out})
        sides = [written.where("chunk_id is not null").withColumn("sign", F.lit(1))]
        if old is not None:
            sides.append(self.live_forward(old.join(ids, "document_id", "left_semi")).withColumn("sign", F.lit(-1)))
        both = reduce(DataFrame.unionByName, [s.select("chunk_id", "root_name", "v", "sign") for s in sides])
        tf = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("tf")))
        each = both.select("chunk_id", "root_name", "sign", F.explode("v").alias("t")).select("chunk_id", "root_name", "sign", "t.term", "t.tf")
        net = each.groupBy("term", "root_name", "chunk_id").agg(F.sum("sign").alias("s"), tf(1).alias("new"), tf(-1).alias("old"))
        net = net.where("s <> 0 or new <> old").select("term", "root_name", "chunk_id", F.coalesce("new", "old").alias("tf"), F.col("s").cast("int").alias("sign"), F.lit(seq).cast("long").alias("seq"))
        out += self.write(net, "postings", run, buckets)
        kept = manifest
        for name, keys, delta in (
            ("frequency", ["root_name", "term"], self.rows(out, "postings")),
            ("roots", ["root_name"], both.select("root_name", "sign")),
        ):
            if delta is None:
                continue
            n = "df" if name == "frequency" else "n"
            delta = self.kept(delta.groupBy(*keys).agg(F.sum("sign").cast("long").alias(n)).where(f"{n} <> 0"), f"{name}-delta", run)
            at = self.touched(delta, BY[name], buckets)
            before = self.rows(manifest, name, at)
            rows = delta if before is None else before.select(*keys, n).unionByName(delta).groupBy(*keys).agg(F.sum(n).alias(n)).where(f"{n} > 0")
            if at:
                out += self.write(rows, name, run, buckets)
            kept = [r for r in kept if r.name != name or r.bucket not in at]
        self.forget_kept(run)
        whole = self.merged([r for r in kept if r.name != "none"] + out, buckets)
        return self.commit(whole or [Entry("none", -1, run, buckets)], last)

    def merged(self, manifest: list[Entry], buckets: int) -> list[Entry]:
        """The manifest with buckets of FANOUT runs or more merged into one."""
        for name, live in (("postings", self.live_postings), ("forward", self.live_forward)):
            runs: dict[int, int] = {}
            for r in manifest:
                runs[r.bucket] = runs.get(r.bucket, 0) + (r.name == name)
            due = {b for b, n in runs.items() if n >= FANOUT}
            if due:
                rows = live(self.rows(manifest, name, due))
                if name == "postings":
                    rows = rows.withColumns({"sign": F.lit(1), "seq": F.lit(0).cast("long")})
                manifest = [r for r in manifest if r.name != name or r.bucket not in due] + self.write(rows, name, uuid.uuid4().hex, buckets)
        return manifest
