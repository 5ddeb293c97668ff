"""Request events from a stream into three tables (requests, their roots, their evidence) under one version a batch.

A batch is written aside and named by a pointer, which also says which batch of which writer it holds. A batch that was
killed before that leaves nothing that counts; one that is run again after it is passed over. The tables grow by runs,
one a batch; of rows with one request the latest run's hold, and compact() merges runs into one.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Pointers
from .events import run_by_batch

ROOT = "root_key string, root_name string, root_group_key string, root_role string, selected boolean"
EVIDENCE = "evidence_type string, evidence_key string, root_key string, source_uri string, rank_position int, selected_for_package boolean, included_after_trimming boolean, estimated_tokens long"
REQUEST = "request_id string, occurred_at timestamp, session_hash string, tool_name string, result_status string, coverage string, estimated_tokens long, returned_tokens long, token_estimator_version string"
EVENT = f"{REQUEST}, roots array<struct<{ROOT.replace(' ', ':')}>>, evidence array<struct<{EVIDENCE.replace(' ', ':')}>>".replace(",:", ", ")
COUNTS = "run string, rows long, dropped long, replaced long"
TABLES = {"requests": REQUEST, "roots": f"request_id string, {ROOT}", "evidence": f"request_id string, {EVIDENCE}", "counts": COUNTS}
#: Fixed value: how tokens are estimated, where an event doesn't say.
ESTIMATOR = "chars_div_4_v1"


def filled(c: Column) -> Column:
    """Null for a blank text."""
    return F.when(F.trim(c) != "", c)


def last_of_each(events: DataFrame) -> DataFrame:
    """events with each request once: the latest one's row, of several at a time the greatest."""
    rest = [c for c in events.columns if c not in ("request_id", "occurred_at")]
    rows = events.groupBy("request_id").agg(F.max(F.struct("occurred_at", *rest)).alias("e"))
    return rows.select("request_id", "e.*").select(events.columns)


def parts(events: DataFrame) -> dict[str, DataFrame]:
    """The three tables of events that have each request once."""
    text = {f.name for f in events.schema if f.dataType.simpleString() == "string"} - {"request_id", "tool_name", "result_status"}
    zero = lambda name: F.coalesce(name, F.lit(0))
    returned = F.when(zero("returned_tokens") == 0, zero("estimated_tokens")).otherwise(F.col("returned_tokens"))
    fixed = {
        "returned_tokens": returned,
        "estimated_tokens": F.when(zero("estimated_tokens") == 0, returned).otherwise(F.col("estimated_tokens")),
        "token_estimator_version": F.coalesce(filled(F.col("token_estimator_version")), F.when(returned > 0, ESTIMATOR)),
    }
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    requests = events.select(*(fixed.get(c, filled(F.col(c)) if c in text else F.col(c)).alias(c) for c in names(REQUEST)))
    r, e = events.select("request_id", F.explode("roots").alias("r")), events.select("request_id", F.explode("evidence").alias("e"))
    key, name = filled(F.col("r.root_key")), filled(F.col("r.root_name"))
    own = {"root_key": F.coalesce(key, name), "root_name": F.coalesce(name, key), "selected": F.coalesce("r.selected", F.lit(False))}
    roots = r.select("request_id", *(own.get(c, filled(F.col(f"r.{c}"))).alias(c) for c in names(ROOT)))
    flags = {c: F.coalesce(f"e.{c}", F.lit(False)) for c in ("selected_for_package", "included_after_trimming")}
    plain = {"evidence_type", "rank_position", "estimated_tokens"}
    evidence = e.select("request_id", *(flags.get(c, F.col(f"e.{c}") if c in plain else filled(F.col(f"e.{c}"))).alias(c) for c in names(EVIDENCE)))
    return {"requests": requests, "roots": roots, "evidence": evidence}


class RequestLog:
    """The three tables below a folder, as runs named by pointers."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointers = Pointers(spark, f"{self.folder}/versions")

    @staticmethod
    def name(writer: str, batch: int) -> str:
        """A pointer's name: whose run it is (10 digits), which batch (12), and its own (10)."""
        return f"{hashlib.md5(writer.encode()).hexdigest()[:10]}{batch:012x}{uuid.uuid4().hex[:10]}"

    def runs(self) -> list[str]:
        """Names of the runs that hold, oldest first: the last merged one and those after it."""
        names = []
        for number in reversed(self.pointers.taken()):
            if found := self.pointers.name(number):
                names.append(found)
                if found[:10] == self.name("", 0)[:10]:  # merged runs belong to no writer
                    break
        return names[::-1]

    def written(self, writer: str) -> int:
        """The last batch of a writer that counts; -1 if none does."""
        mine = self.name(writer, 0)[:10]
        for number in reversed(self.pointers.taken()):
            found = self.pointers.name(number)
            if found and found[:10] == mine:
                return int(found[10:22], 16)
        return -1

    def append(self, events: DataFrame, writer: str, batch: int) -> bool:
        """Writes a batch of EVENT rows as one run; False, and nothing written, if the writer's batch is there already.

        Rows without a request_id are dropped and counted, as are those that a later row of the batch replaces. The
        counts are taken while the batch is written. A writer's batches must come in order; several writers may work
        at once, each with a name of its own.
        """
        if not writer:
            raise ValueError("a writer needs a name")
        if self.written(writer) >= batch:
            return False
        name = self.name(writer, batch)
        path = f"{self.folder}/runs/{name}"
        seen, kept = Observation(f"seen-{name}"), Observation(f"kept-{name}")
        known = F.col("request_id").isNotNull()
        rows = events.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~known).alias("dropped")).where(known)
        once = last_of_each(rows).observe(kept, F.count(F.lit(1)).alias("n"))
        once.write.parquet(f"{path}/batch")
        for table, df in parts(self.spark.read.schema(EVENT).parquet(f"{path}/batch")).items():
            df.write.parquet(f"{path}/{table}")
        self.pointers.fs.delete(self.pointers.path(f"{path}/batch"), True)
        n, dropped = seen.get["n"], seen.get["dropped"]
        self.spark.createDataFrame([(name, n, dropped, n - dropped - kept.get["n"])], COUNTS).coalesce(1).write.parquet(f"{path}/counts")
        self.publish(name)
        return True

    def publish(self, name: str) -> None:
        for _ in range(100):  # another writer's run came between: ours follows it
            try:
                self.pointers.publish(name, self.pointers.last())
                return
            except FileExistsError:
                continue
        raise FileExistsError(self.folder)

    def table(self, name: str) -> DataFrame:
        """A table as it stands: of each request the rows of the latest run that has it; counts of all runs."""
        runs = self.runs()
        schema = TABLES[name]
        if not runs:
            return self.spark.createDataFrame([], schema)
        if name == "counts" or len(runs) == 1:  # a run has each request once
            return self.read(runs, name).drop("_run")
        latest = self.read(runs, "requests").groupBy("request_id").agg(F.max("_run").alias("_run"))
        return self.read(runs, name).join(latest, ["request_id", "_run"]).drop("_run")

    def read(self, runs: list[str], name: str) -> DataFrame:
        """All rows of a table's runs, with each one's place as _run."""
        df = self.spark.read.schema(TABLES[name]).parquet(*(f"{self.folder}/runs/{r}/{name}" for r in runs))
        place = F.create_map(*(F.lit(x) for i, r in enumerate(runs) for x in (r, i)))
        run = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([0-9a-f]{32})/", 1)
        return df.select("*", F.element_at(place, run).alias("_run"))

    def compact(self, after: int = 8) -> bool:
        """Merges all runs into one if there are more than `after`; False if not, or if another run came meanwhile.

        Runs that were merged stay readable by those who have begun; their files are left to be removed with the folder.
        Batches that they hold are still passed over when run again.
        """
        last, runs = self.pointers.last(), self.runs()
        if len(runs) <= after:
            return False
        name = self.name("", 0)
        for table in TABLES:
            self.table(table).write.parquet(f"{self.folder}/runs/{name}/{table}")
        try:
            self.pointers.publish(name, last)
        except FileExistsError:
            return False
        return True


def record(stream: DataFrame, folder: str, checkpoint: str, writer: str = "requests", after: int = 64) -> None:
    """Runs a stream of EVENT rows into the tables below a folder, exactly once, and merges runs beyond `after`."""

    def write(df: DataFrame, batch: int) -> None:
        log = RequestLog(df.sparkSession, folder)
        log.append(df, writer, batch)
        log.compact(after)

    run_by_batch(stream, checkpoint, write)
