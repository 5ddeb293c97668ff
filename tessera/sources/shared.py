"""Folders for tables that queries keep: all executors share them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master without one, a folder that goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing stands at yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def version_of(spark: SparkSession, path: str) -> str:
    """Changes when files at a path do: the sum of their lengths and their latest time of change."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = fs.getFileStatus(p)
    files = [at] if at.isFile() else list(fs.listStatus(p))
    return f"{sum(f.getLen() for f in files)}-{max([f.getModificationTime() for f in files], default=0)}"


class Pointers:
    """Numbered files below a folder, each with the name of what it stands for.

    A pointer is written beside and then published under its number by one step that never replaces: a hard link on a
    local disk, elsewhere a rename, which fails where the name is taken. So a number belongs to one writer, and a file
    that has one is whole. A file that is empty or cut short all the same (left by other means) counts as taken and is
    passed over by readers.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, number: int) -> str:
        return f"{self.folder}/v{number}"

    def taken(self) -> list[int]:
        """All numbers that stand for something, ascending."""
        folder = self.path(self.folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def name(self, number: int) -> str | None:
        """What a number stands for; None if its file isn't whole."""
        stream = self.fs.open(self.path(self.at(number)))
        try:
            found = stream.readUTF()
        except Py4JJavaError as e:
            if "EOFException" in str(e.java_exception) or "UTFDataFormatException" in str(e.java_exception):
                return None
            raise
        finally:
            stream.close()
        return found if re.fullmatch(r"[0-9a-f]{32}", found) else None

    def whole(self) -> list[int]:
        """The numbers whose files are whole, ascending."""
        return [n for n in self.taken() if self.name(n)]

    def last(self) -> int:
        """The highest number whose file is whole; 0 without any."""
        return next((n for n in reversed(self.taken()) if self.name(n)), 0)

    def publish(self, name: str, after: int) -> int:
        """Makes name the one that follows the number `after`; FileExistsError if another writer was first."""
        if self.last() != after:
            raise FileExistsError(self.at(self.last()))
        number = max(self.taken(), default=0) + 1
        beside, to = self.path(f"{self.folder}/pending-{uuid.uuid4().hex}"), self.path(self.at(number))
        stream = self.fs.create(beside, False)
        try:
            stream.writeUTF(name)
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                file = lambda p: self.spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).toPath()
                self.spark.sparkContext._jvm.java.nio.file.Files.createLink(file(to), file(beside))
            elif self.fs.exists(to) or not self.fs.rename(beside, to):
                raise FileExistsError(to.toString())
        except Py4JJavaError as e:
            if self.fs.exists(to):
                raise FileExistsError(to.toString()) from e
            raise
        finally:
            self.fs.delete(beside, False)
        return number

    def forget(self, number: int) -> None:
        self.fs.delete(self.path(self.at(number)), False)


class Versions:
    """Versions of a set of tables below a folder: each one a folder of its own, named by a pointer.

    Of two writers one fails; a job that is lost before its pointer is published leaves the last version as it was, and
    readers of older versions are not disturbed until these are forgotten.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.pointers = Pointers(spark, f"{self.folder}/versions")
        self.path, self.fs = self.pointers.path, self.pointers.fs

    def all(self) -> list[int]:
        return self.pointers.whole()

    def tables(self, version: int | None = None) -> str | None:
        """The folder of a version's tables (the last one's); None if there is none."""
        v = version if version is not None else self.pointers.last()
        name = self.pointers.name(v) if v else None
        return f"{self.folder}/tables/{name}" if name else None

    def draft(self) -> str:
        """The folder for tables of a version to come."""
        return f"{self.folder}/tables/{uuid.uuid4().hex}"

    def commit(self, draft: str, after: int) -> int:
        """Makes a draft the version that follows `after`; FileExistsError, and the draft deleted, if another writer was first."""
        try:
            return self.pointers.publish(draft.rpartition("/")[2], after)
        except FileExistsError:
            self.fs.delete(self.path(draft), True)
            raise

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the latest versions, and pointers before these that aren't whole."""
        kept = self.all()[-keep:]
        for v in [v for v in self.pointers.taken() if kept and v < kept[0]]:
            old = self.tables(v)
            self.pointers.forget(v)
            if old:
                self.fs.delete(self.path(old), True)
