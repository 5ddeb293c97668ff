"""Files kept up by ordered change feeds (name-status lines of commits), renames followed to where a file first came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh
from . import recipes

FILES = "path string, seq long, origin string, moves long"
#: A path's changes are ordered within stretches of so many commits, then over the stretches' last ones.
STRETCH = 4096
#: Commits of what was there before the feed, and of what isn't known.
BEFORE, UNKNOWN = -1, -2


def events(changes: DataFrame) -> DataFrame:
    """(path, seq, there, begins, source) of changes (seq, line): each path once a commit.

    Lines are tab-separated: A, M and T, D, and R with the old path before the new one, the letter followed by anything.
    A rename takes the old path away and begins the new one. Of a path that a commit both takes away and begins the
    beginning counts, of several sources the greatest. Other lines, and those without a path, are passed over.
    """
    p = F.split(F.trim("line"), "\t")
    kind, one, two = F.left(p[0], F.lit(1)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
    row = lambda path, there, begins, source=F.lit(None): F.struct(path.alias("path"), F.lit(there).alias("there"), F.lit(begins).alias("begins"), source.cast("string").alias("source"))
    rows = (
        F.when(kind == "A", F.array(row(one, True, True)))
        .when(kind.isin("M", "T"), F.array(row(one, True, False)))
        .when(kind == "D", F.array(row(one, False, False)))
        .when((kind == "R") & (two != ""), F.array(row(one, False, False), row(two, True, True, one)))
    )
    each = changes.select(F.col("seq").cast("long").alias("seq"), F.explode(rows).alias("r")).select("seq", "r.*").where("path <> '' and seq is not null")
    return each.groupBy("path", "seq").agg(F.max("there").alias("there"), F.max("begins").alias("begins"), F.max("source").alias("source"))


def prior_begins(begins: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (path, seq, target) with the commit of the last of begins (path, seq) before theirs as prior; BEFORE without one.

    Changes of one path are parted by stretches of commits, so that no task holds all of a path that changes often.
    """
    marks = begins.select("path", "seq", F.col("seq").alias("begin"), F.lit(None).cast("string").alias("target"))
    both = marks.unionByName(asks.select("path", "seq", F.lit(None).cast("long").alias("begin"), "target")).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    ends = marks.groupBy("path", F.floor(F.col("seq") / STRETCH).alias("stretch")).agg(F.max("seq").alias("end"))
    places = both.select("path", "stretch").distinct().join(ends, ["path", "stretch"], "left")
    earlier = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select("path", "stretch", F.max("end").over(earlier).alias("carried"))
    inside = Window.partitionBy("path", "stretch").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("begin").over(inside)).where("target is not null")
    out = near.join(carried, ["path", "stretch"])
    return out.select("path", "seq", "target", F.coalesce("near", "carried", F.lit(BEFORE)).alias("prior"))


def applied(files: DataFrame, changes: DataFrame) -> DataFrame:
    """FILES after changes (seq, line), whose commits, from 0, come after all that made files.

    seq is the commit that last changed a file, origin the path that it first had, moves how often it was renamed since.
    A path that is changed without being there counts as begun by that. A rename of a path that was never there has
    that path as origin. Applying a feed in parts, in order, gives the same as applying it whole. Other columns of
    files are dropped; equal lines count once.
    """
    spark = files.sparkSession
    at = fresh(spark, "feed")
    events(changes).write.parquet(at)
    e = spark.read.parquet(at)
    there = files.select("path", F.lit(BEFORE).cast("long").alias("seq"), F.lit(True).alias("there"), F.lit(True).alias("begins"), F.lit(None).cast("string").alias("source"), F.col("seq").alias("own"))
    both = there.unionByName(e.withColumn("own", F.col("seq")))
    last = both.groupBy("path").agg(
        F.max_by("there", "seq").alias("there"),
        F.max_by("own", "seq").alias("seq"),
        F.max(F.when(F.col("begins"), F.col("seq"))).alias("born"),
        F.max(F.when(~F.col("there"), F.col("seq"))).alias("died"),
    )
    born = F.when(F.col("born").isNull() | (F.col("died") > F.col("born")), F.lit(UNKNOWN)).otherwise(F.col("born"))
    node = lambda path, seq: F.struct(F.col(path).alias("path"), seq.cast("long").alias("seq"))
    present = last.where("there").select("path", "seq", node("path", born).alias("uri"))
    asks = e.where("source is not null").select(F.col("source").alias("path"), "seq", F.col("path").alias("target"))
    edges = prior_begins(both.where("begins").select("path", "seq"), asks)
    chains = recipes.lineage(edges.select(node("target", F.col("seq")).alias("uri"), node("path", F.col("prior")).alias("replaces")))
    out = present.join(chains.select("uri", F.col("origin").alias("root"), "steps"), "uri", "left").withColumn("root", F.coalesce("root", "uri"))
    known = files.select(F.struct(F.col("path").alias("path"), F.lit(BEFORE).cast("long").alias("seq")).alias("root"), F.col("origin").alias("first"), F.col("moves").alias("before"))
    out = out.join(known, "root", "left")
    moves = F.coalesce("steps", F.lit(0)) + F.coalesce("before", F.lit(0))
    return out.select("path", "seq", F.coalesce("first", "root.path").alias("origin"), moves.cast("long").alias("moves"))


def rescanned(files: DataFrame, listing: DataFrame, seq: int) -> DataFrame:
    """FILES after all paths were listed (path) at a commit: what wasn't seen goes, what is new begins there."""
    seen = listing.select("path").where("path <> ''").distinct()
    new = seen.join(files, "path", "left_anti").select("path", F.lit(seq).cast("long").alias("seq"), F.col("path").alias("origin"), F.lit(0).cast("long").alias("moves"))
    return files.select("path", "seq", "origin", "moves").join(seen, "path", "left_semi").unionByName(new)
