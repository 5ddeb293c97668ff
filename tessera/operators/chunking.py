"""Text into sections and chunks, with higher-order functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a chunk, line breaks counted; from half of them on, a blank line ends it.
MOST_BYTES = 3500
HEADING = r"^(#{1,6})(?:[ \t]+(.*))?$"


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def bounded(ls: Column, most: int = MOST_BYTES, blanks: bool = True) -> Column:
    """The chunks of an array of lines: an array of (start, end), 1-based and inclusive.

    Greedy: a line that would pass the bound starts a new chunk; a blank line from half the bound on ends one, or, if
    blank lines don't count, any line with which the bound is reached.
    """
    kind = "struct<done:array<struct<start:int,end:int>>,start:int,size:int,at:int>"
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(1).alias("start"), F.lit(0).alias("size"), F.lit(0).alias("at")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        size, at = F.octet_length(line) + 1, acc.at + 1
        full = (acc.size > 0) & (acc.size + size > most)
        done = F.when(full, F.concat(acc.done, F.array(F.struct(acc.start.alias("start"), acc.at.alias("end"))))).otherwise(acc.done)
        start, held = F.when(full, at).otherwise(acc.start), F.when(full, size).otherwise(acc.size + size)
        soft = (line == "") & (held >= most // 2) if blanks else held >= most
        done2 = F.when(soft, F.concat(done, F.array(F.struct(start.alias("start"), at.alias("end"))))).otherwise(done)
        return F.struct(done2.alias("done"), F.when(soft, at + 1).otherwise(start).alias("start"), F.when(soft, 0).otherwise(held).alias("size"), at.alias("at")).cast(kind)

    def finish(acc: Column) -> Column:
        return F.when(acc.at >= acc.start, F.concat(acc.done, F.array(F.struct(acc.start.alias("start"), acc.at.alias("end"))))).otherwise(acc.done)

    return F.aggregate(ls, zero, step, finish)


def chunk(docs: DataFrame, text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """docs' other columns with (ordinal, start_line, end_line, body) of each bounded chunk."""
    rest = [c for c in docs.columns if c != text]
    l = docs.select(*rest, lines(F.coalesce(text, F.lit(""))).alias("_lines"))
    c = l.select(*rest, "_lines", F.posexplode(bounded(F.col("_lines"), most)).alias("ordinal", "_c"))
    return c.select(*rest, "ordinal", F.col("_c.start").alias("start_line"), F.col("_c.end").alias("end_line"), F.array_join(F.slice("_lines", F.col("_c.start"), F.col("_c.end") - F.col("_c.start") + 1), "\n").alias("body"))


def markdown_chunk(docs: DataFrame, text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """docs' other columns with (ordinal, heading, start_line, end_line, body): Markdown sections, large ones in bounded chunks.

    A section begins with its heading's line; what precedes the first heading has none. All in the row: no shuffle.
    """
    rest = [c for c in docs.columns if c != text]
    l = docs.select(*rest, lines(F.coalesce(text, F.lit(""))).alias("_lines"))
    l = l.select(*rest, "_lines", F.transform("_lines", heading_title).alias("_titles"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: (i == 1) | F.element_at("_titles", i).isNotNull())
    l = l.select(*rest, "_lines", "_titles", starts.alias("_starts"))
    spans = F.transform("_starts", lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get("_starts", k + 1), F.size("_lines") + 1).alias("e"), F.coalesce(F.element_at("_titles", s), F.lit("")).alias("heading")))

    def sized(x: Column) -> Column:
        parts = bounded(F.slice("_lines", x["s"], x["e"] - x["s"]), most)
        return F.transform(parts, lambda c: F.struct((c["start"] + x["s"] - 1).alias("start"), (c["end"] + x["s"] - 1).alias("end"), x["heading"].alias("heading")))

    c = l.select(*rest, "_lines", spans.alias("_spans")).select(*rest, "_lines", F.posexplode(F.flatten(F.transform("_spans", sized))).alias("ordinal", "_c"))
    return c.select(*rest, "ordinal", F.col("_c.heading").alias("heading"), F.col("_c.start").alias("start_line"), F.col("_c.end").alias("end_line"), F.array_join(F.slice("_lines", F.col("_c.start"), F.col("_c.end") - F.col("_c.start") + 1), "\n").alias("body"))


def heading_title(line: Column) -> Column:
    """The title of a heading line; null for other lines."""
    bare = F.rtrim(line, F.lit(" \t"))
    return F.when(bare.rlike(HEADING), F.btrim(F.rtrim(F.btrim(F.regexp_extract(bare, HEADING, 2), F.lit(" \t")), F.lit("#")), F.lit(" \t")))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, heading, start_line, n_lines): Markdown sections; what precedes the first heading is section 0."""
    rows = docs.select(key, F.posexplode(lines(F.coalesce(text, F.lit("")))).alias("pos", "line"))
    title = heading_title(F.col("line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("title", title).withColumn("section", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(w).cast("int"))
    return rows.groupBy(key, "section").agg(F.coalesce(F.max("title"), F.lit("")).alias("heading"), (F.min("pos") + 1).alias("start_line"), F.count(F.lit(1)).alias("n_lines"))
