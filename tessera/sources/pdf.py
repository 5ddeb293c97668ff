"""PDF files with the standard library alone: page texts of plain and deflated streams, and what kind of file it is.

Encrypted files and object streams are told apart but not read; an image-only file has no text to give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.chunking import MOST_BYTES, bounded

#: Fixed value: a page with so many characters counts as text.
LEAST_RUNES = 40
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|\bT[*dDm]\b|\bET\b|'|\bTj\b|\bTJ\b", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(raw: bytes) -> str:
    """A string between parentheses."""
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return out.decode("cp1252", errors="replace")


def shown(content: bytes) -> str:
    """The strings that a content stream shows; moves to another line part them."""
    out = []
    for m in SHOWN.findall(content):
        if m.startswith(b"("):
            out.append(literal(m))
        elif m not in (b"Tj", b"TJ"):
            out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def page_texts(data: bytes) -> list[str]:
    """The text of each page; ValueError for what is no PDF or is encrypted."""
    if not data.startswith(b"%PDF"):
        raise ValueError("corrupt")
    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    objects = {int(n): body for n, body in OBJECT.findall(data)}

    def content(number: int) -> bytes:
        body = objects.get(number, b"")
        m = STREAM.search(body)
        if not m:
            return b""
        try:
            return zlib.decompress(m.group(1)) if b"/FlateDecode" in body else m.group(1)
        except zlib.error:
            return b""

    pages = []
    for _, body in sorted(objects.items()):
        if re.search(rb"/Type\s*/Page\b", body):
            m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            pages.append("\n".join(shown(content(int(n))) for n in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1))) if m else "")
    if not pages:
        raise ValueError("corrupt")
    return pages


def extract(files: DataFrame) -> DataFrame:
    """(path, page, text, error) of binary files (path, content): a row for each page, or one with what is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(page_texts(data or b""), 1)]
                except ValueError as e:
                    rows.append((path, 0, "", str(e)))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["path", "page", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


def inspect(pages: DataFrame) -> DataFrame:
    """(path, pages, text_pages, kind): text, image-only, mixed, encrypted or corrupt."""
    texty = (F.char_length(F.trim("text")) >= LEAST_RUNES).cast("int")
    g = pages.groupBy("path").agg(F.max("page").alias("pages"), F.sum(texty).alias("text_pages"), F.max("error").alias("error"))
    kind = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("text_pages") == 0, "image-only").when(F.col("text_pages") == F.col("pages"), "text").otherwise("mixed")
    return g.select("path", "pages", "text_pages", kind.alias("kind"))


def sections(pages: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(path, section, heading, start_page, end_page, body): a file's bookmarked sections, what precedes them, or all of it.

    pages has path, page and text; bookmarks has path, position, title, page_from and page_thru (0 if not known). A
    section without an end of its own goes on to the page before the next bookmark's. Blank pages give nothing.
    """
    span = pages.where("page > 0").groupBy("path").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    w = Window.partitionBy("path").orderBy("position")
    b = bookmarks.join(span, "path").withColumn("_next", F.lead("page_from").over(w))
    end = F.greatest("page_from", "page_thru")
    until = F.when((F.col("page_thru") <= F.col("page_from")) & (F.col("_next") - 1 >= F.col("page_from")), F.col("_next") - 1).otherwise(end)
    b = b.select("path", "position", F.col("title").alias("heading"), F.col("page_from").alias("_from"), F.least(until, F.col("last")).alias("end_page"), "first", "last")
    ahead = b.groupBy("path").agg(F.min_by("_from", "position").alias("_from"), F.min("first").alias("first")).where(F.col("_from") > F.col("first"))
    ahead = ahead.select("path", F.lit(-1).alias("position"), F.lit("").alias("heading"), F.col("first").alias("start_page"), (F.col("_from") - 1).alias("end_page"))
    marked = b.where((F.col("_from") <= F.col("last")) & (F.col("end_page") >= F.col("first"))).select("path", "position", "heading", F.greatest("_from", "first").alias("start_page"), "end_page")
    whole = span.join(marked.select("path").distinct(), "path", "left_anti").select("path", F.lit(-1).alias("position"), F.lit("").alias("heading"), F.col("first").alias("start_page"), F.col("last").alias("end_page"))
    ahead = ahead.join(marked.select("path").distinct(), "path", "left_semi")
    every = marked.unionByName(ahead).unionByName(whole).withColumn("section", F.row_number().over(Window.partitionBy("path").orderBy("position")))
    held = every.select("*", F.explode(F.sequence("start_page", "end_page")).alias("page")).join(pages.where(F.trim("text") != "").select("path", "page", "text"), ["path", "page"])
    text = held.groupBy("path", "section", "heading", "start_page", "end_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
    body = F.when(F.col("heading") != "", F.concat(F.lit("# "), "heading", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return text.select("path", "section", "heading", "start_page", "end_page", F.btrim(body, F.lit(" \t\r\n")).alias("body"))


def chunks(sections: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """sections' columns with (ordinal, part): bodies of more than so many bytes in parts of whole lines; blank ones give none."""
    kept = sections.where(F.trim("body") != "").withColumn("_lines", F.split(F.btrim("body", F.lit(" \t\r\n")), "\n"))
    fits = F.octet_length(F.btrim("body", F.lit(" \t\r\n"))) <= most
    whole = F.array(F.struct(F.lit(1).alias("start"), F.size("_lines").alias("end")))
    parts = kept.select("*", F.posexplode(F.when(fits, whole).otherwise(bounded(F.col("_lines"), most, blanks=False))).alias("ordinal", "_c"))
    text = F.array_join(F.slice("_lines", F.col("_c.start"), F.col("_c.end") - F.col("_c.start") + 1), "\n")
    return parts.select(*sections.columns, "ordinal", text.alias("part"))
