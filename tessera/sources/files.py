"""Files as tables: directory scans with path filters, text decoding, and sitemaps."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import basename
from .shared import shared_dir

#: What a scan passes over, and what it takes for text.
IGNORED_DIRS = ".git .hg .svn node_modules vendor dist build target __pycache__ .venv .idea .vscode mft".split()
TEXT_ENDINGS = (
    "go ts tsx js jsx mjs cjs py rs c h cc cpp hpp cs java kt swift rb php scala md mdx txt rst toml yaml yml json jsonc xml html css scss "
    "sh bash zsh ps1 bat cmd sql proto graphql cmake makefile gradle sbt lua r jl zig mod sum env gitignore dockerignore"
).split()
TEXT_NAMES = "makefile dockerfile gemfile rakefile procfile license readme".split()
MOST_BYTES, MOST_FILES = 8 << 20, 50_000


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: `**/` any folders, `/**` everything below, `*` and `?` within a name."""
    if pattern in ("**", "**/*"):
        return ".*"
    lead, below = "", ""
    while pattern.startswith("**/"):
        lead, pattern = "(.*/)?", pattern[3:]
    if pattern.endswith("/**"):
        below, pattern = "(/.*)?", pattern[:-3]
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern)
    return f"{lead}{body}{below}"


def matches(path: Column, pattern: str, by_name: bool = True) -> Column:
    """Whether a path matches; by_name: its last part may match alone, as source trees are filtered."""
    x = f"^{glob_regex(pattern)}$"
    return path.rlike(x) | basename(path).rlike(x) if by_name and not pattern.endswith("/**") else path.rlike(x)


def allowed(path: Column, include: list[str], exclude: list[str], by_name: bool = True) -> Column:
    """In one of the include patterns (any path, if there are none) and in no exclude pattern."""
    ok = F.lit(not include)
    for p in include:
        ok = ok | matches(path, p, by_name)
    for p in exclude:
        ok = ok & ~matches(path, p, by_name)
    return ok


def ignored(path: Column) -> Column:
    """Whether a folder of the path is one that scans pass over."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRS)))


def textual(path: Column) -> Column:
    name = F.lower(basename(path))
    ending = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(F.contains(name, F.lit(".")), ending.isin(*TEXT_ENDINGS)).otherwise(name.isin(*TEXT_NAMES))


@F.arrow_udf(StringType())
def decoded(content):
    """Bytes as text: UTF-8, and each byte that isn't by Windows-1252 (its own letter where that has none)."""

    def one(b):
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(b):
                try:
                    out.append(b[at:].decode("utf-8"))
                    break
                except UnicodeDecodeError as e:
                    bad = b[at + e.start : at + e.start + 1]
                    out.append(b[at : at + e.start].decode("utf-8"))
                    out.append(bad.decode("cp1252", errors="ignore") or chr(bad[0]))
                    at += e.start + 1
            return "".join(out)

    return pa.array([None if b is None else one(b) for b in content.to_pylist()], pa.string())


def scan(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = (), most_bytes: int = MOST_BYTES, paths: DataFrame | None = None, recurse: bool = True, most_files: int = 0) -> DataFrame:
    """(path, mtime, hash, text) of the text files below a folder that the filters allow; paths (path) restricts further.

    Sizes, names and filters are checked on the listing, which the driver holds in any case; only what passes is read.
    most_files (0: any number) keeps the first ones by path.
    """
    root = folder.rstrip("/")
    bare = re.sub(r"^[a-z0-9]+:/*", "/", root)
    rel = F.regexp_replace("path", f"^[a-z0-9]+:/*{re.escape(bare)}/", "")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(root).where(F.col("length") <= most_bytes)
    listed = found.select(rel.alias("path"), F.col("path").alias("_whole"))
    listed = listed.where(~ignored(F.col("path")) & textual(F.col("path")) & allowed(F.col("path"), list(include), list(exclude)))
    listed = listed.join(paths, "path", "left_semi") if paths is not None else listed
    listed = listed.orderBy("path").limit(most_files) if most_files > 0 else listed
    wanted = [r._whole for r in listed.select("_whole").collect()]
    rows = spark.read.format("binaryFile").load(wanted) if wanted else found.limit(0)
    return rows.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), decoded("content").alias("text"))


def sitemap_urls(maps: DataFrame, host: str, prefixes: list[str]) -> DataFrame:
    """(url) of sitemap documents (column xml) that are on the host and below a prefix."""
    urls = maps.select(F.explode(F.xpath("xml", F.lit("//*[local-name()='loc']/text()"))).alias("url")).select(F.trim("url").alias("url"))
    ok = F.lit(not prefixes)
    for p in prefixes:
        ok = ok | F.startswith("url", F.lit(p))
    return urls.where((F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)) == host.lower()) & ok).distinct()


def robots_rules(body: str, agent: str) -> list[str]:
    """Path prefixes that robots.txt forbids an agent: its own group's if it has one, else everybody's."""
    groups: list[tuple[set[str], list[str]]] = []
    for raw in body.splitlines():
        key, sep, value = raw.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not groups or groups[-1][1]:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif key == "disallow" and value and groups:
            groups[-1][1].append(value)
    own = [d for names, ds in groups if any(n != "*" and n in agent.lower() for n in names) for d in ds]
    return own or [d for names, ds in groups if "*" in names and not any(n != "*" and n in agent.lower() for n in names) for d in ds]


def crawlable(url: Column, rules: list[str]) -> Column:
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))
    ok = F.lit(True)
    for r in rules:
        ok = ok & ~F.startswith(path, F.lit(r))
    return ok


def crawl(pages: DataFrame, links: DataFrame, start: list[str], depth: int, most: int) -> DataFrame:
    """(url, depth) of pages reached from the start addresses: breadth first over links (from, to), each level an anti-join.

    pages (url) are what can be fetched. The crawl stops after the level with which `most` pages are reached (the first
    ones by depth and address are given), or when a level finds nothing. Each level is checkpointed.
    """
    spark = pages.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    level = spark.createDataFrame([(u, 0) for u in dict.fromkeys(start)], "url string, depth int").join(pages.select("url"), "url", "left_semi").checkpoint()
    seen, reached = level, level.count()
    for d in range(1, depth + 1):
        if reached >= most:
            break
        new = links.join(level.select(F.col("url").alias("from")), "from", "left_semi").select(F.col("to").alias("url")).distinct()
        level = new.join(seen, "url", "left_anti").join(pages.select("url"), "url", "left_semi").withColumn("depth", F.lit(d)).checkpoint()
        if not (found := level.count()):
            break
        seen, reached = seen.unionByName(level), reached + found
    return seen.orderBy("depth", "url").limit(most)


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """(doc_id, title, body) of a made-up corpus: bodies vary by the number's remainders."""
    i = F.col("id")
    body = F.when(i % 11 == 0, "retry policy reconnect backoff network timeout").when(i % 5 == 0, "configure pin transfer device bus").otherwise("general notes about setup and usage")
    return spark.range(n).select(i.alias("doc_id"), F.format_string("doc-%06d", i).alias("title"), F.concat(body, F.lit(" item "), i.cast("string")).alias("body"))
