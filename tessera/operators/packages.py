"""Structured documentation: pipe tables, front matter, registries, and the joins that give each file its metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import folder_join

#: Headers that mean another name.
HEADERS = {"source paths": "source_paths", "source path": "source_paths", "artifact ids": "artifact_ids", "artifact id": "artifact_ids", "doc status": "doc_status", "i o ownership": "io_ownership", "socket storage ownership": "io_ownership", "owner task thread process": "owner"}


def header_key(text: str) -> str:
    s = " ".join(text.lower().replace("/", " ").split())
    return HEADERS.get(s, s.replace(" ", "_"))


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def separator(line: str) -> bool:
    return "-" in line and "|" in line and not set(line.strip()) - set("|-: ")


def pipe_tables(text: str) -> list[list[dict[str, str]]]:
    """The rows of each Markdown pipe table, by canonical header; rows that are short are filled with blanks."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        if not lines[i].strip().startswith("|") or i + 1 >= len(lines) or not separator(lines[i + 1]):
            i += 1
            continue
        heads = [header_key(c) for c in cells(lines[i])]
        i += 2
        rows = []
        while i < len(lines) and lines[i].strip().startswith("|"):
            if not separator(lines[i]):
                c = cells(lines[i])
                rows.append(dict(zip(heads, c + [""] * len(heads), strict=False)))
            i += 1
        if rows:
            out.append(rows)
    return out


def listed(text: str) -> list[str]:
    """The items of a cell: parted by semicolons, or else commas, or else bars."""
    t = text.strip()
    if t in ("", "-", "—"):
        return []
    sep = next((s for s in ";,|" if s in t), None)
    return [x for x in (p.strip().strip("`") for p in (t.split(sep) if sep else [t])) if x not in ("", "-")]


def front_matter(text: str) -> tuple[dict, str]:
    """(fields, body) of a document that may begin with YAML between `---` lines; broken YAML counts as none."""
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    import yaml

    try:
        fields = yaml.safe_load(m.group(1))
    except yaml.YAMLError:
        return {}, text
    return (fields if isinstance(fields, dict) else {}), text[m.end() :]


def evidence_level(text: str) -> str:
    """E1 to E4 wherever it stands in a text, or blank."""
    m = re.search(r"\bE([1-4])\b", text or "", re.I)
    return f"E{m.group(1)}" if m else ""


def inventory_rows(text: str) -> list[dict]:
    """Components of an inventory: rows with an id, lists as lists."""
    rows = [r for t in pipe_tables(text) for r in t if r.get("id")]
    return [r | {k: listed(r.get(k, "")) for k in ("source_paths", "artifact_ids")} for r in rows]


def problems(rows: list[dict], key: str) -> list[str]:
    """Warnings of a registry: repeated keys, and paths that leave their root."""
    out, seen = [], set()
    for r in rows:
        if r.get(key) in seen:
            out.append(f"duplicate {key} {r[key]}")
        seen.add(r.get(key))
        out += [f"unsafe path {p}" for p in [r.get("path", ""), r.get("folder", ""), *r.get("source_paths", [])] if isinstance(p, str) and (p.startswith("/") or ".." in p.split("/"))]
    return out


def enrich(files: DataFrame, components: DataFrame, index: DataFrame, front: DataFrame) -> DataFrame:
    """(path, id, component, level, status): front matter over index over the components whose folder holds the file.

    components (pos, id, name, level, folder, doc_status): the last one that holds a file names its id, the first with a
    value the rest. index (path, id, component, level, status) fills what is blank; front (path, status) overwrites.
    """
    held = folder_join(files.select("path"), components.select("folder", "id")).join(components.drop("folder"), "id")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    first = lambda c: F.min_by(blank(c), F.when(blank(c).isNotNull(), F.col("pos")))
    by_path = held.groupBy("path").agg(F.max_by("id", "pos").alias("c_id"), first("name").alias("c_name"), first("level").alias("c_level"), first("doc_status").alias("c_status"))
    ix = index.select("path", blank("id").alias("i_id"), blank("component").alias("i_name"), blank("level").alias("i_level"), blank("status").alias("i_status"))
    fm = front.select("path", blank("status").alias("f_status"))
    out = files.select("path").join(by_path, "path", "left").join(ix, "path", "left").join(fm, "path", "left")
    return out.select("path", F.coalesce("c_id", "i_id").alias("id"), F.coalesce("c_name", "i_name").alias("component"), F.coalesce("c_level", "i_level").alias("level"), F.coalesce("f_status", "c_status", "i_status").alias("status"))


def unregistered(components: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, artifact): artifacts that components name and the registry lacks; none where the registry is empty."""
    named = components.select("id", F.explode("artifact_ids").alias("artifact"))
    some = artifacts.select(F.col("id").alias("artifact")).where("artifact <> ''").distinct()
    there = some.agg((F.count(F.lit(1)) > 0).alias("any"))
    return named.join(some, "artifact", "left_anti").crossJoin(F.broadcast(there)).where("any").select("id", "artifact")  # there: one row


def hit_metadata(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """hits (root, path) with status, level and whether the package is validated; nulls where there is none."""
    return hits.join(meta.select("root", "path", "status", "level", "package_state"), ["root", "path"], "left")


def metadata_score(status: Column, evidence: Column, state: Column, content_class: Column, scores: dict[str, float]) -> Column:
    """What package metadata adds to a score."""
    add = lambda cond, key: F.when(cond, scores[key]).otherwise(0.0)
    return (
        add((status == "verified") & evidence.isin("E1", "E2"), "verified")
        + add(state == "validated", "validated")
        + add(status.isin("draft", "experimental"), "draft")
        + add(status == "inferred", "inferred")
        + add(status == "deprecated", "deprecated")
        + add(state == "invalid", "invalid")
        + add(content_class.isin("index", "inventory", "validation"), "index")
    )


def summary(docs: DataFrame) -> DataFrame:
    """(root, level, status, n) counts of a package's documents."""
    return docs.groupBy("root", F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def newest(metas: DataFrame) -> DataFrame:
    """The last stored metadata document of each root: (root, json, stored_at)."""
    return metas.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("stored_at"), "json"))).where("_r = 1").drop("_r")


#: How content classes of structured documentation begin, and the folder that it is kept in.
CURATED_CLASSES, LIBRARY_FOLDER = ("curated_", "librarydocs_"), "librarydocs/"


def of_package(path: Column, content_class: Column, described: Column) -> Column:
    """Whether a hit is of structured documentation: described by its index, by its class, or by its folder."""
    c, p = F.lower(F.coalesce(content_class, F.lit(""))), F.lower(path)
    folder = F.startswith(p, F.lit(LIBRARY_FOLDER)) | F.contains(p, F.lit("/" + LIBRARY_FOLDER))
    return F.coalesce(described, F.lit(False)) | folder | F.startswith(c, F.lit(CURATED_CLASSES[0])) | F.startswith(c, F.lit(CURATED_CLASSES[1]))


def filtered_hits(hits: DataFrame, only: bool = False, exclude: bool = False, level: str = "", status: str = "") -> DataFrame:
    """hits (path, content_class, level, status; the last two null where nothing describes a hit) that the filters leave."""
    described = F.col("level").isNotNull() | F.col("status").isNotNull()
    mine, ok = of_package(F.col("path"), F.col("content_class"), described), F.lit(True)
    ok = ok & mine if only else ok
    ok = ok & ~mine if exclude else ok
    for column, wanted in (("level", level), ("status", status)):
        ok = ok & (F.lower(F.coalesce(column, F.lit(""))) == wanted.strip().lower()) if wanted.strip() else ok
    return hits.where(ok)


def with_artifacts(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """files (path, component ...) with artifact_ids, those registered for the file, and the first one's component where it has none.

    artifacts has id, file and component.
    """
    a = artifacts.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_set("id")).alias("artifact_ids"), F.min_by("component", "id").alias("_component"))
    out = files.join(a, "path", "left")
    component = F.coalesce(F.nullif(F.col("component"), F.lit("")), F.col("_component"), F.lit(""))
    return out.withColumn("component", component).withColumn("artifact_ids", F.coalesce("artifact_ids", F.array().cast("array<string>"))).select(*files.columns, "artifact_ids")
