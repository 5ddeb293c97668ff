"""Classifiers as column expressions: paths, authorities, trust, coverage, freshness, tools, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranking import mapped
from .text import basename

#: The classes of a repository path, in the order that decides; a pattern over the lower-case path.
PATH_CLASSES = (
    ("third_party", r"(^|/)(vendor|third_party)/"),
    ("test", r"(^|/)(testdata|fixtures|test|tests)/|_test\.go$|_test\.py$|(^|/)test_[^/]*$"),
    ("example", r"(^|/)(example|examples|sample|samples)/"),
    ("project_meta", r"(^|/)((license|licence|notice)(\.[^/]*)?|copying|\.gitignore|\.gitattributes|authors|contributors)$"),
    ("documentation", r"/(docs|doc)/|\.(md|rst)$|(^|/)readme(\.[^/]*)?$"),
    ("build_file", r"(^|/)(cmakelists\.txt|makefile|dockerfile[^/]*|go\.mod|go\.sum|package\.json|cargo\.toml|meson\.build)$|\.(cmake|gradle)$"),
    ("configuration", r"\.(json|yaml|yml|toml|ini|cfg|conf)$"),
    ("generated", r"/generated/|\.pb\.go|\.generated\.go$"),
    ("public_header", r"\.(h|hpp|hh)$"),
    ("source", r"\.(c|cc|cpp|cxx|go|rs|py|java|ts|tsx|js|jsx|sql)$"),
)
LANGUAGES = {"go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}
ARTIFACTS = ("interfaces", "interface"), ("patterns", "pattern"), ("data", "data"), ("build", "build"), ("bench", "bench"), ("python", "python")
TOOLS = {
    "implementation_context": ("get_implementation_context", "implementation_context"),
    "knowledge_search": ("search_knowledge", "search"),
    "symbol_search": ("search_symbols", "get_symbol", "symbol_search"),
    "document_fetch": ("get_document", "get_document_chunk", "document_fetch"),
    "root_resolution": ("resolve_roots", "list_roots"),
    "outcome_report": ("report_outcome", "report_implementation_outcome"),
}


def path_class(path: Column) -> Column:
    p = F.lower(path)
    return F.coalesce(*[F.when(p.rlike(x), F.lit(name)) for name, x in PATH_CLASSES], F.lit("unknown"))


def language(path: Column) -> Column:
    return mapped(F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1)), LANGUAGES, "")


def artifact_type(path: Column) -> Column:
    p = F.lower(path)
    return F.coalesce(*[F.when(F.contains(p, F.lit(f"/{d}/")), F.lit(k)) for d, k in ARTIFACTS], F.lit("other"))


def infer_authority(root: Column, path: Column) -> Column:
    """The authority that a root's name or a path's segments suggest."""
    r, p = F.lower(F.trim(root)), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))

    def segment(*names: str) -> Column:
        found = F.lit(False)
        for s in names:
            found = found | F.contains(F.concat(F.lit("/"), p, F.lit("/")), F.lit(f"/{s}/")) | F.contains(r, F.lit(s))
        return found

    recipes = F.contains(F.concat(r, F.lit(" "), p), F.lit("_recipes/"))
    return (
        F.when(segment("recipe", "curated") | recipes, "curated_internal_recipe")
        .when(segment("sample", "samples", "example", "examples"), "official_example")
        .when(segment("help", "doc", "docs") | F.contains(p, F.lit("api/dita")), "official_documentation")
        .when(segment("testdata", "internal") | F.contains(r, F.lit("related")), "related_internal_project")
        .otherwise("unknown")
    )


def trust(package_state: Column, status: Column, evidence: Column, content_class: Column) -> tuple[Column, Column]:
    """(authority, deprecated) of a structured document."""
    s, e = F.lower(status), F.upper(evidence)
    weak = s.isin("draft", "experimental") | (e == "E4")
    docs, summary = F.lit("official_documentation"), F.lit("generated_summary")
    authority = (
        F.when(s == "deprecated", "unknown")
        .when((package_state == "invalid") & weak, "unknown")
        .when(package_state == "invalid", docs)
        .when((package_state == "validated") & (s == "verified") & e.isin("E1", "E2"), "curated_internal_recipe")
        .when((s == "verified") & ~e.isin("E1", "E2", ""), docs)
        .when((s == "inferred") | (e == "E3"), docs)
        .when(weak, "unknown")
        .when(content_class.isin("index", "inventory", "validation"), summary)
        .otherwise(docs)
    )
    return authority, s == "deprecated"


#: What package metadata adds to a hit's score.
METADATA_SCORES = {"verified": 6.0, "validated": 2.0, "draft": -8.0, "inferred": -3.0, "deprecated": -12.0, "invalid": -10.0, "index": -15.0}


def coverage_of(apis: Column, examples: Column, citations: Column, limits: Column, steps: Column) -> Column:
    """high, medium or low from counts of what a package has."""
    points = F.when(apis > 0, 2).otherwise(0) + F.when(examples > 0, 2).otherwise(0) + F.when(citations >= 3, 1).otherwise(0) + F.when(limits > 0, 1).otherwise(0) + F.when(steps > 0, 1).otherwise(0)
    return F.when(points >= 5, "high").when(points >= 2, "medium").otherwise("low")


def freshness_of(versions: Column, authorities: Column, archived: Column, requested: Column) -> Column:
    """How current a package is, from its citations' versions (array), authorities (array) and archived count."""
    known = F.array_distinct(F.filter(F.transform(versions, lambda v: F.lower(F.trim(v))), lambda v: ~v.isin("", "unknown")))
    req = F.lower(F.trim(requested))
    asked = ~req.isin("", "unknown")
    project = F.exists(authorities, lambda a: a.isin("current_project", "related_internal_project", "curated_internal_recipe"))
    return (
        F.when((F.size(authorities) == 0) & (F.size(versions) == 0), "unknown")
        .when(archived > 0, "stale")
        .when(asked & (F.size(known) == 0), "unknown")
        .when(F.size(known) > 1, "mixed")
        .when(asked & ~F.array_contains(known, req), "mixed")
        .when(F.size(known) == 1, "version-specific")
        .when(project, "current")
        .otherwise("unknown")
    )


def needs_web(coverage: Column, freshness: Column) -> Column:
    return (coverage == "low") | freshness.isin("stale", "mixed", "unknown")


def tool_class(tool: Column) -> Column:
    t = F.trim(tool)
    return F.coalesce(*[F.when(t.isin(*names), F.lit(k)) for k, names in TOOLS.items()], F.lit("other"))


def normal_coverage(coverage: Column, applicable: Column) -> Column:
    c = F.lower(F.trim(coverage))
    return F.when(~applicable, "not_applicable").when(c.isin("high", "medium", "low"), c).otherwise("unclassified")


def source_estimate(returned: Column, structured: Column, raw: Column) -> Column:
    """Tokens that the sources behind a package would have cost."""
    factor = F.when((raw > structured) & (structured == 0), 2).when((structured > 0) & (raw == 0), 4).otherwise(3)
    return F.when(returned > 0, returned * factor)


def operational_state(status: Column, documents: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    state = (
        F.when(s.isin("", "idle"), "idle")
        .when(s == "running", "running")
        .when(s.isin("ok", "ingested", "text", "unchanged"), "ok")
        .when(s.startswith("partial"), "degraded")
        .when(s.startswith("failed") | s.isin("corrupt", "encrypted", "image-only"), "failed")
        .otherwise("unknown")
    )
    return F.when((state == "idle") & (documents > 0), "ok").otherwise(state)
