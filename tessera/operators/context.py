"""Context packages: a task's recipes, symbols and hits assembled under a token budget, with coverage and freshness.

Retrieval is DataFrames; a package is a few dozen rows, put together on the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code import api_token, includes
from ..functions.ranking import AUTHORITIES
from . import recipes as R
from . import search as S
from . import symbols as Y

#: Fixed values of the budget.
MOST_RESULTS, MOST_EXAMPLES, MOST_EXCERPT, MOST_TOKENS, PER_DOCUMENT = 5, 2, 600, 2500, 2
SOFT_APIS, SOFT_SYMBOLS, MOST_STEPS, RUNES_PER_TOKEN = 8, 6, 40, 4
ROLE_BIAS = {"official_docs": 2.0, "official_example": 2.0, "curated_knowledge": 1.0, "current_project": 1.0}
PROJECT_BIAS = 4.0
RANK = {a: i for i, (a, _) in enumerate(AUTHORITIES)}
UNCOUNTED = ("estimated_tokens", "contribution", "trace")


def clip(text: str, n: int) -> str:
    """At most n characters, cut back to white space within 40, and marked."""
    if len(text) <= n:
        return text
    head = text[:n]
    at = max(head.rfind(" ", n - 40), head.rfind("\n", n - 40))
    return (head[:at] if at > 0 and n > 41 else head) + "…"


def tokens_of(package: dict) -> int:
    """Estimated tokens of the package as compact JSON, diagnostics left out."""
    text = json.dumps({k: v for k, v in package.items() if k not in UNCOUNTED}, ensure_ascii=False, separators=(",", ":"))
    return -(-len(text) // RUNES_PER_TOKEN)


#: What the budget takes away, in order: a field and how many of its entries stay; `clip` and `drop` act on what is left.
CUTS = (
    ("follow_ups", 0), ("conventions", 0), ("apis", 4), ("symbols", 2), ("citations", 3), ("examples", 1), ("pitfalls", 0), ("constraints", 1), ("prerequisites", 0),
    ("examples", "clip"), ("constraints", "clip"), ("apis", 2), ("symbols", 1), ("missing", 0), ("summary", "clip"), ("note", "drop"), ("examples", "drop"), ("constraints", "drop"),
)


def cut_once(package: dict) -> bool:
    """Takes the next thing away; False if nothing is left to take."""
    for name, rule in CUTS:
        value = package.get(name)
        if not value:
            continue
        if isinstance(rule, int) and len(value) > rule:
            value.pop()
            return True
        if rule == "clip":
            if name == "summary":
                if len(value) > 61:
                    package[name] = value[:60] + "…"
                    return True
                continue
            text = value[0]["excerpt"] if isinstance(value[0], dict) else value[0]
            if len(value) == 1 and len(text) > 81:
                short = clip(text, len(text) // 2)
                value[0] = value[0] | {"excerpt": short} if isinstance(value[0], dict) else short
                return True
        if rule == "drop":
            package[name] = type(value)()
            return True
    return False


def trim(package: dict, most: int = MOST_TOKENS) -> dict:
    """The package within the budget, or as near as so many steps come; estimated_tokens is set."""
    if most > 0:  # without a budget the package stays as it is
        package["apis"] = package.get("apis", [])[:SOFT_APIS]
        package["symbols"] = package.get("symbols", [])[:SOFT_SYMBOLS]
    for _ in range(MOST_STEPS):
        if most <= 0 or tokens_of(package) <= most or not cut_once(package):
            break
    package["estimated_tokens"] = tokens_of(package)
    return package


def group_hits(hits: DataFrame, roles: DataFrame, project: str = "", per_root: int = 3, limit: int = 12) -> DataFrame:
    """Hits (qid, chunk_id, root_name, score) of a group: the best of every root and the best overall, roles raising scores.

    roles is (root_name, role), a small dimension.
    """
    bias = F.coalesce(*[F.when(F.col("role") == r, F.lit(b)) for r, b in ROLE_BIAS.items()], F.lit(0.0)) + F.when(F.col("root_name") == project, PROJECT_BIAS).otherwise(0.0)
    h = hits.join(roles, "root_name", "left").withColumn("score", F.col("score") + bias)

    def first(most: int, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
        return h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")  # a limit that is pruned before the shuffle

    return first(per_root, "qid", "root_name").unionByName(first(limit, "qid")).dropDuplicates(["qid", "chunk_id"])


def coverage(p: dict) -> str:
    points = 2 * bool(p["apis"] or p["symbols"]) + 2 * bool(p["examples"]) + (len(p["citations"]) >= 3) + bool(p["constraints"] or p["pitfalls"]) + bool(p["sequence"])
    return "high" if points >= 5 else "medium" if points >= 2 else "low"


def freshness(citations: list[dict], requested: str = "") -> str:
    """How current the citations are."""
    if not citations:
        return "unknown"
    if any(c.get("archived") for c in citations):
        return "stale"
    versions = {v for c in citations if (v := (c.get("version") or "").strip().lower()) not in ("", "unknown")}
    want = requested.strip().lower()
    if len(versions) > 1 or (want not in ("", "unknown") and versions and want not in versions):
        return "mixed"
    if want not in ("", "unknown") and not versions:
        return "unknown"
    if versions:
        return "version-specific"
    return "current" if any(RANK.get(c["authority"], 7) <= 2 for c in citations) else "unknown"


def fingerprint(package: dict) -> str:
    """A digest of what the package says and where it says it from, the same for the same content."""
    payload = {k: package.get(k) for k in ("apis", "sequence", "constraints", "pitfalls", "coverage", "freshness")}
    payload["citations"] = sorted((c["uri"], c.get("section", ""), c.get("hash", "")) for c in package["citations"])
    payload["symbols"] = sorted(s["name"] for s in package["symbols"])
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:32]


def contribution(package: dict, searched: list[str]) -> dict:
    """Which of the searched roots gave citations."""
    per = Counter(c["root"] for c in package["citations"])
    return {"by_root": dict(sorted(per.items())), "contributing": sorted(per), "unused": sorted(set(searched) - set(per))}


def build(spark: SparkSession, task: str, chunks: DataFrame, symbols: DataFrame, recipes: DataFrame, roots: list[str] = (), version: str = "", most_tokens: int = MOST_TOKENS) -> dict:
    """The context package of a task over chunks, symbols and recipes, within roots if any are given."""
    task = S.check_query(task)
    if roots:
        chunks = chunks.where(F.col("root_name").isin(*roots))
    query = spark.createDataFrame([(0, task)], "qid int, query string")
    words = [w for w in dict.fromkeys(task.split()) if api_token(w)][:SOFT_APIS]
    names = spark.createDataFrame(list(enumerate(words)), "qid int, name string")
    found = Y.find(symbols, names, MOST_RESULTS).join(symbols.select("id", "name", "kind"), "id").orderBy("qid", "rank").collect() if words else []
    top = S.search(chunks, query, limit=12, per_document=PER_DOCUMENT, preferred_version=version, semantic=True)
    hits = top.join(chunks.drop("document_id"), "chunk_id").orderBy("rank").collect()  # 12 rows at most
    mine = R.search(recipes, task, roots=list(roots))
    fields = {r.uri: r for r in R.read(mine).collect()}  # five recipes at most
    parsed = [(r, fields[r.uri]) for r in mine.collect()]
    both = lambda name: list(dict.fromkeys(x for _, p in parsed for x in getattr(p, name)))
    citations = [{"uri": h.uri, "root": h.root_name, "title": h.title, "section": h.heading, "authority": h.authority, "version": h.product_version, "archived": h.archived, "hash": hashlib.sha256(h.body.encode()).hexdigest()} for h in hits]
    package = {
        "task": task,
        "summary": parsed[0][0].subject if parsed else (hits[0].title if hits else ""),
        "apis": both("apis") or [w for w in words],
        "includes": list(dict.fromkeys(both("includes") + [i for h in hits for i in includes(h.body)]))[:12],
        "symbols": [{"name": s.name, "kind": s.kind, "match": s.match_type, "confidence": s.confidence} for s in {s.id: s for s in found}.values()],
        "sequence": both("sequence"),
        "constraints": both("constraints"),
        "pitfalls": both("pitfalls"),
        "prerequisites": both("prereqs"),
        "examples": [{"uri": h.uri, "excerpt": clip(h.body, MOST_EXCERPT)} for h in hits if RANK.get(h.authority, 7) <= 3][:MOST_EXAMPLES],
        "citations": list({c["uri"]: c for c in reversed(citations)}.values())[::-1],
        "conventions": [],
        "note": "tokens are estimated at four characters each",
    }
    package["coverage"] = coverage(package)
    package["freshness"] = freshness(package["citations"], version)
    package["missing"] = [m for m, gone in (("No symbols matched the task.", not package["symbols"]), ("The version of the sources is not known.", package["freshness"] == "unknown")) if gone]
    package["follow_ups"] = (["Search the web: local sources don't cover this."] if package["coverage"] == "low" or package["freshness"] in ("stale", "mixed", "unknown") else [])
    trim(package, most_tokens)
    package["fingerprint"] = fingerprint(package)
    package["contribution"] = contribution(package, list(roots) or sorted({h.root_name for h in hits}))
    return package
