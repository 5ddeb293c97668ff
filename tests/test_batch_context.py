"""Context packages of many tasks: the budget against a plain model of its steps, and what goes into a package."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators import batch_context as B
from tessera.operators import recipes

PACKAGE = ", ".join(f"{f} {B.TYPES.get(f, 'array<string>')}" for f in B.FIELDS)


def size(p):
    return -(-len(json.dumps({f: p[f] for f in B.FIELDS}, ensure_ascii=False, separators=(",", ":"))) // 4)


def clipped(text, n):
    if len(text) <= n:
        return text
    head = text[:n]
    at = max(head.rfind(" ", max(n - 40, 0)), head.rfind("\n", max(n - 40, 0)))
    return (head[:at] if n > 41 and at >= 0 else head) + "…"


def trimmed(p, most):
    """The reference behaviour, step by step, over a dict."""
    p = dict(p)
    if most <= 0:
        return p, 0
    p["apis"], p["symbols"] = p["apis"][:8], p["symbols"][:6]
    plain = [("follow_ups", 0), ("conventions", 0), ("apis", 4), ("symbols", 2), ("citations", 3), ("examples", 1), ("pitfalls", 0), ("constraints", 1), ("prerequisites", 0)]
    for n in range(40):
        if size(p) <= most:
            return p, n
        hit = next((f for f, k in plain if len(p[f]) > k), None)
        if hit:
            p[hit] = p[hit][:-1]
        elif len(p["examples"]) == 1 and len(p["examples"][0]["excerpt"].encode()) > 80:
            e = p["examples"][0]
            p["examples"] = [e | {"excerpt": clipped(e["excerpt"], len(e["excerpt"].encode()) // 2)}]
        elif len(p["constraints"]) == 1 and len(p["constraints"][0].encode()) > 80:
            p["constraints"] = [clipped(p["constraints"][0], len(p["constraints"][0].encode()) // 2)]
        elif len(p["apis"]) > 2:
            p["apis"] = p["apis"][:-1]
        elif len(p["symbols"]) > 1:
            p["symbols"] = p["symbols"][:-1]
        elif p["missing"]:
            p["missing"] = p["missing"][:-1]
        elif len(p["summary"]) > 61:
            p["summary"] = p["summary"][:60] + "…"
        elif p["note"]:
            p["note"] = ""
        elif len(p["examples"]) == 1:
            p["examples"] = []
        elif len(p["constraints"]) == 1:
            p["constraints"] = []
        else:
            return p, n
    return p, 40


def test_budget_equals_a_plain_model(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(['say "x"', "plain", "ünï", "a\\b", "tab\there", "line\nbreak", "long" * 6]) for _ in range(n))
    rows = []
    for k in range(120):
        many = lambda most, n: [words(rng.randrange(1, n)) for _ in range(rng.randrange(most))]
        p = {f: many(12, 6) for f in B.FIELDS if B.TYPES.get(f, "array<string>") == "array<string>"}
        p |= {"task": words(4), "summary": words(rng.randrange(30)), "coverage": "low", "freshness": "mixed", "note": B.NOTE}
        p["symbols"] = [{"name": words(1), "kind": "type"} for _ in range(rng.randrange(9))]
        p["examples"] = [{"uri": "u", "title": "t", "excerpt": words(rng.randrange(60))} for _ in range(rng.randrange(3))]
        p["citations"] = [{f: words(1) for f in ("uri", "title", "section", "authority", "root_name", "version")} for _ in range(rng.randrange(6))]
        rows.append((k, rng.choice([0, -5, 100, 200, 400, 900, 5000]), p))
    df = spark.createDataFrame([(k, most, *[p[f] for f in B.FIELDS]) for k, most, p in rows], f"qid int, most int, {PACKAGE}").repartition(4)
    out = B.trimmed(df, "most").select("qid", "cuts", B.tokens_of(F.col).alias("n"), *B.FIELDS)
    got = {r.qid: r.asDict(True) for r in out.collect()}
    for k, most, p in rows:
        want, cuts = trimmed(p, most)
        assert {f: got[k][f] for f in B.FIELDS} == want, (k, most)
        assert (got[k]["cuts"], got[k]["n"]) == (cuts, size(want))


CHUNK = "chunk_id long, uri string, title string, heading string, authority string, root_name string, product_version string, archived boolean, body string"
STEPS_BODY = "These steps must run:\n2) second\n1. first\n- other\n#include <net/retry.h>\n"


def test_packages_of_a_batch(spark):
    chunks = [
        (1, "u1", "One", "Workflow", "official_example", "sdk", "2.1", False, STEPS_BODY + "word " * 300),
        (2, "u2", "Two", "", "current_project", "app", "2.1", None, "An error to avoid, with an example of &lt;b&gt; use"),
        (3, "u1", "One", "Notes", "unverified", "sdk", None, False, "<p>plain</p> text"),
        (4, "u4", "Four", None, "official_docs", "sdk", "1.0", True, None),
    ]
    tasks = [(10, " use RetryPolicy::run ", "2.1", None), (11, "nothing known", "", None), (12, "old things", "", 90), (13, None, None, None)]
    hits = [(10, 1, 1), (10, 2, 2), (10, 3, 3), (12, 1, 4), (12, 2, 2), (99, 1, 1)]
    body = "## Required APIs\n- `Client.Connect`\n## Steps\n1. Open\n2. Run\n## Example\nthe code"
    made = recipes.read(spark.createDataFrame([("12", body)], "uri string, body string")).withColumn("qid", F.col("uri").cast("int")).withColumn("subject", F.lit("Old"))
    args = (
        spark.createDataFrame(tasks, "qid int, task string, version string, most_tokens int"),
        spark.createDataFrame(hits, "qid int, rank int, chunk_id long"),
        spark.createDataFrame(chunks, CHUNK),
        spark.createDataFrame([(10, 2, "RetryPolicy", "type"), (10, 1, "run", "method")], "qid int, place int, name string, kind string"),
        made,
    )
    out = {r.qid: r for r in B.assembled(*args).collect()}
    assert set(out) == {10, 11, 12, 13}
    a = out[10]
    assert a.task == "use RetryPolicy::run" and a.summary == "One" and a.apis == ["run", "RetryPolicy", "RetryPolicy::run"] and [s.name for s in a.symbols] == ["run", "RetryPolicy"]
    assert a.sequence == ["second", "first", "other"] and a.includes == ["#include <net/retry.h>"]
    assert [e.uri for e in a.examples] == ["u1", "u2"] and a.examples[0].excerpt.endswith("word…") and len(a.examples[0].excerpt) <= 601
    assert len(a.constraints) == 1 and a.constraints[0].startswith("These steps must") and len(a.pitfalls) == 1 and a.conventions == ["An error to avoid, with an example of <b> use"]
    assert [c.uri for c in a.citations] == ["u1", "u2"] and a.roots == ["sdk", "app"] and (a.coverage, a.freshness) == ("high", "version-specific") and a.cuts == 0 and a.estimated_tokens <= 2500
    b = out[11]
    assert (b.coverage, b.freshness, b.summary, b.citations, b.cuts) == ("low", "unknown", "", [], 0) and len(b.missing) == 3 and len(b.follow_ups) == 1
    c = out[12]
    assert c.sequence == ["Open", "Run"] and c.summary == "Old" and c.freshness == "stale" and c.cuts > 0 and c.follow_ups == [] and c.pitfalls == []
    assert out[13].task is None and out[13].coverage == "low"
    again = {r.qid: r.fingerprint for r in B.assembled(*args).collect()}
    assert all(again[k] == out[k].fingerprint for k in out) and len(set(again.values())) == 4
    plain = B.assembled(*args[:3]).where("qid = 10").first()
    assert plain.apis == ["RetryPolicy::run"] and plain.symbols == []
    assert B.assembled(args[0].limit(0), *args[1:]).collect() == []
