import os
import datetime
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import excerpts
from tessera.operators import catalog, chunking, context, corpus, evaluate, index, ingest, mutate, packages, playbook, recipes, scope, search, select, symbols, usage
from tessera.sources import files, pdf
from tessera.sources import tables as T
from tessera.sources.shared import Versions
from tessera.streaming import events


@pytest.mark.parametrize("limit,pool", [(1, 250), (20, 500), (100, 1500), (0, 500)])
def test_candidate_pool(limit, pool):
    assert search.pool_size(limit) == pool


def test_limits_and_queries():
    assert [search.clamp_limit(0), search.clamp_limit(500), search.clamp_limit(50, 30), search.clamp_limit(-1, 5)] == [20, 100, 30, 5]
    for bad in ("  ", "x" * 513, "a " * 65):
        with pytest.raises(ValueError):
            search.check_query(bad)


def corpus_of(spark, rows):
    """Chunks (id, document, root, authority, heading, body)."""
    made = [(i, d, r, f"T{d}", h, b, f"{r}/{i}.md", f"project://{r}/{i}.md", a, "en", "1.0", False, False, 0) for i, d, r, a, h, b in rows]
    return spark.createDataFrame(made, "chunk_id long, document_id long, root_name string, title string, heading string, body string, path string, uri string, authority string, language string, product_version string, deprecated boolean, archived boolean, ordinal int")


def q(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, query string")


def test_rare_terms_beat_common_ones(spark):
    rows = [(i, i, "sdk", "unknown", "", f"common words about setup number {i}") for i in range(40)] + [(99, 99, "sdk", "unknown", "", "common retrypolicy backoff")]
    got = search.semantic_candidates(corpus_of(spark, rows), q(spark, "common retrypolicy"), 5).collect()
    assert got[0].chunk_id == 99


def test_authority_comes_before_names(spark):
    rows = [(1, 1, "p", "current_project", "", "retry policy here"), (2, 2, "d", "official_documentation", "retry", "retry policy retry policy"), (3, 3, "x", "third_party_reference", "retry policy", "retry policy")]
    got = search.search(corpus_of(spark, rows), q(spark, "retry policy")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 2, 3]


def test_documents_are_diversified(spark):
    rows = [(i, i // 5, "p", "unknown", "", "needle in hay") for i in range(20)]
    got = search.search(corpus_of(spark, rows), q(spark, "needle"), limit=7, per_document=2).collect()
    assert len(got) == 7 and max(sum(r.document_id == d for r in got) for d in range(4)) == 2
    assert search.search(corpus_of(spark, rows), q(spark, "needle"), limit=7, per_document=-1).count() == 7


def test_search_retries_with_some_words(spark):
    """A query that no chunk answers in full takes chunks with some content word; one that a chunk answers does not."""
    c = corpus_of(spark, [(1, 1, "p", "unknown", "", "retry policy here"), (2, 2, "p", "unknown", "", "backoff only"), (3, 3, "p", "unknown", "", "how is the rest")])
    got = search.search(c, q(spark, "how is the retry policy with backoff", "how is the retry policy", "nothing alike"))
    assert sorted((r.qid, r.chunk_id) for r in got.collect()) == [(0, 1), (0, 2), (1, 1)]


def test_search_prefers_the_version_and_drops_the_deprecated(spark):
    c = corpus_of(spark, [(1, 1, "p", "unknown", "", "needle"), (2, 2, "p", "unknown", "", "needle")])
    c = c.withColumn("product_version", F.when(F.col("chunk_id") == 2, "2.0").otherwise("1.0"))
    assert [r.chunk_id for r in search.search(c, q(spark, "needle"), preferred_version="2.0").orderBy("rank").collect()] == [2, 1]
    c = c.withColumn("deprecated", F.col("chunk_id") == 2)
    assert [r.chunk_id for r in search.search(c, q(spark, "needle")).orderBy("rank").collect()] == [1, 2]


def test_symbols_in_stages(spark):
    s = spark.createDataFrame([(1, "dev::Bus::open", "method", "unknown", 3), (2, "open", "function", "unknown", 1), (3, "openFile", "function", "unknown", 9), (4, "reopen", "function", "unknown", 2), (5, "xopeny", "call", "unknown", 2), (6, "opne", "function", "unknown", 5)], "id int, name string, kind string, authority string, start_line int")
    n = spark.createDataFrame([(1, "open"), (2, "dev::Bus::open")], "qid int, name string")
    got = {(r.qid, r.id): (r.rank, r.match_type) for r in symbols.find(s, n).collect()}
    assert got[(1, 2)] == (1, "exact") and got[(1, 1)][1] == "exact_unqualified" and got[(1, 3)][1] == "prefix" and got[(1, 4)][1] == "suffix" and got[(1, 5)][1] == "token"
    assert got[(2, 1)] == (1, "exact_qualified") and got[(2, 2)][1] == "exact_unqualified"
    assert (1, 6) not in got  # no three bytes in common
    typo = spark.createDataFrame([(1, "openFule")], "qid int, name string")
    assert [(r.id, r.match_type, r.confidence) for r in symbols.find(s, typo).where("match_type = 'fuzzy'").collect()] == [(3, "fuzzy", 0.35)]


def test_usage_reconciles(spark):
    rows = [(1, "grounded_local", "high", False, 1000), (2, "root_selection_required", None, True, 0), (3, "no_local_match", None, False, 0), (4, "request_error", None, False, 0)]
    r = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, i), s, c, f, t, 0, 0, 0, 0) for i, s, c, f, t in rows], "request_id long, occurred_at timestamp, result_status string, coverage string, root_selection_required boolean, returned_tokens long, curated_count long, recipe_count long, symbol_count long, citation_count long")
    s = usage.summary(r).first()
    assert (s.total, s.grounded, s.root_selection, s.no_match, s.errors, s.tokens_served, s.reconcile_ok) == (4, 1, 1, 1, 1, 1000, True)
    assert s.local_evidence_rate == 0.25 and s.unclassified == 0
    assert usage.where(r, datetime.datetime(2024, 1, 1, 2), datetime.datetime(2024, 1, 1, 3)).count() == 2


def test_upsert_skips_the_unchanged(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "uri string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("d", "1")], "uri string, hash string")
    assert sorted((r.uri, r.hash, r.written) for r in corpus.upsert(old, new).collect()) == [("a", "1", False), ("b", "2", True), ("c", "1", False), ("d", "1", True)]


def test_pages_are_pruned_after_two_absences(spark):
    state = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", 1, 1)], "url string, generation int, missing int")
    got = sorted(tuple(r) for r in corpus.advance(state, spark.createDataFrame([("c",), ("d",)], "url string"), 2).collect())
    assert got == [("a", 1, 1), ("c", 2, 0), ("d", 2, 0)]


def test_diff_lines(spark):
    lines = spark.createDataFrame([("A\tx",), ("M\ty",), ("T\tt",), ("D\tz",), ("R100\told\tnew",)], "line string")
    assert sorted(tuple(r) for r in corpus.diff_lines(lines).collect()) == [("new", "added"), ("old", "deleted"), ("t", "modified"), ("x", "added"), ("y", "modified"), ("z", "deleted")]


def test_percentiles_do_not_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    assert corpus.percentile_floor(df, "v", 0.95).first().p == 3.0 and corpus.percentile_floor(df, "v", 0.5).first().p == 2.0


def brute_chunks(lines, most):
    out, start, size = [], 1, 0
    for i, line in enumerate(lines, 1):
        b = len(line.encode()) + 1
        if size and size + b > most:
            out.append((start, i - 1))
            start, size = i, 0
        size += b
        if line == "" and size >= most // 2:
            out.append((start, i))
            start, size = i + 1, 0
    return out + ([(start, len(lines))] if start <= len(lines) else [])


def test_chunks_are_bounded(spark):
    import random

    rng = random.Random(1)
    texts = ["\n".join("é" * rng.choice([0, 0, 5, 30, 90]) for _ in range(rng.choice([1, 5, 40]))) for _ in range(60)] + ["", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.chunk(df, most=100).orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append((r.start_line, r.end_line))
        assert r.body == "\n".join(texts[r.id].split("\n")[r.start_line - 1 : r.end_line])
    assert got == {i: brute_chunks(t.split("\n"), 100) for i, t in enumerate(texts)}


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# One #\na\n## Two\nb\n#no\n####### seven")], "id int, text string")
    got = sorted((r.section, r.heading, r.start_line, r.n_lines) for r in chunking.sections(df, "id").collect())
    assert got == [(0, "", 1, 1), (1, "One", 2, 2), (2, "Two", 4, 4)]


# ---------------------------------------------------------------- packages, scope, recipes


TABLE = """intro
| ID | Name | Source Paths | Artifact IDs | Doc Status |
| --- | :--- | --- | --- | --- |
| c1 | Bus | src/a; src/b | `x1` | verified |
| c2 | Pin | - | | draft |

| not a table |
"""


def test_pipe_tables_and_front_matter():
    rows = packages.inventory_rows(TABLE)
    assert [(r["id"], r["source_paths"], r["artifact_ids"], r["doc_status"]) for r in rows] == [("c1", ["src/a", "src/b"], ["x1"], "verified"), ("c2", [], [], "draft")]
    fields, body = packages.front_matter("---\nstatus: verified\nevidence: e2 tested\n---\n# T\n")
    assert fields["status"] == "verified" and body == "# T\n" and packages.evidence_level(fields["evidence"]) == "E2"
    assert packages.front_matter("---\n: [\n---\nx") == ({}, "---\n: [\n---\nx")
    assert packages.problems([{"id": "a", "folder": "../x"}, {"id": "a"}], "id") == ["unsafe path ../x", "duplicate id a"]


def test_metadata_precedence(spark):
    fs = spark.createDataFrame([("lib/bus/a.md",), ("lib/pin.md",), ("other.md",)], "path string")
    comps = spark.createDataFrame([(0, "c0", "Lib", "L1", "lib", "draft"), (1, "c1", "Bus", "L2", "lib/bus/", "verified")], "pos int, id string, name string, level string, folder string, doc_status string")
    ix = spark.createDataFrame([("other.md", "i1", "Other", "L3", "inferred"), ("lib/pin.md", "i2", "Pin", "L9", "x")], "path string, id string, component string, level string, status string")
    fm = spark.createDataFrame([("lib/pin.md", "deprecated")], "path string, status string")
    got = {r.path: (r.id, r.component, r.level, r.status) for r in packages.enrich(fs, comps, ix, fm).collect()}
    assert got == {"lib/bus/a.md": ("c1", "Lib", "L1", "draft"), "lib/pin.md": ("c0", "Lib", "L1", "deprecated"), "other.md": ("i1", "Other", "L3", "inferred")}
    arts = spark.createDataFrame([("x1",)], "id string")
    named = spark.createDataFrame([("c1", ["x1", "x2"])], "id string, artifact_ids array<string>")
    assert [tuple(r) for r in packages.unregistered(named, arts).collect()] == [("c1", "x2")]
    assert packages.unregistered(named, arts.limit(0)).count() == 0


def scope_tables(spark, here, members=(), policies=None):
    groups = spark.createDataFrame([("g", "The group", json.dumps(policies) if policies is not None else "{}")], "id string, name string, policies string")
    m = [("The group", r, role, p) for r, role, p in members]
    return groups, spark.createDataFrame(m, "group_name string, root_name string, role string, priority int"), spark.createDataFrame([(r,) for r in here], "root_name string")


MEMBERS = [("docs", "official_documentation", 0), ("app", "current_project", 0), ("rel1", "related_project", 5), ("rel2", "related_project", 9), ("gone", "official_documentation", 7)]
ALLOWED = {"allowCrossRootRetrieval": True, "preferCurrentProjectWhenSpecified": True}


def test_group_expansion(spark):
    def expand(policies=None, members=MEMBERS, group="G", **ask):
        groups, m, here = scope_tables(spark, ["docs", "app", "rel1", "rel2", "else"], members, policies)
        row = (1, group, ask.get("preferred"), ask.get("project"), ask.get("only"))
        [r] = scope.expand(spark.createDataFrame([row], "ask_id int, group string, preferred array<string>, project string, only_preferred boolean"), groups, m, here).collect()
        return r.reason or r.roots

    assert expand() == ["app", "docs", "rel2", "rel1"]  # by default related projects come, greater priority first
    assert expand(ALLOWED) == ["app", "docs"]
    assert expand({**ALLOWED, "includeRelatedProjectsForPatterns": True, "maxRelatedProjects": 1}, group=" the GROUP ") == ["app", "docs", "rel2"]
    assert expand({**ALLOWED, "includeRelatedProjectsForPatterns": True, "maxRelatedProjects": -1}) == ["app", "docs"]
    assert expand(ALLOWED, preferred=[" rel1", None, "else"]) == ["app", "docs", "rel1"]
    assert expand(ALLOWED, project="rel2") == ["app", "docs", "rel2"]
    assert expand({"allowCrossRootRetrieval": True}, project="rel2") == ["app", "docs"]
    assert expand(ALLOWED, preferred=["rel1"], only=True, project="app") == ["app", "rel1"]
    assert expand(ALLOWED, preferred=["else"], only=True) == ["app", "docs"]
    assert expand(ALLOWED, members=[("rel1", "?", 1), ("docs", None, 2)]) == ["docs", "rel1"]  # no role counts: all that are there
    assert expand(ALLOWED, members=[("gone", "official_documentation", 1)]) == "no_members"
    assert expand({"allowCrossRootRetrieval": False}) == "forbidden" and expand(group="h") == "unknown_group" and expand(group=None) == "unknown_group"


def test_policies_of_broken_text(spark):
    texts = [None, " ", "{}", '{"allow', "[]", '{"maxRelatedProjects": "x"}', "null", '{"maxRelatedProjects": 7}', '{"allowCrossRootRetrieval": true, "more": 1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scope.policies(F.col("t")).alias("p")).collect()
    got = [tuple(r.p) for r in rows]
    assert got == [(True, True, True, 3)] * 6 + [(False, False, False, 0), (False, False, False, 7), (True, False, False, 0)]


def test_roots_are_resolved(spark):
    cues = spark.createDataFrame([("retry", "net", 80), ("pin", "dev", 40), ("p", "gone", 9), ("", "net", 9)], "cue string, root string, weight int")

    def resolve(here, *asks, members=(), policies=None):
        groups, m, roots = scope_tables(spark, here, members, policies)
        rows = [(i, q, e) for i, (q, e) in enumerate(asks)]
        out = scope.resolve(spark.createDataFrame(rows, "request_id int, query string, explicit array<string>"), roots, cues, groups, m).orderBy("request_id").collect()
        assert len(out) == len(asks)
        return [(r.reason, r.roots, r.group, r.detail, r.hints) for r in out]

    got = resolve(["net", "dev"], ("Retry with a pin", None), ("the DEV pin", [" "]), ("p", []), ("x", ["dev", "zz", "yy"]), ("x", [" dev ", "dev"]), (None, None), ("x", ["net", "dev"]))
    assert got == [
        (None, ["net"], None, None, ["p", "pin", "retry"]),
        (None, ["dev"], None, None, ["p", "pin", "root:dev"]),
        ("not_inferred", [], None, None, ["p"]),
        ("unknown_root", [], None, "zz", []),
        (None, ["dev"], None, None, ["explicit rootName"]),
        ("not_inferred", [], None, None, []),
        ("several_families", ["dev", "net"], None, None, ["explicit rootName"]),
    ]
    assert resolve(["only"], ("x", None)) == [(None, ["only"], None, None, ["only one root in database"])]
    assert resolve([], ("x", None), ("x", ["a"])) == [("no_roots", [], None, None, []), ("unknown_root", [], None, "a", [])]
    here = ["docs", "app", "else"]
    assert resolve(here, ("x", ["docs", "else"]), members=MEMBERS)[0][:3] == (None, ["app", "docs"], "g")
    assert resolve(here, ("x", ["docs", "app"]), members=MEMBERS, policies={"maxRelatedProjects": 1})[0][:2] == ("forbidden", ["app", "docs"])
    assert resolve(["demo-http-a", "example-http-b"], ("x", ["demo-http-a", "example-http-b"]))[0][:2] == (None, ["demo-http-a", "example-http-b"])
    assert resolve(["tile-sdk", "tile-app", "tile"], ("x", ["tile-sdk", "tile-app"]), ("x", ["tile-sdk", "tile"])) == [(None, ["tile-app", "tile-sdk"], None, None, ["explicit rootName"]), ("several_families", ["tile", "tile-sdk"], None, None, ["explicit rootName"])]


def test_groups_of_a_configuration(spark):
    groups, members = scope.from_config(spark, {"groups": [{"id": "g", "members": [{"rootName": "a", "role": "official_documentation"}, {"rootName": "b"}], "policies": {"maxRelatedProjects": 4}}]})
    assert groups.select(scope.policies(F.col("policies"))["maxRelatedProjects"]).collect() == [(4,)]
    assert sorted(map(tuple, members.collect())) == [("g", "a", "official_documentation", 0), ("g", "b", "related_project", 0)]


RECIPE = "# Retry\nintro\n## Required APIs\n- `RetryPolicy`\n## Steps\n1. Create it\n2. Use it\n## Pitfalls\n* Do not block\n## Cleanup\n- close\n## Example\ncode\n## Version\n2.1\n"


def test_recipes(spark):
    r = recipes.read(spark.createDataFrame([("u", RECIPE)], "uri string, body string")).first()
    assert r.apis[0] == "RetryPolicy" and r.sequence == ["Create it", "Use it", "Cleanup: close"] and r.pitfalls == ["Do not block"] and r.version == "2.1" and r.examples == ["code"]
    df = spark.createDataFrame([("u1", "Retry", "net", "go", RECIPE, "generated", "generated_summary", "sdk", 1), ("u2", "retry too", "net", "go", "x", "human_reviewed", "curated_internal_recipe", "sdk", 0)], "uri string, subject string, technology string, language string, body string, review_status string, authority string, root_name string, created_at int")
    assert [x.uri for x in recipes.search(df, "RETRY").collect()] == ["u2", "u1"]
    assert recipes.search(df, "retry", language="py").count() == 0
    up = recipes.upsert(df, df.where("uri = 'u1'").withColumn("authority", F.lit("curated_internal_recipe")))
    assert up.where("uri = 'u1'").first().authority == "generated_summary"
    assert recipes.review(df, "u1", "human_reviewed").where("uri = 'u1'").first().authority == "curated_internal_recipe"


def test_recipe_sections(spark):
    kinds = {
        "Cleanup steps": "cleanup", "Cleanup requirements": "cleanup", "Required includes": "includes", "Required headers": "includes", "Required prerequisites": "prereqs", "Requirements": "prereqs",
        "API requirements": "apis", "Required APIs": "apis", "API reference": "apis", "Functions": "apis", "Initialization order": "sequence", "Init functions": "body", "Workflow": "sequence",
        "Known constraints": "constraints", "You must not": "constraints", "Common errors": "pitfalls", "Known pitfalls": "pitfalls", "Sample": "examples", "Version": "version", "Miscellaneous notes": "body", " ": "body",
    }
    df = spark.createDataFrame(list(kinds.items()), "title string, kind string")
    assert [r.title for r in df.where(recipes.section_kind(F.col("title")) != F.col("kind")).collect()] == []


def test_recipe_lineage(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), (None, "a"), ("e", "c"), ("f", "c")]
    df = lambda rs: spark.createDataFrame(rs, "uri string, replaces string")
    got = {r.uri: (r.origin, r.steps) for r in recipes.lineage(df(rows)).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("gone", 1), "e": ("a", 3), "f": ("a", 3)}
    for circle in ([("x", "x")], [("x", "y"), ("y", "x"), ("z", "x"), ("w", None)]):
        with pytest.raises(ValueError):
            recipes.lineage(df(circle))
    assert recipes.lineage(df([])).collect() == []


MADE = """intro 1. not in a section
# Demo
## Required prerequisites ##
- SDK installed
 * indented
-not an item
## Required APIs
use `demo::Register` and `not an api` or `Client.Connect`
- `demo::Register`
#### no heading
- `Other`
## Required headers
```c
#include "demo/api.h"
# Not a heading
- not an item
```
- demo.h
import demo
## Initialization sequence
- bullets come second
2) Call Connect
1. Call Register\r
10.no item
## Cleanup
- close
## Steps
+ again
# Example
~~~
- code
~~~
## Version

  2.1  
more
"""


def test_recipes_are_read_by_their_lines(spark):
    rows = [("made", MADE), ("none", None), ("empty", ""), ("loose", "First initialize:\n1. one\n 2) two\n- three"), ("silent", "1. one\n2. two"), ("long", "## Example\n" + "word " * 300)]
    got = {r.uri: r for r in recipes.read(spark.createDataFrame(rows, "uri string, body string").repartition(3)).collect()}
    m = got["made"]
    assert m.prereqs == ["SDK installed", "indented"] and m.apis == ["demo::Register", "Client.Connect", "Other"]
    assert m.includes == ["demo.h", '#include "demo/api.h"', "import demo"]
    assert m.sequence == ["Call Connect", "Call Register", "bullets come second", "Cleanup: close", "again"] and m.cleanup == ["close"]
    assert m.examples == ["~~~\n- code\n~~~"] and m.version == "2.1"
    for k in ("none", "empty"):
        assert not any(getattr(got[k], f) for f in ("apis", "includes", "prereqs", "sequence", "cleanup", "constraints", "pitfalls", "examples", "version"))
    assert got["loose"].sequence == ["one", "two"] and got["silent"].sequence == []
    assert got["long"].examples[0].endswith("word…") and 560 <= len(got["long"].examples[0]) <= 601


def test_context_packages(spark):
    rows = [(i, i, "sdk", "official_example" if i % 2 else "current_project", "Retry", f"use RetryPolicy to retry number {i} " * 20) for i in range(8)]
    syms = spark.createDataFrame([(1, "RetryPolicy", "type", "current_project", 1)], "id int, name string, kind string, authority string, start_line int")
    recs = spark.createDataFrame([("u1", "RetryPolicy", "net", "go", RECIPE, "human_reviewed", "curated_internal_recipe", "sdk", 1)], "uri string, subject string, technology string, language string, body string, review_status string, authority string, root_name string, created_at int")
    c = corpus_of(spark, rows)
    p = context.build(spark, "RetryPolicy", c, syms, recs, roots=["sdk"])
    assert p["symbols"][0]["name"] == "RetryPolicy" and p["coverage"] == "high" and p["estimated_tokens"] <= 2500 and p["freshness"] == "version-specific"
    assert p["fingerprint"] == context.build(spark, "RetryPolicy", c, syms, recs, roots=["sdk"])["fingerprint"]
    assert p["contribution"]["contributing"] == ["sdk"]
    small = context.build(spark, "RetryPolicy", c, syms, recs, most_tokens=300)
    assert small["estimated_tokens"] <= 300 < p["estimated_tokens"]


def test_calls_are_told_from_prose(spark):
    lines = {"RetryPolicy in prose": False, "RetryPolicy(1)": True, "Client.Connect (host)": True, "ns::Open(": True, "f_open(path)": True, "Foo": False, "a (b)": False, "open(x)": False, "x = OSChangePrio(3)": True}
    df = spark.createDataFrame(list(lines.items()), "line string, call boolean")
    assert [r.line for r in df.where(excerpts.holds_call(F.col("line")) != F.col("call")).collect()] == []
    score = {r.line: r.s for r in df.select("line", excerpts.line_score(F.col("line"), F.array().cast("array<string>")).alias("s")).collect()}
    assert score["RetryPolicy in prose"] == 0 and score["Client.Connect (host)"] == 6
    body = "#include <a/b.h>\n  #include\n# include \n#include <string>&lt;&amp;quot;&gt; <b>bold</b> a <b_c> d ![x](y)\r\n\n\n\nend"
    got = spark.createDataFrame([(body,)], "t string").select(excerpts.clean_body(F.col("t")).alias("c")).first().c
    assert got == '#include <a/b.h>\n/* #include … */\n#include <string><"> bold a <b_c> d \n\nend'


def test_packages_without_a_budget_stay():
    p = context.trim({"apis": list("abcdefghijkl"), "symbols": list("abcdefgh")}, 0)
    assert len(p["apis"]) == 12 and len(p["symbols"]) == 8


def test_playbooks(spark):
    s = spark.createDataFrame([(1, "the RetryPolicy setup")], "qid int, subject string")
    assert [r.query for r in playbook.queries(s).orderBy("part").collect()][3:] == ["RetryPolicy", "setup"]
    t = spark.createDataFrame([(1, "RetryPolicy(x); make_call(1) make_call (2) TestThing() printf(3) prose of OtherThing and snake_case", "sample"), (1, "OtherThing ()", "guide")], "qid int, text string, kind string")
    assert [(r.api, r.n) for r in playbook.frequent_apis(t, s).orderBy("rank").collect()] == [("RetryPolicy", 9), ("make_call", 6), ("OtherThing", 1)]
    hits = spark.createDataFrame([(1, 1, 2.0, 8.0), (1, 1, 9.0, 1.0), (1, 2, 1.0, 8.0)], "qid int, chunk_id long, score double, weight double")
    c = corpus_of(spark, [(1, 1, "a", "unknown", "", ""), (2, 2, "setup", "unknown", "", "")])
    assert [r.chunk_id for r in playbook.recall(hits, s, c).orderBy("rank").collect()] == [2, 1]
    assert "| a\\|b | p |" in playbook.render("S", [{"title": "a|b", "path": "p"}], ["X"], ["do"])


def test_evaluation(spark):
    tasks = spark.createDataFrame([(1, ["A"], ["x.md"], ["Bad"]), (2, ["B"], ["y.md", "z.md"], [])], "id int, expected_symbols array<string>, expected_sources array<string>, forbidden_symbols array<string>")
    res = spark.createDataFrame([(1, ["a", "b"], ["project://s/x.md"], 100), (2, ["q", "b"], ["project://s/z.md"], 50)], "id int, symbols array<string>, sources array<string>, tokens int")
    m = evaluate.metrics(evaluate.judge(res, tasks)).first()
    assert (m.top1_recall, m.top3_recall, round(m.source_recall, 4), m.forbidden_hits, m.avg_tokens) == (0.5, 1.0, 0.6667, 0, 75.0)


def pdf_bytes(*pages):
    out, n = b"%PDF-1.4\n", 1
    for t in pages:
        stream = zlib.compress(b"BT (" + t.encode("cp1252") + b") Tj ET")
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (n, n + 1)
        out += b"%d 0 obj << /Filter /FlateDecode /Length %d >> stream\n" % (n + 1, len(stream)) + stream + b"\nendstream endobj\n"
        n += 2
    return out + b"%%EOF"


def test_pdf_kinds(spark):
    long = "A page with quite enough text to count (really) as text."
    made = {"t.pdf": pdf_bytes(long.replace("(", "\\(").replace(")", "\\)")), "i.pdf": pdf_bytes(""), "m.pdf": pdf_bytes("x" * 50, ""), "e.pdf": b"%PDF-1.4 /Encrypt", "c.pdf": b"nothing"}
    pages = pdf.extract(spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary"))
    assert {r.path: r.kind for r in pdf.inspect(pages).collect()} == {"t.pdf": "text", "i.pdf": "image-only", "m.pdf": "mixed", "e.pdf": "encrypted", "c.pdf": "corrupt"}
    assert pages.where("path = 't.pdf'").first().text == long


def brute_parts(body, most):
    out, held, size = [], [], 0
    for line in body.split("\n"):
        n = len(line.encode()) + 1
        if size and size + n > most:
            out, held, size = [*out, "\n".join(held)], [], 0
        held, size = [*held, line], size + n
        if size >= most:
            out, held, size = [*out, "\n".join(held)], [], 0
    return [*out, "\n".join(held)] if held else out


def test_pdf_parts_by_brute_force(spark):
    import random

    rng = random.Random(3)
    bodies = ["", "  ", "short"] + ["\n".join("é" * rng.randrange(0, 60) + "x" for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(bodies)), "section int, body string")
    got = {}
    for r in pdf.chunks(df, 200).orderBy("section", "ordinal").collect():
        got.setdefault(r.section, []).append(r.part)
    for i, b in enumerate(bodies):
        want = [] if not b.strip() else [b.strip()] if len(b.strip().encode()) <= 200 else brute_parts(b.strip(), 200)
        assert got.get(i, []) == want


def test_package_filters_and_artifacts(spark):
    rows = [("LibraryDocs/a.md", "", "project", "verified"), ("x/librarydocs/b.md", "", None, None), ("c.md", "curated_note", None, None), ("d.md", "other", None, None), ("e.md", None, "unit", "draft")]
    hits = spark.createDataFrame(rows, "path string, content_class string, level string, status string")
    paths = lambda **k: [r.path[0] for r in packages.filtered_hits(hits, **k).orderBy("path").collect()]
    assert paths() == ["L", "c", "d", "e", "x"] and paths(only=True) == ["L", "c", "e", "x"] and paths(exclude=True) == ["d"]
    assert paths(level=" Project ") == ["L"] and paths(status="draft", only=True) == ["e"]
    f = spark.createDataFrame([("a", ""), ("b", "own"), ("c", None)], "path string, component string")
    a = spark.createDataFrame([("i2", "a", "k2"), ("i1", "a", "k1"), ("i3", "b", "k3")], "id string, file string, component string")
    assert sorted((r.path, r.component, r.artifact_ids) for r in packages.with_artifacts(f, a).collect()) == [("a", "k1", ["i1", "i2"]), ("b", "own", ["i3"]), ("c", "", [])]


def test_ingest_end_to_end(spark, tmp_path):
    src, out = tmp_path / "src", f"file://{tmp_path}/out"
    src.mkdir()
    (src / "a.py").write_text("def retry_call():\n    return 1\n")
    (src / "b.md").write_text("# Title\ntext about retries\n")
    docs = lambda: ingest.documents(files.scan(spark, f"file://{src}"), "sdk")
    assert ingest.write(spark, out, docs()) == 2
    assert ingest.write(spark, out, docs()) == 0
    (src / "b.md").write_text("# Title\nnew words entirely\n")
    assert ingest.write(spark, out, docs()) == 1
    assert [(r.name, r.uri) for r in ingest.read(spark, out, "symbols").collect()] == [("retry_call", "project://sdk/a.py")]
    terms = lambda: {r.term for r in ingest.read(spark, out, "terms").collect()}
    assert "entirely" in terms() and "retries" not in terms()
    assert ingest.read(spark, out, "chunks").count() == 2


@pytest.mark.parametrize("left", [b"", b"\x00", b"\x00\x20abc", b"\x00\x03abc"])
def test_a_pointer_cut_short_is_passed_over(spark, tmp_path, left):
    """What a lost writer may leave under the next number: nothing, or a part of a name. Reads and writes go on."""
    out = f"file://{tmp_path}/out"
    docs = lambda text: spark.createDataFrame([("u", "r", "a.md", "t", "", "official_docs", "docs", text[:1], text)], "uri string, root_name string, path string, title string, language string, authority string, class string, hash string, text string")
    assert ingest.write(spark, out, docs("one")) == 1
    (tmp_path / "out" / "versions" / "v2").write_bytes(left)
    assert [r.text for r in ingest.read(spark, out, "documents").collect()] == ["one"]
    assert ingest.write(spark, out, docs("two")) == 1
    assert [r.text for r in ingest.read(spark, out, "documents").collect()] == ["two"]
    versions = Versions(spark, out)
    assert versions.all() == [1, 3]
    late = versions.draft()
    with pytest.raises(FileExistsError):  # a writer that began at the first version
        versions.commit(late, 1)
    assert ingest.write(spark, out, docs("3")) == 1
    assert versions.all() == [3, 4] and not list((tmp_path / "out" / "versions").glob("pending*"))


def test_one_of_many_writers_publishes(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tessera.sources.shared import Pointers

    at = Pointers(spark, f"file://{tmp_path}/p")
    first = at.publish("0" * 32, 0)

    def try_one(k):
        try:
            return at.publish(f"{k:032x}", first)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(try_one, range(1, 17)) if x]
    assert won == [2] and at.whole() == [1, 2]


def test_a_lost_write_changes_nothing(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    made = lambda text: ingest.documents(spark.createDataFrame([("a.md", text, text)], "path string, hash string, text string"), "sdk")
    ingest.write(spark, out, made("first words"))
    before = ingest.read(spark, out, "chunks")
    monkeypatch.setattr(ingest, "derive", lambda docs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.write(spark, out, made("second words"))
    monkeypatch.undo()
    assert [r.body for r in ingest.read(spark, out, "chunks").collect()] == ["first words"] == [r.body for r in before.collect()]
    versions = Versions(spark, out)
    with pytest.raises(FileExistsError):  # another writer was first
        versions.commit(versions.draft(), 0)
    assert ingest.write(spark, out, made("second words")) == 1
    assert [r.body for r in before.collect()] == ["first words"]  # a reader of the old version is not disturbed
    for n in range(3):
        ingest.write(spark, out, made(f"words {n}"))
    assert len(versions.all()) == 2 and ingest.read(spark, out, "documents").count() == 1


# ---------------------------------------------------------------- searches and selection


def test_tokens_of_several_words_are_phrases(spark):
    c = corpus_of(spark, [(1, 1, "p", "unknown", "", "call foo bar now"), (2, 2, "p", "unknown", "", "bar then foo"), (3, 3, "p", "unknown", "foo", "bar")])
    assert [r.chunk_id for r in search.search(c, q(spark, "foo::bar")).collect()] == [1]
    assert {r.chunk_id for r in search.search(c, q(spark, "foo bar")).collect()} == {1, 2, 3}
    hits = index.phrase_hits(index.of(c), spark.createDataFrame([(0, ["foo", "bar"], None), (1, ["bar", "bar"], None)], "pid int, ws array<string>, roots array<string>"))
    assert [(r.pid, r.chunk_id) for r in hits.collect()] == [(0, 1)]


def test_roots_limit_every_kind_of_candidate(spark):
    rows = [(i, i, f"r{i % 3}", "unknown", "", f"needle number {i} wordy{i}") for i in range(12)]
    c = corpus_of(spark, rows)
    asked = spark.createDataFrame([(0, "needle", ["r1"]), (1, "needle", None), (2, "needle", []), (3, "r1/4.md", ["r2"])], "qid int, query string, roots array<string>")
    got = search.search(c, asked, limit=50, semantic=True).collect()
    by = {k: {r.chunk_id for r in got if r.qid == k} for k in range(4)}
    assert by[0] == {1, 4, 7, 10} and by[1] == by[2] == set(range(12)) and not by[3] & {1, 4, 7, 10}
    assert {r.chunk_id for r in search.search(c, q(spark, "R1/4.MD")).collect()} >= {4}
    s = spark.createDataFrame([(1, "open", "function", "unknown", 3, "a"), (2, "open", "function", "unknown", 1, "b")], "id int, name string, kind string, authority string, start_line int, root_name string")
    n = spark.createDataFrame([(1, "open", ["a"]), (2, "open", None), (3, "", None), (4, "x" * 300, None)], "qid int, name string, roots array<string>")
    assert sorted((r.qid, r.id, r["rank"]) for r in symbols.find(s, n).collect()) == [(1, 1, 1), (2, 1, 2), (2, 2, 1)]


def test_lines_are_scored_once_a_text(spark, sf):
    from tessera.plans import selection

    plan = selection.telling_lines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 8  # two patterns where lines are scored, and where a window begins with a long line


def test_symbols_of_one_name_are_cut_before_they_meet(spark):
    """Many symbols of few names, all of them looked up: each ranking is as from all pairs, which aren't made."""
    rows = [(i, ["Ns::Open", "Open", "OpenAll", "Ns::Opem"][i % 4], "function", "unknown", 1000 - i // 4 % 7) for i in range(400)]
    s = spark.createDataFrame(rows, "id int, name string, kind string, authority string, start_line int")
    n = spark.createDataFrame([(0, "Ns::Open"), (1, "open"), (2, "Open()"), (3, "opem")], "qid int, name string")
    got = sorted((r.qid, r["rank"], r.id, r.match_type) for r in symbols.find(s, n, 5).collect())
    of = lambda name: [i for _, i in sorted((r[4], r[0]) for r in rows if r[1] == name)]
    assert [(k, i) for q, k, i, _ in got if q == 0] == list(enumerate(of("Ns::Open")[:5], 1))
    assert [(k, i) for q, k, i, _ in got if q == 1] == list(enumerate(of("Open")[:5], 1))
    assert [(k, i) for q, k, i, _ in got if q == 3] == list(enumerate(of("Ns::Opem")[:5], 1))
    assert "before" in plan_of(symbols.find(s, n, 5)) and len([g for g in got if g[0] == 2]) == 5


def test_stored_tables_are_made_when_asked_for(spark, tmp_path):
    """Phrases and words need no term vectors; a word that many queries ask for is read once a chunk."""
    c = corpus_of(spark, [(i, i // 2, f"r{i % 3}", "unknown", f"Heading {i % 4}", f"needle of two words {i} " + "of needle " * (i % 5)) for i in range(30)])
    ix = index.Stored(c, f"{tmp_path}/ix")
    phrases = spark.createDataFrame([(k, ["needle", "of", "needle"], None) for k in range(50)], "pid int, ws array<string>, roots array<string>")
    got = {(r.pid, r.chunk_id) for r in index.phrase_hits(ix, phrases).collect()}
    assert got == {(k, i) for k in range(50) for i in range(30) if i % 5 >= 2}
    assert sorted(os.listdir(f"{tmp_path}/ix")) == ["lengths", "occurrences"]
    asked = q(spark, *["needle heading"] * 20)
    every = sorted(map(str, index.bm25(ix, asked).collect()))
    assert len(every) == 600 and every == sorted(map(str, index.bm25(c, asked).collect()))
    assert sorted(os.listdir(f"{tmp_path}/ix")) == ["lengths", "occurrences", "word_frequency"]
    words = asked.select(F.explode(F.split("query", " ")).alias("word"))
    assert index.by_chunk(ix, words, 40).count() == 60


def test_stored_index_gives_the_same(spark, tmp_path):
    c = corpus_of(spark, [(i, i // 2, f"r{i % 3}", "unknown", f"Heading {i % 4}", f"needle retryPolicy {i} " + "common words " * (i % 5)) for i in range(30)])
    ix = index.write(c, f"file://{tmp_path}/ix")
    asked = q(spark, "needle heading", "retry policy", "r1/4.md", "common_words nothing")
    run = lambda x: sorted(map(str, search.search(x, asked, semantic=True).collect()))
    assert run(c) == run(ix) == run(index.read(spark, f"file://{tmp_path}/ix"))
    plan = plan_of(index.looked_up(ix.occurrences, asked.select(F.explode(F.split("query", " ")).alias("word")), "word"))
    assert "bucket" in plan and "NestedLoop" not in plan


def test_snippets_mark_words(spark):
    body = " ".join(f"w{i}" for i in range(100)) + " the Needle, here"
    c = corpus_of(spark, [(1, 1, "p", "unknown", "", body)])
    got = search.snippets(c, spark.createDataFrame([(0, 1)], "qid int, chunk_id long"), q(spark, "needle")).first().snippet
    assert got.startswith("… ") and "<b>Needle,</b> here" in got and len(got.replace("… ", "").split()) == 32


def test_harvest_and_marks(spark):
    is_api = lambda t: t.rlike("[a-z][A-Z]|_|::")
    hits = spark.createDataFrame([(0, 1, "How retryPolicy works", "see <b>open_file</b>(x)", "a/busDriver.c")], "qid int, document_id int, heading string, snippet string, path string")
    tasks = spark.createDataFrame([(0, "reconnect with aB_cd now")], "qid int, task string")
    assert {r.token for r in select.cue_tokens(hits, tasks, is_api).collect()} == {"retryPolicy", "open_file(x", "busDriver", "reconnect", "aB_cd"}
    syms = spark.createDataFrame([(5, 1, "call", "c"), (6, 1, "function", "f"), (7, 2, "type", "t")], "id int, document_id int, kind string, name string")
    found = spark.createDataFrame([(0, 7, "type", 1), (0, 6, "function", 2), (0, 8, "call", 3)], "qid int, id int, kind string, rank int")
    assert [(r.id, r.place) for r in select.harvest(hits, syms, found).orderBy("place").collect()] == [(6, 1), (7, 3)]
    marked = spark.createDataFrame([(0, "U", "b", 2), (0, "u", "a", 1), (0, " ", "c", 0)], "qid int, uri string, reason string, position int")
    assert [(r.uri, r.reason) for r in select.pins(marked).collect()] == [("u", "a")]
    one = spark.range(1).select(select.line_label(F.lit(3), F.lit(9)), select.line_label(F.lit(3), F.lit(3)), select.line_label(F.lit(0), F.lit(0)), select.shown_status(F.lit("verified"), F.lit("E3")), select.shown_status(F.lit("verified"), F.lit("E1"))).first()
    assert list(one) == ["3-9", "3", "", "inferred", "verified"]


def test_reviews_and_rows_that_are_replaced(spark, tmp_path):
    r = spark.createDataFrame([(1, "generated_summary", "draft", None), (2, "curated_internal_recipe", "reviewed", "t0")], "id int, authority string, review_status string, reviewed_at string")
    d = spark.createDataFrame([(1, "reviewed"), (2, "draft")], "id int, status string")
    assert sorted(map(tuple, mutate.reviewed(r, d, F.lit("t1")).collect())) == [(1, "curated_internal_recipe", "reviewed", "t1"), (2, "generated_summary", "draft", "t1")]
    assert catalog.default_roots("p", ["a", " p ", "", "a"]) == ["p", "a"] and mutate.cleared(r).count() == 0
    (tmp_path / "in").mkdir()
    made = lambda rows, name: spark.createDataFrame(rows, "id int, v string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(1, "c"), (3, "d")]]):
        made(rows, f"f{n}")
        stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in" / f"f{n}"))
        events.run_by_batch(stream, str(tmp_path / f"ck{n}"), lambda df, k, n=n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
    got = events.latest(spark, f"{tmp_path}/out", spark.createDataFrame([], "id int, v string").schema, "id")
    assert sorted(map(tuple, got.collect())) == [(1, "c"), (2, "b"), (3, "d")]


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_percentiles_by_brute_force(spark, n):
    import random

    rng = random.Random(n)
    rows = [(g, rng.choice([1.0, 2.5, rng.random() * 9])) for g in "ab" for _ in range(n)] + [("a", None)]
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in corpus.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, "g").collect()}
    for g in "ab":
        xs = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(xs[int((len(xs) - 1) * p)] for p in (0.0, 0.5, 0.95, 1.0))


def test_needles_are_found_as_they_are(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "xalpha beta gamma deltax"), (3, "alpha  beta gamma delta"), (4, "short one")]
    chunks = corpus_of(spark, [(i, i, "p", "unknown", "", t) for i, t in docs])
    needles = spark.createDataFrame([(0, "alpha beta gamma delta"), (1, "ort o"), (2, "none of these here")], "id int, needle string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, evaluate.containing(d, needles, index.of(chunks)).collect())) == [(0, 1), (0, 2), (1, 4)]


# ---------------------------------------------------------------- streams


def test_streams_equal_tables(spark, sf, tmp_path):
    e = T.table(spark, sf, "events")
    stream = events.source(spark, sf, "events.parquet")
    events.run_to_table(events.deduplicated(stream.select("event_id", "ts")), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == e.select("event_id").distinct().count()
    seen = []
    events.run_by_batch(events.tumbling(events.source(spark, sf, "events.parquet"), "1 day"), str(tmp_path / "c2"), lambda df, n: seen.append(df.count()))
    assert sum(seen) > 0 and events.sessions(e).agg(F.sum("n")).first()[0] == e.count()


# ---------------------------------------------------------------- plans


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans_stay_in_the_jvm_and_prune(spark, sf):
    from tessera.plans import retrieval

    p = plan_of(retrieval.semantic_topk(spark, sf))
    assert "Python" not in p and "CartesianProduct" not in p
    d = plan_of(T.table(spark, sf, "documents").where("source = 'src0'").select("doc_id"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src0)]" in d and "ReadSchema: struct<doc_id:bigint,source:string>" in d
    assert "Exchange" not in plan_of(index.term_vectors(T.chunks(spark, sf), ["chunk_id"], "body").select("term"))  # counted within the row
    for query in (retrieval.search_ranked, retrieval.symbol_lookup, retrieval.phrase_search, retrieval.eval_recall):
        assert "NestedLoop" not in plan_of(query(spark, sf)).replace("BroadcastNestedLoopJoin BuildRight, Inner\n", "")


def test_tasks_follow_the_number_of_parts(spark, monkeypatch):
    """Parts in one file are dealt out to as many tasks as their number asks for, and parents aren't broadcast."""
    monkeypatch.setattr(mutate, "TASK_PARTS", 50)
    old = spark.range(600).select((F.col("id") % 40).alias("key"), F.col("id").alias("part")).coalesce(1)
    new = spark.createDataFrame([(3, -3), (39, -39), (41, -41)], "key long, part long")
    out = mutate.with_parts(old, new, spark.createDataFrame([(3,), (3,), (39,)], "key long"), "key")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert ", 12), REPARTITION_BY_NUM" in text and "Broadcast" not in text
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(i % 40, i) for i in range(600) if i % 40 not in (3, 39)] + [(3, -3), (39, -39)])


def test_tasks_follow_the_number_of_sources(spark, tmp_path, monkeypatch):
    """Parts in one file are dealt out to several tasks that read symbols off their sources."""
    from tessera.plans import packages as plan

    spark.range(95).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(plan, "TASK_SOURCES", 10)
    found = plan.code_symbols(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 10 and found.select("path").distinct().count() == 95
