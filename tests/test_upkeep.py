"""The term index kept up by batches against one made anew, and what a batch reads and writes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, upkeep

SCHEMA = "document_id long, chunk_id long, root_name string, heading string, body string"
WORDS = "alpha beta gamma delta epsilon retryPolicy snake_case_name network client bounded linear exponential".split()


def chunks_of(rng, docs, seq):
    out = []
    for d in docs:
        for k in range(rng.choice([0, 1, 1, 3])):
            body = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 2, 9, 40])))
            out.append((d, d * 10 + k, ["src0", "src1", None][d % 3], rng.choice(["", "Heading", None]), body if rng.random() > 0.05 else None))
    return out


def state(ix):
    postings = {(r.term, r.root_name, r.chunk_id): r.tf for r in ix.postings().collect()}
    return postings, {(r.root_name, r.term): r.df for r in ix.frequency().collect()}, {r.root_name: r.n for r in ix.roots().collect()}


def rebuilt(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    v = index.term_vectors(df, ["chunk_id", "root_name"], "heading", "body")
    postings = {(r.term, r.root_name, r.chunk_id): r.tf for r in v.collect()}
    roots = {r.root_name: r["count"] for r in df.groupBy("root_name").count().collect()}
    return postings, {(r.root_name, r.term): r.df for r in index.document_frequency(v, "root_name").collect()}, roots


def test_batches_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upkeep, "FANOUT", 3)
    rng = random.Random(5)
    live = {d: chunks_of(rng, [d], 0) for d in range(12)}
    ix = upkeep.TermIndex(spark, f"file://{tmp_path}/ix")
    flat = lambda m: [c for rows in m.values() for c in rows]
    assert ix.create(spark.createDataFrame(flat(live), SCHEMA), 4) == 1
    assert state(ix) == rebuilt(spark, flat(live))
    for step in range(4):  # enough for buckets to be merged
        docs = rng.sample(range(16), 5)
        new = {d: [] if rng.random() < 0.3 else live[d] if d in live and rng.random() < 0.2 else chunks_of(rng, [d], step) for d in docs}
        live |= new
        other = (99, 990, "src0", "not", "in the batch")
        changed = spark.createDataFrame([(d,) for d in [*docs, docs[0], None]], "document_id long")
        assert ix.apply(changed, spark.createDataFrame([*flat(new), other], SCHEMA)) == step + 2
        assert state(ix) == rebuilt(spark, flat(live))
    runs = {}
    for e in ix.manifest():
        runs[e.name, e.bucket] = runs.get((e.name, e.bucket), 0) + 1
    assert max(runs.values()) < 3
    assert ix.frequency(["retrypolicy", "nothing"]).select("term").distinct().count() <= 1
    assert {r.chunk_id for r in ix.postings(["network"]).collect()} == {k[2] for k in state(ix)[0] if k[0] == "network"}


def test_a_batch_touches_its_own_buckets_alone(spark, tmp_path):
    ix = upkeep.TermIndex(spark, f"file://{tmp_path}/ix")
    rows = [(d, d, "sdk", "", f"word{d}x and common") for d in range(40)]
    ix.create(spark.createDataFrame(rows, SCHEMA), 32)
    before = {(e.name, e.bucket): e.run for e in ix.manifest()}
    ix.apply(spark.createDataFrame([(7,)], "document_id long"), spark.createDataFrame([(7, 7, "sdk", "", "word7x and fresh")], SCHEMA))
    touched = {r.b for r in spark.createDataFrame([("common",), ("fresh",)], "t string").select(ix.bucket("t", 32).alias("b")).collect()}
    after = ix.manifest()
    for name in ("postings", "frequency"):
        assert {e.bucket for e in after if e.name == name and e.run not in before.values()} == touched
    assert {(e.name, e.bucket): e.run for e in after if e.name == "frequency" and e.bucket not in touched} == {k: v for k, v in before.items() if k[0] == "frequency" and k[1] not in touched}
    files = ix.frequency(["fresh"]).inputFiles()
    assert files and all("/bucket=" in f and int(f.split("/bucket=")[1].split("/")[0]) in touched for f in files)
    df = {r.term: r.df for r in ix.frequency().collect()}
    assert df["common"] == 39 and df["fresh"] == 1 and df["word7x"] == 1
    ix.apply(spark.createDataFrame([(7,)], "document_id long"), spark.createDataFrame([], SCHEMA))
    df = {r.term: r.df for r in ix.frequency().collect()}
    assert "fresh" not in df and "word7x" not in df and [r.n for r in ix.roots().collect()] == [39]  # counts that fall to zero vanish


def test_an_empty_index_and_a_lost_batch(spark, tmp_path, monkeypatch):
    ix = upkeep.TermIndex(spark, f"file://{tmp_path}/ix")
    none = spark.createDataFrame([], SCHEMA)
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "document_id long")
    with pytest.raises(FileNotFoundError):
        ix.postings()
    assert ix.create(none) == 1 and state(ix) == ({}, {}, {})
    with pytest.raises(FileExistsError):
        ix.create(none)
    one = spark.createDataFrame([(1, 1, "a", "", "some words here")], SCHEMA)
    assert ix.apply(ids(1), one) == 2
    was = state(ix)
    assert was[0] and was[2] == {"a": 1}
    monkeypatch.setattr(ix, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ix.apply(ids(1), none)
    monkeypatch.undo()
    assert state(ix) == was  # what was lost isn't seen
    assert ix.apply(spark.createDataFrame([], "document_id long"), one) == 2  # nothing changed: no new version
    ix.apply(ids(1), none)
    assert state(ix) == ({}, {}, {})


def test_folders_of_the_search_index_follow_its_size(spark, tmp_path, monkeypatch):
    from tessera.operators import search

    rows = [(d, d, "sdk", "Doc", f"word{d % 40}x retryPolicy number {d}", "a.md", "uri", "t", "official_documentation", False, False, "1", 0) for d in range(120)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_id long, root_name string, heading string, body string, path string, uri string, title string, authority string, archived boolean, deprecated boolean, product_version string, ordinal int")
    queries = spark.createDataFrame([(1, "word7x"), (2, "retryPolicy number")], "qid int, query string")
    want = None
    for k, (most, each) in enumerate(((16_000_000, 2_000_000), (20, 3))):
        monkeypatch.setattr(index, "BUCKET_ROWS", most)
        monkeypatch.setattr(index, "FILE_ROWS", each)
        index.write(chunks, f"{tmp_path}/{k}")
        ix = index.read(spark, f"{tmp_path}/{k}")
        buckets = ix.postings.schema["bucket"].metadata["buckets"]
        assert buckets == (32 if k == 0 else -(-ix.postings.count() // 20)) and (k == 0 or buckets > 12)
        got = sorted(map(tuple, search.semantic_candidates(ix, queries, 5).collect())), sorted(map(tuple, index.bm25(ix, queries).select("qid", "chunk_id").collect()))
        assert got[0] and got[1] and (want is None or got == want)
        want = got


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_a_batch_shuffles_vectors_and_counts_changes_once(spark, tmp_path, monkeypatch, small):
    """Texts are counted where they are read, in batches, and not dealt out by document; each delta is summed once."""
    monkeypatch.setattr(upkeep, "SMALL_BATCH", small, raising=False)
    plans, asked = {}, []
    write, touched = upkeep.TermIndex.write, upkeep.TermIndex.touched
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(upkeep.TermIndex, "write", lambda self, rows, name, *a: (plans.__setitem__(name, plan(rows)), write(self, rows, name, *a))[1])
    monkeypatch.setattr(upkeep.TermIndex, "touched", lambda self, rows, *a: (asked.append(plan(rows)), touched(self, rows, *a))[1])
    ix = upkeep.TermIndex(spark, f"file://{tmp_path}/ix")
    rng = random.Random(3)
    live = {d: chunks_of(rng, [d], 0) for d in range(9)}
    ix.create(spark.createDataFrame([c for rows in live.values() for c in rows], SCHEMA), 4)
    new = {d: chunks_of(rng, [d], 1) for d in (1, 3, 11)}
    live |= new | {5: []}
    ix.apply(spark.createDataFrame([(1,), (3,), (5,), (11,), (77,)], "document_id long"), spark.createDataFrame([c for rows in live.values() for c in rows], SCHEMA))
    forward = plans["forward"]
    assert "regexp_extract_all" not in forward and forward.index("Join LeftOuter") < forward.index("MapInArrow")
    assert ("Join LeftSemi" in forward) == bool(small)  # the texts of a small batch alone are counted
    assert asked and not any("Aggregate" in p for p in asked)
    assert state(ix) == rebuilt(spark, [c for rows in live.values() for c in rows])
