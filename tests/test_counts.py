"""Words and terms counted in batches against the column functions, and scores against a plain sum."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import counts
from tessera.functions.text import terms
from tessera.operators import index

ODD = ["", "The retryPolicy HTTPServer2Go snake_case __x", "x²y ½ Ⅷa ٣٤ ñandúÑa", "ΑΣ ÉCOLE ǅx áb", "12ab34CD5 _ 9_a", "a\n\tbb ccc ccc", "日本語テキスト123 mixedÑame", "İstanbul ſ K"]


def test_counts_are_those_of_the_column_functions(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", "t", index.words(F.col("t")).alias("w"), terms(F.col("t")).alias("s")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert +counts.word_counts(r.t) == Counter(r.w), r.t
        assert counts.term_counts(r.t) == Counter(r.s), r.t


def test_scores_of_a_batch_of_queries(spark):
    """All hits equal a plain sum; with a limit, at least the first ones are there, and most of the others are not made."""
    texts = [(i, "src", "head one" if i % 3 == 0 else "", " ".join(["alpha"] * (i % 5 + 1) + ["beta"] * (i % 2) + [f"w{i}"] * 3)) for i in range(400)]
    c = spark.createDataFrame(texts, "chunk_id long, root_name string, heading string, body string").coalesce(1).withColumns({"ordinal": F.lit(0), "path": F.lit("p"), "title": F.lit("t"), "uri": F.lit("u"), "authority": F.lit("unknown")})
    q = spark.createDataFrame([(1, "alpha beta"), (2, "w7 head"), (3, "nothing here")], "qid int, query string")
    got = {(r.qid, r.chunk_id): -r["rank"] for r in index.bm25(c, q, all_words=False).collect()}
    df, avg = Counter(w for _, _, h, b in texts for w in set((h + " " + b).split())), sum(len((h + " " + b).split()) for _, _, h, b in texts) / 400
    want = {}
    for k, query in ((1, "alpha beta"), (2, "w7 head")):
        for i, _, h, b in texts:
            s = 0
            for w in query.split():
                tf = 10 * h.split().count(w) + b.split().count(w)
                s += max(math.log((400 - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len((h + " " + b).split()) / avg)) if tf else 0
            if s:
                want[k, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = {(r.qid, r.chunk_id) for r in index.bm25(c, q, all_words=False, most=5).collect()}
    first = lambda k: sorted((-round(s, 9), i) for (q, i), s in want.items() if q == k)[:5]
    assert {(k, i) for k in (1, 2) for _, i in first(k)} <= some and len(some) < len(want) / 2


def test_stored_words_are_one_row_a_chunk(spark, tmp_path):
    """A search of a stored index shuffles hits, not the occurrences of all words; phrases look at chunks with their rarest word alone."""
    rows = [(i, "src", "", "of the many words" + (" of the needle" if i == 5 else "")) for i in range(50)]
    c = spark.createDataFrame(rows, "chunk_id long, root_name string, heading string, body string").withColumns({"ordinal": F.lit(0), "path": F.lit("p"), "title": F.lit("t"), "uri": F.lit("u"), "authority": F.lit("unknown")})
    ix = index.Stored(c, f"{tmp_path}/ix")
    q = spark.createDataFrame([(1, "of the needle")], "qid int, query string")
    hits = index.bm25(ix, q, most=3)
    assert "Exchange" not in hits._jdf.queryExecution().toString() and [r.chunk_id for r in hits.collect()] == [5]
    assert spark.read.parquet(f"{tmp_path}/ix/occurrences").count() == 50
    phrases = spark.createDataFrame([(0, ["of", "the", "needle"], None), (1, ["the", "of"], None)], "pid int, ws array<string>, roots array<string>")
    assert [tuple(r) for r in index.phrase_hits(ix, phrases).collect()] == [(0, 5)]
