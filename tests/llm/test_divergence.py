import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import divergence

from .fixtures import documents, empty, prose, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    """docs: (text, lang, source). Straight from the definition, in Python's whole numbers."""
    docs = [tuple(x or "" for x in d) for d in docs]
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW)) for t, _, _ in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        df = Counter(w for f, d in zip(found, docs) if d[1] == lang for w in set(f))
        kept = [w for w, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for f, d in zip(found, docs):
            if d[1] == lang:
                counts[d[2]].update(w for w in f if df[w] >= least)
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        share, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = sorted((-sum(abs(share[s][w] - share[b][w]) for w in kept), b.encode(), b) for b in counts if b != s)
            out |= {(lang, s, "pair", b, -v, k) for k, (v, _, b) in enumerate(pairs, 1)}
            ranked = sorted((q[w] - share[s][w], w.encode(), w) for w in kept if counts[s][w] and share[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(ranked, 1)}
    return out


def result(df):
    got = [tuple(r[k] for k in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("least,top,block", [(3, 50, 1 << 20), (1, 4, 6), (2, 2, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(least)
    docs = [(prose(rng, rng.choice([0, 2, 9, 40])) + rng.choice(["", " Ünïcode ÄÖ", " x-Y_z 3d"]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(90)]
    docs += [(None, "fr", "a"), ("", "fr", "b"), ("only one", "xx", "z")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    assert result(divergence.audit(df, least, top)) == brute(docs, least, top)


def test_audit_of_awkward_rows(spark):
    want = brute([r[1:4] for r in rows()], 2, 50)
    assert result(divergence.audit(documents(spark), 2)) == want
    assert divergence.audit(empty(spark)).collect() == []
    assert {r.value for r in divergence.audit(documents(spark), 10**6).collect()} == {0}  # no term is kept


def test_shares_are_exact_beyond_64_bits():
    count, total = np.array([10**12 + 7, 0, 9 * 10**12]), np.array([3 * 10**13 + 1, 10**15, 9 * 10**12])
    want = [1 + 1_000_000_000 * (c + 5) // (n + 5 * 77) for c, n in zip(count.tolist(), total.tolist())]
    assert divergence.share(count, total, 77).tolist() == want


def test_query_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    q = duck.sql(divergence.OP13_SQL)
    assert q.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert result(divergence.op13_divergence(spark, sf)) == set(q.fetchall())
