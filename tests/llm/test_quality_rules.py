import random
import re

import numpy as np
import pytest

from tessera.llm import quality_rules as qr

from .fixtures import documents, empty, prose, rows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {i for v in at.values() if len(v) > 1 for k in v for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def texts():
    rng = random.Random(3)
    out = [r[1] for r in rows()]
    for _ in range(40):
        t = prose(rng, rng.choice([5, 19, 20, 60]))
        out += [t, t + "\n" + t, t + " " + t.upper(), f"{t}\n\n \n{t[:30]}\n{t[:30]} \n{t[:30]}\r\n#a <b> 50% & | $x *", "ab " * 30]
    return out + ["\n", "\n\n", "é ñ\nü", "a" * 5000]


def test_counts_equal_brute_force(spark, monkeypatch):
    for most in (1 << 20, 50):
        monkeypatch.setattr("tessera.llm.common.BLOCK_BYTES", most)
        every = texts()
        df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r for r in qr.judge(df, None).collect()}
        for k, t in enumerate(every):
            n, *_, repeated = want = brute(t)
            assert tuple(got[k][c] for c in COUNTS) == want, t
            assert got[k].base_failed == (n < 20 or 100 * repeated > 30 * n) == (not got[k].kept)


def corpus(n, rng):
    good = "the system keeps every record in a table that readers can trust and writers may extend".split()
    bad = "BUY now!!! click $$$ free >>> winner *** cheap pills http %%% deal ||| offer".split()
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.7)
        docs.append((i, " ".join(rng.choice(good if y else bad) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.choice([25, 60, 200])))))
        labels.append((i, y if rng.random() < 0.97 else 1 - y))
    return docs, labels


def test_learns_from_labels_and_is_calibrated(spark):
    docs, labels = corpus(600, random.Random(2))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1), (5, 1), (5, 1), (399, None)], "doc_id long, quality int")
    model = qr.fit(df, known)
    got = {r.doc_id: r for r in qr.judge(df, model).collect()}
    truth = dict(labels)
    new = [k for k in got if k >= 400 and not got[k].base_failed]
    assert np.mean([got[k].kept == bool(truth[k]) for k in new]) >= 0.93
    assert abs(np.mean([got[k].p_good for k in new]) - np.mean([truth[k] for k in new])) < 0.1
    again = {r.doc_id: r for r in qr.judge(df.repartition(2), qr.fit(df.repartition(7), known)).collect()}
    assert all(abs(again[k].p_good - got[k].p_good) < 1e-6 for k in got)


def test_scores_equal_a_plain_sum_over_n_grams():
    rng = random.Random(1)
    model = qr.Model(np.random.default_rng(1).normal(size=qr.BUCKETS), 0.25)
    every = [t or "" for t in texts()[:60]]
    data = np.frombuffer("".join(every).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in every]))
    got = model.margin(len(every), *qr.features(data, offsets, *qr.tokens(data, offsets)))

    def bucket(text, kind):
        """The bucket that the batch form gives to a text of one n-gram."""
        b = np.frombuffer(text, np.uint8)
        row, found = qr.buckets(b, np.array([0, len(b)]), *qr.tokens(b, np.array([0, len(b)])))
        words = len(text.split())
        return int(found[{"word": 0, "pair": 2, "run": 2 * words - 1 if words else 0}[kind]]) if kind != "run" or words else int(found[0])

    for k in rng.sample(range(len(every)), 12):
        low = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in every[k].encode())[:400]
        w = low.split(b" ")
        w = [x for x in w if x]
        from collections import Counter

        c = Counter(bucket(x, "word") for x in w) + Counter(bucket(a + b" " + b, "pair") for a, b in zip(w, w[1:]))
        for n in qr.CHARS:
            runs = Counter(low[i : i + n] for i in range(len(low) - n + 1))
            for r, m in runs.items():
                one = np.frombuffer(r, np.uint8)
                own = qr.buckets(one, np.array([0, n]), *qr.tokens(one, np.array([0, n])))[1]
                c[int(own[own >= qr.BUCKETS // 2][-1])] += m
        v = {b: 1 + np.log(m) for b, m in c.items()}
        want = sum(x * model.weights[b] for b, x in v.items()) / max(np.sqrt(sum(x * x for x in v.values())), 1e-9) + 0.25
        if len(every[k].encode()) <= 400:
            assert got[k] == pytest.approx(want, abs=1e-6)


def test_awkward_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = qr.fit(df, labels)
    got = qr.judge(df, model, ("doc_id", "h1", "n_lines", "node")).collect()
    assert len(got) == len(rows())
    assert all(0 <= r.p_good <= 1 for r in got)
    assert len({(r.doc_id, r.p_good) for r in got}) == len({r.doc_id for r in got})  # repeated rows agree
    assert qr.judge(empty(spark), model).count() == 0
    assert qr.fit(empty(spark), labels) is None
    assert qr.fit(df, labels.where("quality = 1")) is None
    with pytest.raises(ValueError):
        qr.judge(df.withColumn("kept", df.h1), model, ("doc_id", "kept"))


def test_given_labels_are_learned(spark, sf):
    """Held-out accuracy on the given tables: fitted on two thirds of the labels, measured on the rest."""
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = {r.doc_id: r for r in qr.judge(docs, qr.fit(docs, labels.where("doc_id % 3 <> 0"))).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in got and not got[r.doc_id].base_failed]
    assert np.mean([r.kept for y, r in held if y]) >= 0.97
    assert np.mean([r.kept == bool(y) for y, r in held]) >= 0.9
