"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary classifier over hashed byte n-grams, and a
loss-weighted decoder picks the language whose codeword is nearest. Up to six languages take the exhaustive code,
more of them a seeded random code whose rows are kept far apart.

A bit's classifier is a log-odds table over n-gram buckets, learned from n-gram counts by language, with a logistic
calibration of its mean log-odds. The counts come from a sample of labelled documents: per language at most about
TRAIN_DOCS, chosen by a hash of doc_id, read whole. Counting and calibration run on the executors over a fixed number
of partitions; only fixed-size tables reach the driver. Prediction is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, drop_stored, raw, stored, strings, table

#: Buckets of hashed n-grams, and the bound on sampled training documents of one language.
BUCKETS, TRAIN_DOCS = 1 << 15, 1500
#: Partitions that the bounded sample is counted in.
TRAIN_PARTS = 12
#: A prediction is ambiguous where the second language's probability is at least this share of the first's.
AMBIGUOUS = 0.5
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def folded() -> np.ndarray:
    """Bytes as the n-grams see them: ASCII letters in lower case, other ASCII as blanks, the rest as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


FOLDED = folded()


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte position the buckets of the 2-gram and the 3-gram that end there; -1 where there is none to count."""
    b = FOLDED[data].astype(np.int64)
    n = len(b)
    two, three = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n > 1:
        pair = b[:-1] << 8 | b[1:]
        keep = pair != (32 << 8 | 32)
        two[1:][keep] = (pair[keep] * 40503 >> 3) & (BUCKETS // 2 - 1)
    if n > 2:
        tri = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        keep = (b[1:-1] != 32) & (tri != 32)
        three[2:][keep] = BUCKETS // 2 + ((tri[keep] * 2654435761 >> 9) & (BUCKETS // 2 - 1))
    return two, three


def spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the rows' texts; none crosses a text's start."""
    at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    two, three = grams(data)
    starts = offsets[:-1][np.diff(offsets) > 0]
    two[starts] = -1
    three[starts] = -1
    second = starts[starts + 1 < offsets[-1]] + 1
    three[second] = -1
    rows, found = np.concatenate([at, at]), np.concatenate([two, three])
    keep = found >= 0
    return rows[keep], found[keep]


@dataclass
class Model:
    """Languages, their codewords (+1/-1 by bit), each bucket's log-odds by bit, and the bits' calibration and weights."""

    langs: list[str]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-odds of each row and bit; 0 for rows without n-grams."""
        n, bits = len(offsets) - 1, self.code.shape[1]
        out = np.zeros((n, bits))
        for i, j in blocks(offsets):
            for a in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), 1 << 22):  # a very long text goes in parts
                z = min(int(offsets[j]), a + (1 << 22))
                part = np.clip(offsets[i : j + 1], max(a - 2, 0) if a > offsets[i] else a, z)
                rows, found = spread(data[part[0] : part[-1]], part - part[0])
                for b in range(bits):
                    out[i:j, b] += np.bincount(rows, self.odds[found, b], j - i)
        return out / np.maximum(np.diff(offsets), 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, the runner-up's share of it): the logistic loss of each codeword, weighted."""
        f = margins * self.scale + self.shift
        loss = np.stack([(self.weight[k] * np.logaddexp(0, -f * self.code[k])).sum(1) for k in range(len(self.langs))], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, (p.max(1) / top if len(self.langs) > 1 else np.zeros(len(p)))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: exhaustive up to six languages, else the random code, of many drawn, with the largest least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = (1 << (n - 1)) - 1
        return np.array([[1 if r == 0 or (c + 1) >> (n - 1 - r) & 1 == 0 else -1 for c in range(bits)] for r in range(n)], float)
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (n, math.ceil(10 * math.log2(n))))
        same = c @ c.T - 2 * c.shape[1] * np.eye(n)
        d = (c.shape[1] - same.max()) / 2
        if d > far and (np.abs(c.sum(0)) < n).all():
            best, far = c, d
    return best


def remainder(doc_id: str) -> Column:
    """crc32 of doc_id as text, modulo 4; 2 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def counted(langs: list[str]):
    """A mapInPandas-like Arrow function: one row (lang, counts) for each language in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = raw(strings(batch, "text"))
            names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for i, j in blocks(offsets):
                rows, found = spread(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                number = np.array([langs.index(x) for x in names[i:j]])
                for k in set(number.tolist()):
                    own = found[number[rows] == k]
                    sums[langs[k]] = sums.get(langs[k], 0) + np.bincount(own, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([np.asarray(v, np.int64).tobytes() for v in sums.values()], pa.binary())})

    return run


def measured(model: Model):
    """An Arrow function: each row's language number and margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(strings(batch, "text"))
            names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            yield pa.RecordBatch.from_pydict({"k": pa.array([model.langs.index(x) for x in names], pa.int32()), "m": pa.array(list(model.margins(data, offsets).astype(np.float32)), pa.list_(pa.float32()))})

    return run


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from rows (doc_id, text, lang); those without text or lang are left out."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    n = len(langs)
    code = codewords(n)
    if n < 2:
        return Model(langs, code, np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape))
    span = 1 << 20
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(math.ceil(min(1.0, train_docs / sizes[k]) * span))) for k in langs])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text")), F.lit(span)) < share).repartition(TRAIN_PARTS, F.xxhash64("doc_id", "text"))
    chosen = stored(chosen, "train")  # a bounded sample, read twice
    counts = np.ones((n, BUCKETS))
    for r in chosen.mapInArrow(counted(langs), "lang string, counts binary").toLocalIterator():
        counts[langs.index(r.lang)] += np.frombuffer(r.counts, np.int64)
    shares = counts / counts.sum(1, keepdims=True)
    odds = np.stack([np.log(shares[code[:, b] > 0].mean(0)) - np.log(shares[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    model = Model(langs, code, odds, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape))
    got = chosen.mapInArrow(measured(model), "k int, m array<float>").toPandas()
    drop_stored(chosen)
    k, m = got.k.to_numpy(), np.stack(got.m.to_numpy()).astype(float)
    for b in range(code.shape[1]):
        model.scale[b], model.shift[b] = calibrated(m[:, b], code[k, b])
    right = (m * model.scale + model.shift) * code[k] > 0
    for c in range(n):
        hits = right[k == c].mean(0) if (k == c).any() else np.ones(code.shape[1])
        model.weight[c] = hits / max(hits.sum(), 1e-9) * code.shape[1]
    return model


def calibrated(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic regression of y (+1/-1) on m, with a ridge on the scaled margin; Newton steps."""
    unit = max(float(m.std()), 1e-9)
    x = np.stack([m / unit, np.ones(len(m))], 1)
    w, weight = np.array([1.0, 0.0]), np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - (y > 0))) + 1e-2 * len(m) * np.array([w[0] * 0.1, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3 * len(m), 1e-6 * len(m)])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.1) / unit, float(w[1])


def predicted(model: Model, keep: list[str]):
    """An Arrow function: the columns of keep, and the prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch, "text")
            data, offsets = raw(column)
            known = np.array([LETTER.search(x) is not None for x in column.to_pylist()], bool) if model.langs else np.zeros(len(column), bool)
            if model.langs:
                best, p, second = model.decode(model.margins(data, offsets))
                lang, p, unsure = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, p, 0.0), known & (second >= AMBIGUOUS)
            else:
                lang, p, unsure = [UNKNOWN] * len(column), np.zeros(len(column)), known
            yield pa.RecordBatch.from_pydict({**{c: batch.column(batch.schema.get_field_index(c)) for c in keep}, "lang_pred": pa.array(lang, pa.string()), "score": pa.array(p, pa.float64()), "ambiguous": pa.array(unsure, pa.bool_())})

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with lang_pred, score (the nearest codeword's probability, 0 to 1) and ambiguous.

    Only text is looked at. A text that is null or has no letter gives `und` with score 0; so do all if no language was
    learned, and one language learned is always predicted. Equal texts get equal predictions; an empty table gives an
    empty one.
    """
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double", "ambiguous boolean"])
    return docs.select(*keep, "text").mapInArrow(predicted(model, list(keep)), schema)


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; documents whose remainder is 2 are held out of the learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder("doc_id") != 2))
    rows = docs.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "text")
    return predict(rows, model, ("doc_id", "held_out"))
