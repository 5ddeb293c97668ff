"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier of a text's shape gives each document's evidence as a log-likelihood ratio. Hosts and paths are
rated by grouped aggregation of all documents: a host's rate is its documents' mean soft label, shrunk towards the
global rate; a path's is shrunk towards its host's. The strength of each shrinkage comes from the spread of the rates
beyond what their counts explain (method of moments), so sparse sites lean on what is above them. A document's posterior
adds its evidence to the log-odds of its path's rate, the document itself left out.

The classifier is fitted on a bounded sample of labelled documents; rates use all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, drop_stored, give_back, raw, stored, table, words

#: Bound on the labelled documents of a class that are learned from, and on a document's evidence in nats.
TRAIN_DOCS, MOST_EVIDENCE = 3000, 8.0
#: Sites up to this many are broadcast; beyond it they are joined by a shuffle, each dealt over SALTS keys.
BROADCAST_SITES, SALTS = 100_000, 16
#: Classes of bytes; each one's share of the text is a feature.
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,", b";:", b"!?", b"|", b"*#%&$@~^", b"=-_+/\\", b"<>{}[]()", b"\"'`")


def classes() -> np.ndarray:
    """Each byte's class; bytes beyond ASCII are one before the last, other controls the last."""
    t = np.full(256, len(GROUPS) + 1, np.int64)
    t[128:] = len(GROUPS)
    for i, g in enumerate(GROUPS):
        t[list(g)] = i
    return t


CLASSES = classes()
N_CLASSES = len(GROUPS) + 2


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text: shares of byte classes, their square roots, and measures of words and lines."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * N_CLASSES + 11))
    for i, j in blocks(offsets):
        size = np.diff(offsets[i : j + 1])
        part = data[offsets[i] : offsets[j]]
        row = np.repeat(np.arange(j - i), size)
        kind = CLASSES[part]
        share = np.bincount(row * N_CLASSES + kind, minlength=(j - i) * N_CLASSES).reshape(j - i, N_CLASSES) / np.maximum(size, 1)[:, None]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        first = ~space
        first[1:] &= space[:-1]
        starts = offsets[i:j][size > 0] - offsets[i]
        first[starts] = ~space[starts]
        last = ~space
        last[:-1] &= space[1:]
        ends = starts + size[size > 0] - 1
        last[ends] = ~space[ends]
        count = lambda mask, row=row, k=j - i: np.bincount(row[mask], minlength=k)
        n_words = np.maximum(count(first), 1)
        at, h = words(part, offsets[i : j + 1] - offsets[i])
        order = np.lexsort((h, at))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])
        again = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        distinct = np.bincount(at[order][fresh], minlength=j - i)
        letters = share[:, 0] + share[:, 1] + share[:, len(GROUPS)]
        out[i:j, :N_CLASSES] = share
        out[i:j, N_CLASSES : 2 * N_CLASSES] = np.sqrt(share)
        out[i:j, 2 * N_CLASSES :] = np.stack(
            [
                np.log1p(size),
                np.log1p((size - count(space)) / n_words),
                count(first & (kind == 0)) / n_words,
                count(last & (kind > 5) & (kind < len(GROUPS))) / n_words,
                count(first & (kind > 5) & (kind < len(GROUPS))) / n_words,
                np.log1p(n_words / (1 + count(part == 10))),
                share[:, 0] / np.maximum(letters, 1e-9),
                np.log1p(count(part == 10)),
                np.bincount(at[1:][again], minlength=j - i) / n_words,
                distinct / n_words,
                np.log1p(distinct) / np.log1p(n_words),
            ],
            1,
        )
    return out


@dataclass
class Classifier:
    """A logistic classifier over standardised features; weights[-1] is the intercept."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -MOST_EVIDENCE, MOST_EVIDENCE)


def fit_shape(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton steps, both classes weighing alike."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.clip((x - mean) / std, -6, 6), np.ones((len(x), 1))])
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-3 * len(x))
    ridge[-1] = 1e-6 * len(x)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, std, b)


def evidence_of(model: Classifier | None):
    """A column function: the text's evidence; 0 where there is no classifier or no text."""
    if model is None:
        return lambda text: F.lit(0.0)

    @F.arrow_udf("double")
    def run(text):
        filled = pa.compute.fill_null(text, "")
        e = model.evidence(shape(*raw(filled)))
        e[pa.compute.binary_length(filled).to_numpy(zero_copy_only=False) == 0] = 0.0
        give_back()
        return pa.array(e, pa.float64())

    return lambda text: run(F.col(text))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS) -> tuple[Classifier | None, float]:
    """(classifier, the labels' mean) from documents that labels mark 1 (good) or 0; no classifier without both classes."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None, float(next(iter(n), 1))
    span = 1 << 20
    share = F.coalesce(*[F.when(F.col("y") == k, F.lit(math.ceil(min(1.0, train_docs / v) * span))) for k, v in n.items()])
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(span)) < share).groupBy("doc_id").agg(F.max("y").alias("y"))

    @F.arrow_udf("array<double>")
    def features(text):
        return pa.array(list(shape(*raw(text))), pa.list_(pa.float64()))

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about 2 * train_docs rows
    got = rows.select(features("text").alias("x"), "y").toPandas()
    if got.y.nunique() < 2:
        return None, n.get(1, 0) / sum(n.values())
    return fit_shape(np.stack(got.x.to_numpy()), got.y.to_numpy().astype(float)), n.get(1, 0) / sum(n.values())


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, centre: Column) -> float:
    """The prior count of a shrinkage: from groups (n, s) and the rate that each is shrunk towards."""
    m, c = F.col("s") / F.col("n"), centre
    got = groups.select(F.sum(F.col("n") * (m - c) ** 2).alias("v"), F.sum(c * (1 - c)).alias("e"), F.sum(F.col("n") * c * (1 - c)).alias("b"), F.sum("n").alias("n")).first()
    if not got.n:
        return 1.0
    between = max((got.v - got.e) / got.n, 1e-9)
    return float(min(max(got.b / got.n / between - 1, 1.0), 1e4))


def rate(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, texts: bool = True) -> DataFrame:
    """docs' columns with evidence, host_rate, path_rate, p_good and keep added (columns of such names are replaced).

    docs has doc_id and text; host and path are expressions over it, a null one counting as an empty name. A null or
    empty text has no evidence and is judged by its site alone. Without labels of both classes there is no evidence
    either, and the labels' mean (1 if there are none) is the global rate. A document with two labels counts as good if
    one of them says so. Equal rows get equal results; an empty table gives an empty one. Any other names may stand in
    docs, as its rows travel in one struct. Texts are scored once, and rows with their scores stored in the shared
    folder; without texts, they are left out of that table and of the result.
    """
    model, mean = fit(docs, labels)
    added = ["evidence", "host_rate", "path_rate", "p_good", "keep"]
    base = docs.drop(*added)
    out_columns = [c for c in base.columns if texts or c != "text"]
    doc = F.struct(*[F.col(f"`{c}`") for c in out_columns]).alias("doc")
    scored = base.select(doc, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), evidence_of(model)("text").alias("e"))
    scored = stored(scored, "scored")
    e = F.col("e")
    soft = lambda e: 1 / (1 + F.exp(-(e + math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))))
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(soft(e)).alias("s")), "paths", scored.select("host", "path").distinct().count())
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    top = whole.s / whole.n if whole.n else mean
    k = strength(hosts, F.lit(top))
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + k * top) / (F.col("hn") + k))
    joined = paths.join(hosts, "host")
    k2 = strength(joined, F.col("host_rate"))
    sites = stored(joined.select("host", "path", "hn", "hs", F.col("n").alias("pn"), F.col("s").alias("ps")), "sites", paths.count())
    drop_stored(paths)
    if sites.count() <= BROADCAST_SITES:
        rows = scored.join(F.broadcast(sites), ["host", "path"])
    else:  # a site of many rows is dealt over salted keys
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = scored.withColumn("salt", F.pmod(F.xxhash64("doc.doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    own = soft(e)
    host_rate = (F.col("hs") - own + k * top) / (F.col("hn") - 1 + k)
    path_rate = (F.col("ps") - own + k2 * host_rate) / (F.col("pn") - 1 + k2)
    p_good = 1 / (1 + F.exp(-(e + logit(path_rate))))
    return rows.select("doc.*", e.alias("evidence"), host_rate.alias("host_rate"), path_rate.alias("path_rate"), p_good.alias("p_good"), (p_good >= threshold).alias("keep"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, site rates, posterior and decision; the source is the host, its language a path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = rate(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"), texts=False)
    return out.drop("lang")
