"""Quality rules: counts that rules are stated in, and a logistic regression over hashed word and character n-grams.

The counts are exact and come from whole texts. The regression is trained on labelled rows, a bounded sample of each
class by a hash of the id, by accelerated full-batch gradient steps; its scores are calibrated to probabilities
on a part of the sample that it wasn't trained on. Texts are scored in Arrow batches, in one pass without a shuffle,
and kept if they pass the rules and their probability reaches a fixed threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, LOWER, SPACE, blocks, give_back, mix64, powers, raw, scales, strings, table

#: Bound on the labelled documents of a class that are learned from; one in HOLD of them calibrates.
TRAIN_DOCS, HOLD = 2000, 4
#: Buckets of hashed n-grams: one half for words and pairs of words, the other for runs of CHARS characters (bytes).
BUCKETS, CHARS = 1 << 15, (3, 5)
#: The rules: a text has at least LEAST_WORDS words, and at most MOST_REPEAT percent of them stand in WINDOW-word windows found again.
LEAST_WORDS, MOST_REPEAT, WINDOW = 20, 30, 8
#: A text is kept from this probability of being good.
THRESHOLD = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


# ---------------------------------------------------------------- the counts


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every line of the rows' texts, as parted by newlines."""
    cut = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, cut, side="right") - 1
    n = len(offsets) - 1
    rows = np.concatenate([row, np.arange(n)])
    starts, ends = np.concatenate([cut + 1, offsets[:-1]]), np.concatenate([cut, offsets[1:]])
    starts, ends = np.sort(starts), np.sort(ends)  # the k-th start and the k-th end are of one line
    return np.sort(rows), starts, ends


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word of the rows' texts, in order."""
    solid = ~SPACE[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    first[filled] = solid[filled]
    last[:-1] &= ~solid[1:]
    last[filled[1:] - 1] = solid[filled[1:] - 1]
    starts = np.flatnonzero(first)
    return np.searchsorted(offsets, starts, side="right") - 1, starts, np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = scales(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def again(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, by row and hash: whether an equal one came before it, and whether it has an equal one at all."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(mix64(h + row.astype(np.uint64) * BASE), kind="stable")  # rows in order among equals
    r, k = row[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    later, any_ = np.empty(len(h), bool), np.empty(len(h), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    any_[order] = both
    return later, any_


def counts(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(rows, 5): words, their characters, symbols, duplicate lines, words in repeated windows. at, h: rows and hashes of the words."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    per_row = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    out[:, 0] = np.bincount(at, minlength=n)
    out[:, 1] = per_row(solid & ((data & 0xC0) != 0x80))  # a character counts at its first byte
    out[:, 2] = per_row(SYMBOLS[data])
    of, starts, ends = lines(data, offsets)
    filled = np.append(0, np.cumsum(solid))
    some = filled[ends] > filled[starts]
    of, starts, ends = of[some], starts[some], ends[some]
    out[:, 3] = np.bincount(of[again(of, hashes(data, starts, ends))[0]], minlength=n)
    if len(h) >= WINDOW:
        up = powers(WINDOW)
        seen = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            seen += h[k : len(h) - WINDOW + 1 + k] * up[k]
        whole = np.flatnonzero(at[WINDOW - 1 :] == at[: len(at) - WINDOW + 1])
        found = whole[again(at[whole], seen[whole])[1]]
        edge = np.bincount(found, minlength=len(h) + 1) - np.bincount(found + WINDOW, minlength=len(h) + 1)
        out[:, 4] = np.bincount(at[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


# ---------------------------------------------------------------- the classifier


def buckets(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair of words and run of characters, A-Z lower-cased; none goes over a text's end."""
    low = LOWER[data]
    low[SPACE[data]] = 32
    h = hashes(low, starts, ends)
    half = np.uint64(BUCKETS // 2 - 1)
    pair = (h[:-1] * BASE + h[1:])[at[1:] == at[:-1]]
    rows, found = [at, at[1:][at[1:] == at[:-1]]], [h & half, mix64(pair) & half]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    wide = low.astype(np.uint64)
    for k in CHARS:
        if len(wide) >= k:
            run = wide[: len(wide) - k + 1].copy()
            for i in range(1, k):
                run = (run << np.uint64(8)) | wide[i : len(wide) - k + 1 + i]
            own = row[k - 1 :] == row[: len(row) - k + 1]
            run = (run[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            rows.append(row[k - 1 :][own])
            found.append((run & half) + half + np.uint64(1))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the rows' texts, in order: 1 + log of each count, of length 1 in all."""
    n = len(offsets) - 1
    rows, found = buckets(data, offsets, at, starts, ends)
    many = np.bincount(rows * BUCKETS + found, minlength=0)
    place = np.flatnonzero(many)
    row, value = place // BUCKETS, 1 + np.log(many[place])
    return row, place % BUCKETS, value / np.sqrt(np.bincount(row, value * value, n))[row]


def blocks_of(offsets: np.ndarray, most_rows: int = 128):
    """Runs of rows of bounded bytes and number."""
    for i, j in blocks(offsets):
        for a in range(i, j, most_rows):
            yield a, min(a + most_rows, j)


@dataclass
class Model:
    """A weight for each bucket and an intercept; the calibration's scale and shift."""

    weights: np.ndarray
    intercept: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * self.weights[bucket], n) + self.intercept

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin * self.scale + self.shift, -30, 30)))


def fit_weights(n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 80) -> Model:
    """Ridge logistic regression, both classes weighing alike, by accelerated full-batch gradient steps."""
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 1).mean(), 1e-9)) / n
    ridge, rate = 1e-4, 4.0  # rows have length 1, and so has the intercept's column: the loss bends by at most 2 / 4
    w, before = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * ahead[bucket], n) + ahead[-1], -30, 30)))
        off = weight * (p - y)
        g = np.append(np.bincount(bucket, value * off[row], BUCKETS), off.sum()) + ridge * np.append(ahead[:-1], 0)
        before, w = w, ahead - rate / 2 * g
    return Model(w[:-1], float(w[-1]))


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale (at least a tenth) and shift of a weighted logistic regression of y on the margin, targets a little inside 0 and 1."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.1), float(w[1])


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, y, part) to (y, part, bucket, value): the buckets and their values as bytes."""
    for batch in batches:
        data, offsets = raw(strings(batch, "text"))
        got = []
        for i, j in blocks_of(offsets):
            part = data[offsets[i] : offsets[j]]
            row, bucket, value = features(part, offsets[i : j + 1] - offsets[i], *tokens(part, offsets[i : j + 1] - offsets[i]))
            cut = np.searchsorted(row, np.arange(j - i + 1))
            got += [(bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        keep = {c: batch.column(batch.schema.get_field_index(c)) for c in ("y", "part")}
        yield pa.RecordBatch.from_pydict({**keep, "bucket": pa.array([b for b, _ in got], pa.binary()), "value": pa.array([v for _, v in got], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learns from documents that labels mark 1 (good) or 0; None without both classes.

    At most about train_docs documents of a class are read, chosen by a hash of doc_id; one in HOLD of them calibrates,
    weighed as their classes' numbers among all labels. A document with two labels counts as good if one says so.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    many = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(many) < 2:
        return None
    span = 1 << 20
    limit = F.coalesce(*[F.when(F.col("y") == k, F.lit(math.ceil(min(1.0, train_docs / v) * span))) for k, v in many.items()])
    chosen = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(span)) < limit).groupBy("doc_id").agg(F.max("y").alias("y"))
    part = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(HOLD)).cast("int").alias("part")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", part)  # about 2 * train_docs rows
    got = rows.mapInArrow(sparse, "y int, part int, bucket binary, value binary").toPandas().sort_values(["y", "bucket"]).reset_index(drop=True)

    def flat(x):
        size = [len(b) // 4 for b in x.bucket]
        return np.repeat(np.arange(len(x)), size), np.frombuffer(b"".join(x.bucket), np.int32), np.frombuffer(b"".join(x.value), np.float32).astype(float)

    train, held = got[got.part > 0], got[got.part == 0]
    if train.y.nunique() < 2:
        return None
    model = fit_weights(len(train), *flat(train), train.y.to_numpy(float))
    if held.y.nunique() == 2:
        y = held.y.to_numpy(float)
        weight = np.where(y > 0, many[1] / max(y.sum(), 1), many[0] / max((1 - y).sum(), 1))
        model.scale, model.shift = calibrated(model.margin(len(held), *flat(held)), y, weight)
    return model


# ---------------------------------------------------------------- the verdict

ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"


def judged(model: Model | None, keep: list[str], threshold: float):
    """An Arrow function: the columns of keep, the counts and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(strings(batch, "text"))
            n = len(offsets) - 1
            c, p = np.zeros((n, 5), np.int64), np.ones(n)
            for i, j in blocks_of(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                at, starts, ends = tokens(part, own)
                c[i:j] = counts(part, own, ~SPACE[part], at, hashes(part, starts, ends))
                if model is not None:
                    p[i:j] = model.probability(model.margin(j - i, *features(part, own, at, starts, ends)))
            failed = (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEAT * c[:, 0])
            columns = [pa.array(c[:, k]) for k in range(5)] + [pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f"k{k}")) for k in range(len(keep))] + columns, names=keep + [x.split()[0] for x in ADDED.split(", ")])
            give_back()

    return run


def judge(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns of keep with the counts, base_failed, kept and p_good.

    Words are runs of other than blanks, in the case they have. A null text has no words and one empty line; a text
    with fewer than LEAST_WORDS words, or more than MOST_REPEAT percent of them in repeated WINDOW-word windows, fails
    the rules and isn't kept whatever its p_good. Without a model p_good is 1. Equal texts get equal results, each
    repeated row its own; an empty table gives an empty one. Columns of any other names may stand in docs; one of
    keep that has the name of an added column isn't allowed.
    """
    added = [x.split()[0] for x in ADDED.split(", ")]
    if clash := set(keep) & set(added):
        raise ValueError(f"columns to be added are there already: {sorted(clash)}")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), ADDED])
    return docs.select(*(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)), "text").mapInArrow(judged(model, list(keep), threshold), schema)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
