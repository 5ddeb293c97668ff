"""Exact rolling medians and median deviations of many series by distributed radix selection.

Time is cut into cells, so many to a window that a cell, and a window's number of cells, grow only with the square root
of what a window holds. All queries of a cell share the whole cells that lie inside every one of their windows (the
middle), and differ in the points of two cells at most: their own and the one a window earlier (the edges). Runs of a
cell's queries share most of the edges too, and look among few others. A window of some thousand points is one cell: it
has no middle, and its queries are answered from the two cells alone.

Values are coded so that equal prefixes of the code are ranges of values. A round deals points and asking cells out by
series, prefix and stretch of time; there, prefix sums over the cells give the middle's count under each next digit of
the prefix, for every cell that asked. A cell asks for those prefixes only in which the ranks that its queries look for
may lie, and descends until these are single values. The medians then come from the middle's few exact values, its
counts elsewhere, and the edges. The radius is found alike: a prefix bounds how far its values are from the medians, and
those that may hold the middle deviation are descended further.

All steps are joins and groups of the cells' packed columns; none brings a series or a table to one task, nor more of a
window than two cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import drop_stored, give_back, stored, table

#: The window in microseconds, and how many cells it may be cut into: divisors of it.
WIDE = 360 * 60 * 1_000_000
CUTS = [2**k for k in range(12)] + [2**11 * 5**k for k in range(1, 9)]
#: A window of n points is cut into about sqrt(n) / THIN cells; counts of queries by points are made MATRIX at a time. STEP
#: queries and points that come or go with them make a run of queries.
THIN, MATRIX, STEP = 128, 1 << 21, 1 << 10
#: Bytes of rows that are handed on together.
BATCH_BYTES = 1 << 23
#: Bits of a number's mantissa that prefixes of each level have, after its sign and exponent.
LEVELS = (3, 13, 23, 33, 43, 52)
#: No cents; cents are below MOST in size, so that eight times as much is still a 64-bit number.
NONE, MOST = np.iinfo(np.int64).min, 1 << 59
#: A window of fewer cents has no median.
LEAST = 5
CELL = "series string, m int, chunk long, cell long"


# ---------------------------------------------------------------- codes


def code(cents: np.ndarray) -> np.ndarray:
    """A 64-bit number in the order of cents (which are doubles, and so is their code): sign, exponent, mantissa."""
    bits = cents.astype(np.float64).view(np.int64)
    return bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


def bounds(level: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole number with each prefix."""
    shift = 52 - np.array(LEVELS)[level]
    low = prefix << shift
    ends = np.stack([low, low + (np.int64(1) << shift) - 1])
    ends = (ends ^ (ends >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)
    return np.ceil(ends[0]).astype(np.int64), np.floor(ends[1]).astype(np.int64)


def prefixes(codes: np.ndarray, level: int) -> np.ndarray:
    return codes >> (52 - LEVELS[level])


def numbers(blob: bytes | None, width: int = 0) -> np.ndarray:
    out = np.frombuffer(blob or b"", np.int64)
    return out.reshape(-1, width) if width else out


def packed(*columns: np.ndarray) -> bytes:
    return np.stack([np.asarray(c, np.int64) for c in columns], 1).tobytes()


def each_row(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Its rows one at a time: they may be long."""
    return (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows))


def by_rows(take: Callable, schema: str) -> tuple[Callable, str]:
    """A mapInArrow function that gives take(row as a tuple) -> rows, and its schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [types[x.split()[1]] for x in schema.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in each_row(batch):
                for r in take(*row):
                    out.append(r)
                    size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
                if size > BATCH_BYTES:
                    yield made(out)
                    out, size = [], 0
            yield made(out)
            give_back()

    return run, schema


# ---------------------------------------------------------------- cells


def micros(c: Column, kind) -> Column:
    """Microseconds since 1970 without any zone."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(c)
    since = c - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = lambda x: F.extract(F.lit(x), since)
    return ((part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def timed(clicks: DataFrame) -> DataFrame:
    """(click_id, us, series, cents, chunk) of the rows with a time."""
    value = F.col("value").cast("double") * 100 + 0.5
    cents = F.when(F.abs(value) < float(MOST), F.floor(value).cast("long"))  # none for null, NaN and beyond
    us = micros(F.col("ts"), clicks.schema["ts"].dataType)
    series = F.when(F.col("kind").isNull(), "").otherwise(F.concat(F.lit("="), F.col("kind").cast("string")))
    rows = clicks.where(F.col("ts").isNotNull()).select("click_id", us.alias("us"), series.alias("series"), cents.alias("cents"))
    return rows.withColumn("chunk", floor_div(F.col("us"), F.lit(WIDE).cast("long")))


def points(rows: DataFrame) -> DataFrame:
    """(click_id, us, series, cents, chunk): each click_id once. Dealt out first, rows are sorted once."""
    return rows.repartition("click_id").groupBy("click_id").agg(F.min(F.struct("us", "series", "cents", "chunk")).alias("p")).select("click_id", "p.*")


def floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a - F.pmod(a, b), b)


def sorted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CELL with us, cents and id packed in order of time, missing ones as NONE; rows come cell by cell."""
    names = [*(x.split()[0] for x in CELL.split(", ")), "us", "cents", "id"]
    key, held = None, []

    def made() -> pa.RecordBatch:
        us, cents, ids = np.concatenate(held, 1)
        order = np.argsort(us, kind="stable")
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        blobs = [pa.array([x[order].tobytes()], pa.binary()) for x in (us, cents, ids)]
        return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types, strict=True)), *blobs], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = batch.columns[:4], np.stack([pc.fill_null(c, NONE).to_numpy() for c in batch.columns[4:]])
        series, cell = keys[0], keys[3].to_numpy()
        other = pc.not_equal(series[1:], series[:-1]).to_numpy(zero_copy_only=False) | (cell[1:] != cell[:-1])
        starts = [0, *(np.flatnonzero(other) + 1), batch.num_rows]
        for i, j in zip(starts, starts[1:]):
            now = tuple(c[i].as_py() for c in keys)
            if key is not None and now != key:
                yield made()
                held = []
            key = now
            held.append(rows[:, i:j])
    if key is not None:
        yield made()


def cells_of(clicks: DataFrame) -> DataFrame:
    """CELL with us, cents and id packed: the series' clicks by cell; m cells make a window."""
    rows = timed(clicks)
    sizes = rows.groupBy("series", "chunk").agg(F.count(F.lit(1)).alias("n"))  # repeated clicks count: it is for m alone
    most = F.max("n").over(Window.partitionBy("series"))
    m = F.element_at(F.filter(F.array(*(F.lit(c) for c in CUTS)), lambda c: (c >= F.sqrt("most") / THIN) | (c == CUTS[-1])), 1)
    sizes = sizes.withColumn("most", most).select("series", "chunk", m.alias("m"))
    p = points(rows).join(sizes, ["series", "chunk"]).withColumn("cell", floor_div(F.col("us"), F.call_function("div", F.lit(WIDE).cast("long"), F.col("m").cast("long"))))
    p = p.select("series", "m", "chunk", "cell", "us", "cents", "click_id").repartition("series", "cell").sortWithinPartitions("cell", "series")
    return stored(p.mapInArrow(sorted_cells, f"{CELL}, us binary, cents binary, id binary"), "cells")


# ---------------------------------------------------------------- what a cell asks for


def asked(state: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, most: int) -> np.ndarray:
    """Which ranges must be descended, and the bracket that the values of ranks least to most lie in.

    state: (level, prefix, count in the middle, count in the edges); low and high bound the values of each range. The
    middle's points surely count, the edges' may.
    """
    by_high, by_low = np.argsort(high, kind="stable"), np.argsort(low, kind="stable")
    sure = np.cumsum(state[by_high, 2])
    maybe = np.cumsum(state[by_low, 2] + state[by_low, 3])
    k = int(np.searchsorted(sure, most))
    top = high[by_high[min(k, len(high) - 1)]] if k < len(high) else high.max()
    bottom = low[by_low[min(int(np.searchsorted(maybe, least)), len(low) - 1)]]
    return (state[:, 2] > 0) & (high > low) & (low <= top) & (high >= bottom), bottom, top


def median_asks(state: np.ndarray) -> np.ndarray:
    """The rows of state in which medians may lie."""
    middle, edges = int(state[:, 2].sum()), int(state[:, 3].sum())
    if middle + edges < LEAST:
        return state[:0]
    low, high = bounds(state[:, 0], state[:, 1])
    return state[asked(state, low, high, (middle + 1) // 2, (middle + edges) // 2 + 1)[0]]


def radius_range(state: np.ndarray, medians: np.ndarray):
    """(rows of state, bottom, top): where the middle deviations may lie. medians: (us, n, median2) of the cell's queries."""
    some = medians[medians[:, 1] >= LEAST]
    if not len(some) or not len(state):
        return state[:0], 0, -1
    low, high = bounds(state[:, 0], state[:, 1])
    m0, m1, n = some[:, 2].min(), some[:, 2].max(), some[:, 1]
    near = np.maximum(0, np.maximum(2 * low - m1, m0 - 2 * high))
    far = np.maximum(2 * high - m0, m1 - 2 * low)
    need, bottom, top = asked(state, near, far, int(n.min() + 1) // 2, int(n.max()) // 2 + 1)
    return state[need & (high > low)], int(bottom), int(top)


def hist(series, m, chunk, cell, cents):
    """A cell's counts by prefix of the first level, for its own stretch of time and the next."""
    c = numbers(cents)
    found, n = np.unique(prefixes(code(c[c != NONE]), 0), return_counts=True)
    blob = packed(np.full(len(found), cell), found, n)
    return [(series, m, at, chunk == at, cell, blob) for at in (chunk, chunk + 1)]


def middles(at: int, m: int, triples: np.ndarray, level: int, cells: np.ndarray) -> list[np.ndarray]:
    """The state rows of each of cells: from triples (cell, prefix, count) of stretches at - 1 and at, by prefix sums over cells."""
    names, col = np.unique(triples[:, 1], return_inverse=True)
    base = (at - 1) * m
    own = np.zeros((2 * m, len(names)), np.int64)
    np.add.at(own, (triples[:, 0] - base, col), triples[:, 2])
    before = np.zeros((2 * m + 1, len(names)), np.int64)
    np.cumsum(own, 0, out=before[1:])
    out = []
    for r in cells - base:
        middle, edge = before[r] - before[r - m + 1], own[r] + own[r - m]
        some = np.flatnonzero(middle + edge)
        out.append(np.stack([np.full(len(some), level), names[some], middle[some], edge[some]], 1))
    return out


def opened(series, m, at, own, blobs):
    """The first states and asks of the cells of one stretch of time."""
    triples, cells = numbers(b"".join(blobs), 3), np.array(sorted(c for c in own if c is not None), np.int64)
    return [(series, m, at, int(j), s.tobytes(), median_asks(s)[:, :2].tobytes()) for j, s in zip(cells, middles(at, m, triples, 0, cells), strict=True)]


STATE = f"{CELL}, state binary, asks binary"


def first_states(cells: DataFrame) -> DataFrame:
    rows = cells.select("series", "m", "chunk", "cell", "cents").mapInArrow(*by_rows(hist, "series string, m int, at long, own boolean, cell long, blob binary"))
    rows = rows.groupBy("series", "m", "at").agg(F.collect_list(F.when(F.col("own"), F.col("cell"))).alias("own"), F.collect_list("blob").alias("blobs"))
    return stored(rows.where(F.size("own") > 0).mapInArrow(*by_rows(opened, STATE)), "states")


# ---------------------------------------------------------------- one round


def spread(series, m, chunk, cell, asks):
    return [(series, m, chunk, cell, int(level), int(prefix)) for level, prefix in numbers(asks, 2)]


def picked(series, m, cell, cents, at, wanted):
    """A cell's counts by the next digit under each prefix that cells of the stretch `at` ask for."""
    c = numbers(cents)
    codes = np.sort(code(c[c != NONE]))
    out, made = [], {}
    for level in {x["level"] for x in wanted}:  # each digit's runs once, and the prefixes that they are under
        below = prefixes(codes, level + 1)
        edge = np.flatnonzero(np.append(True, below[1:] != below[:-1])) if len(below) else np.zeros(0, np.int64)
        digit = below[edge]
        made[level] = digit >> (LEVELS[level + 1] - LEVELS[level]), digit, np.diff(np.append(edge, len(below)))
    for x in wanted:
        of, digit, n = made[x["level"]]
        a, b = np.searchsorted(of, x["prefix"]), np.searchsorted(of, x["prefix"], side="right")
        if b > a:
            out.append((series, m, at, x["level"], x["prefix"], packed(np.full(b - a, cell), digit[a:b], n[a:b])))
    return out


def answered(series, m, at, level, prefix, cells, blobs):
    """The states under one prefix of all cells that asked for it."""
    cells = np.array(cells, np.int64)
    return [(series, m, at, int(j), s.tobytes()) for j, s in zip(cells, middles(at, m, numbers(b"".join(blobs), 3), level + 1, cells), strict=True)]


def merged(asks_of: Callable) -> Callable:
    """A cell's state with the prefixes that it asked for replaced by what is under them, and what it asks for next."""

    def run(series, m, chunk, cell, state, asks, extra, blobs):
        s, a = numbers(state, 4), numbers(asks, 2)
        gone = (s[:, 0, None] == a[None, :, 0]) & (s[:, 1, None] == a[None, :, 1])
        s = np.concatenate([s[~gone.any(1)], *(numbers(b, 4) for b in blobs or [])])
        return [(series, m, chunk, cell, s.tobytes(), asks_of(s, extra)[:, :2].tobytes())]

    return run


def descended(states: DataFrame, cells: DataFrame, medians: DataFrame | None, asks_of: Callable) -> DataFrame:
    """Rounds until no cell asks for more; one for each level at most. The last states are stored."""
    while states.where("length(asks) > 0").limit(1).count():
        asking = states.where("length(asks) > 0").select("series", "m", "chunk", "cell", "asks").mapInArrow(*by_rows(spread, f"{CELL}, level int, prefix long"))
        asking = stored(asking.groupBy("series", "m", "chunk", "level", "prefix").agg(F.collect_list("cell").alias("cells")), "asking")
        wanted = asking.groupBy("series", "chunk").agg(F.collect_list(F.struct("level", "prefix")).alias("wanted")).withColumnRenamed("chunk", "at")
        met = cells.select("series", "m", "cell", "cents", F.explode(F.array("chunk", F.col("chunk") + 1)).alias("at")).join(wanted, ["series", "at"])
        met = met.select("series", "m", "cell", "cents", "at", "wanted").mapInArrow(*by_rows(picked, "series string, m int, chunk long, level int, prefix long, blob binary"))
        met = met.groupBy("series", "m", "chunk", "level", "prefix").agg(F.collect_list("blob").alias("blobs"))
        rows = asking.join(met, ["series", "m", "chunk", "level", "prefix"]).select("series", "m", "chunk", "level", "prefix", "cells", "blobs").mapInArrow(*by_rows(answered, f"{CELL}, blob binary"))
        keys = ["series", "m", "chunk", "cell"]
        rows = rows.groupBy(*keys).agg(F.collect_list("blob").alias("blobs"))
        extra = states.join(medians.select(*keys, "medians"), keys) if medians is not None else states.withColumn("medians", F.lit(None).cast("binary"))
        after = extra.join(rows, keys, "left").select(*keys, "state", "asks", "medians", "blobs")
        after = stored(after.mapInArrow(*by_rows(merged(asks_of), STATE)), "states")
        drop_stored(asking)
        drop_stored(states)
        states = after
    return states


# ---------------------------------------------------------------- queries of a cell


class Edges:
    """The two cells that a cell's windows differ in: for each query, how many of their first i points by value it has."""

    def __init__(self, times: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.value, self.among = value, np.zeros((len(times), len(value) + 1), np.int32)
        a, b = np.searchsorted(times, first), np.searchsorted(times, last, side="right")  # the queries that have a point
        narrow = np.int16 if len(times) < 1 << 15 else np.int32
        q = np.arange(len(times), dtype=narrow)[:, None]
        np.cumsum((q >= a.astype(narrow)) & (q < b.astype(narrow)), 1, out=self.among[:, 1:])


def slices(times: np.ndarray, us: np.ndarray, cents: np.ndarray, us0: np.ndarray, cents0: np.ndarray) -> Iterator[tuple[slice, Edges]]:
    """The queries in order, in runs for which the counts take at most MATRIX numbers, with their edges."""
    own, old = cents != NONE, cents0 != NONE
    value = np.concatenate([cents[own], cents0[old]])
    order = np.argsort(value, kind="stable")
    far = np.iinfo(np.int64)
    first = np.concatenate([us[own], np.full(old.sum(), far.min)])[order]  # a point is in the windows of queries from first to last
    last = np.concatenate([np.full(own.sum(), far.max), us0[old] + WIDE])[order]
    step = max(1, MATRIX // (len(value) + 1))
    for i in range(0, len(times), step):
        part = slice(i, i + step)
        yield part, Edges(times[part], value[order], first, last)


def blocks(times: np.ndarray, us: np.ndarray, cents: np.ndarray, us0: np.ndarray, cents0: np.ndarray) -> Iterator[tuple[slice, np.ndarray, Edges]]:
    """Runs of queries in order, the cents of both cells that all of a run's windows hold, sorted, and those that they differ in."""
    held = np.concatenate([cents0, cents])
    at = np.flatnonzero(held != NONE)
    at = at[np.argsort(held[at], kind="stable")]
    value, at = held[at], at.astype(np.int32)
    come, gone = np.searchsorted(us, times, side="right"), np.searchsorted(us0, times - WIDE)  # a window's points in order of time
    run = (np.arange(1, len(times) + 1) + come + gone) // STEP
    i = 0
    for j in np.append(np.flatnonzero(np.diff(run)) + 1, len(times)):
        a, b, c, d = come[i], come[j - 1], gone[i], gone[j - 1]
        inside = value[(at >= d) & (at < len(us0) + a)]
        for part, edges in slices(times[i:j], us[a:b], cents[a:b], us0[c:d], cents0[c:d]):
            yield slice(i + part.start, min(i + part.stop, j)), inside, edges
        i = j


def merged_counts(inside: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cents inside and the middle's values in order, and how many points there are up to each."""
    if not len(value):
        return inside, np.arange(1, len(inside) + 1)
    order = np.argsort(value, kind="stable")
    at = np.searchsorted(inside, value[order])
    return np.insert(inside, at, value[order]), np.cumsum(np.insert(np.ones(len(inside), np.int64), at, count[order]))


def medians_of(state: np.ndarray, inside: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """(n, the doubled median) of each query; 0 where n < LEAST."""
    n = int(state[:, 2].sum()) + len(inside) + edges.among[:, -1].astype(np.int64)
    out, some = np.zeros(len(n), np.int64), np.flatnonzero(n >= LEAST)
    if not len(some):
        return n, out
    q, rank = np.concatenate([some, some]), np.concatenate([(n[some] + 1) // 2, n[some] // 2 + 1])
    value, upto = merged_counts(inside, bounds(state[:, 0], state[:, 1])[1], state[:, 2])
    i, j = np.searchsorted(upto, [rank.min() - len(edges.value), rank.max()])  # the edges move ranks by no more than their number
    before, count = (upto[i - 1] if i else 0), np.diff(upto[i : j + 1], prepend=upto[i - 1] if i else 0)
    value = np.concatenate([edges.value, value[i : j + 1]])
    order = np.argsort(value, kind="stable")
    value, mine = value[order], np.cumsum(order < len(edges.value))
    middle = before + np.cumsum(np.concatenate([np.zeros(len(edges.value), np.int64), count])[order])
    a, b = np.zeros(len(q), np.int64), np.full(len(q), len(value) - 1)  # the first place with at least rank points
    for _ in range(max(len(value) - 1, 1).bit_length()):
        at = (a + b) // 2
        enough = middle[at] + edges.among[q, mine[at]] >= rank
        a, b = np.where(enough, a, np.minimum(at + 1, b)), np.where(enough, at, b)
    out[some] = value[b[: len(some)]] + value[b[len(some) :]]
    return n, out


def first_enough(enough: Callable, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least whole numbers from a to b for which enough holds; b if it holds for none."""
    while (a < b).any():
        r = a + (b - a) // 2
        yes = enough(r)
        a, b = np.where(yes, a, np.minimum(r + 1, b)), np.where(yes, r, b)
    return b


def radii_of(state: np.ndarray, inside: np.ndarray, edges: Edges, medians: np.ndarray, bracket: tuple[int, int] | None) -> np.ndarray:
    """The doubled median of |2 * cents - median2| of each query; 0 where n < LEAST. bracket: what bounds it, if state isn't empty."""
    n, centre = medians[:, 1], medians[:, 2]
    some = np.flatnonzero(n >= LEAST)
    out = np.zeros(len(n), np.int64)
    if not len(some):
        return out
    low, upto = merged_counts(inside, bounds(state[:, 0], state[:, 1])[0], state[:, 2])
    upto = np.append(0, upto)
    rank = np.concatenate([(n[some] + 1) // 2, n[some] // 2 + 1])
    q, c = np.concatenate([some, some]), np.concatenate([centre[some], centre[some]])
    c0, c1 = c.min(), c.max()
    if bracket is None:
        ends = np.concatenate([low[:1], low[-1:], edges.value[:1], edges.value[-1:]])
        bracket = 0, int(max(2 * ends.max() - c0, c1 - 2 * ends.min()))
    # what surely lies, and what may lie, as near to all medians of the run bounds their radii
    held = lambda x, y: upto[np.searchsorted(low, y >> 1, side="right")] - upto[np.searchsorted(low, -(-x >> 1))]
    reach, need = np.array([[c0, c1], [c1, c0]]), np.array([rank.min() - len(edges.value), rank.max()])
    bottom, top = first_enough(lambda r: held(reach[:, 0] - r, reach[:, 1] + r) >= need, *np.tile(np.array(bracket, np.int64)[:, None], 2))
    until = lambda v: upto[np.searchsorted(low, v, side="right")] + edges.among[q, np.searchsorted(edges.value, v, side="right")]
    b = first_enough(lambda r: until((c + r) >> 1) - until(-((r - c) >> 1) - 1) >= rank, np.full(len(q), bottom), np.full(len(q), max(bottom, top)))
    out[some] = b[: len(some)] + b[len(some) :]
    return out


def centred(series, m, chunk, cell, us, cents, us0, cents0, state):
    """A cell's queries (us, n, median2), and what it asks for their radii."""
    us, s = numbers(us), numbers(state, 4)
    times = np.unique(us)
    found = np.zeros((len(times), 3), np.int64)
    found[:, 0] = times
    for part, inside, edges in blocks(times, us, numbers(cents), numbers(us0), numbers(cents0)):
        found[part, 1], found[part, 2] = medians_of(s, inside, edges)
    return [(series, m, chunk, cell, state, radius_range(s, found)[0][:, :2].tobytes(), found.tobytes())]


OUT = "click_id long, kind string, n long, median2 long, mad4 long, far boolean"


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of cells' clicks. Without medians, which are found here then, a cell has no middle."""
    for batch in batches:
        for series, us, cents, ids, us0, cents0, state, medians in each_row(batch):
            us, cents, ids, s = numbers(us), numbers(cents), numbers(ids), numbers(state, 4)
            if medians is None:
                times = np.unique(us)
                med = np.stack([times, *np.zeros((2, len(times)), np.int64)], 1)
            else:
                med = numbers(medians, 3)
            mad, bracket = np.zeros(len(med), np.int64), radius_range(s, med)[1:] if len(s) else None
            for part, inside, edges in blocks(med[:, 0], us, cents, numbers(us0), numbers(cents0)):
                if medians is None:
                    med[part, 1], med[part, 2] = medians_of(s, inside, edges)
                mad[part] = radii_of(s, inside, edges, med[part], bracket)
            at = np.searchsorted(med[:, 0], us)
            n, median, mad = med[at, 1], med[at, 2], mad[at]
            few, bare = n < LEAST, cents == NONE
            far = 2 * np.abs(2 * np.where(bare, 0, cents) - median) > 5 * mad
            columns = [pa.array(ids, mask=ids == NONE), pa.array([series[1:] if series else None] * len(us), pa.string()), pa.array(n), pa.array(median, mask=few), pa.array(mad, mask=few), pa.array(far, mask=few | bare)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])
        give_back()


def rolling(clicks: DataFrame) -> DataFrame:
    """(click_id, kind, n, median2, mad4, far) of every click with a time.

    clicks has click_id, ts, kind and value. Of rows with one click_id the least (ts, kind, cents) counts, a null
    click_id being one; rows without a time are dropped. Cents are floor(100 * value + 0.5), none for null, NaN,
    infinite and values of 2^59 cents or more. A click's window are the clicks of its kind (null is a kind) up to
    360 minutes before, its own time included whole. n counts the window's cents, median2 is the sum of its two middle
    ones (twice the only one), mad4 the same of |2 * cents - median2|; below five cents these are null. far says
    whether twice the click's own distance exceeds five times mad4, null without cents. An empty table gives an empty
    one; other columns, of any names, are ignored. Times are read without a zone.

    Equal times can't be parted: the clicks of one kind and microsecond are in one cell.
    """
    cells = cells_of(clicks.select("click_id", "ts", "kind", "value"))
    before = cells.select("series", (F.col("cell") + F.col("m")).alias("cell"), F.col("us").alias("us0"), F.col("cents").alias("cents0"))
    both = cells.join(before, ["series", "cell"], "left")
    none = F.lit(None).cast("binary")
    rows, made = [both.where("m = 1").withColumns({"state": none, "medians": none})], [cells]
    if cells.where("m > 1").limit(1).count():
        more, also = with_middles(cells.where("m > 1"), both.where("m > 1"))
        rows, made = [*rows, more], [*made, *also]
    rows = reduce(DataFrame.unionByName, [r.select("series", "us", "cents", "id", "us0", "cents0", "state", "medians") for r in rows])
    out = stored(rows.mapInArrow(finished, OUT), "rolling")
    for x in made:
        drop_stored(x)
    return out


def with_middles(cells: DataFrame, both: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of both with state and medians, of cells of which several make a window; the tables that they are read from."""
    keys = ["series", "m", "chunk", "cell"]
    states = descended(first_states(cells), cells, None, lambda s, _: median_asks(s))
    rows = both.join(states.select(*keys, "state"), keys).select(*keys, "us", "cents", "us0", "cents0", "state")
    found = stored(rows.mapInArrow(*by_rows(centred, f"{STATE}, medians binary")), "medians")
    drop_stored(states)
    states = descended(found.select(*keys, "state", "asks"), cells, found, lambda s, extra: radius_range(s, numbers(extra, 3))[0])
    return both.join(states.select(*keys, "state"), keys).join(found.select(*keys, "medians"), keys), [states, found]


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click's window: its number of cents, doubled median and radius, and whether the click is far off."""
    return rolling(table(spark, sf_dir, "clicks").select("click_id", "ts", "kind", "value"))


OP12_SQL = """
WITH c AS (SELECT DISTINCT ON (click_id) click_id, ts, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS c FROM clicks WHERE ts IS NOT NULL ORDER BY click_id, ts, kind, value),
w AS (SELECT click_id, kind, c, list_sort(coalesce(list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW), [])) AS l FROM c),
m AS (SELECT *, CAST(len(l) AS BIGINT) AS n, CASE WHEN len(l) >= 5 THEN l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] END AS median2 FROM w),
d AS (SELECT *, list_sort([abs(2 * x - median2) FOR x IN l]) AS r FROM m),
e AS (SELECT *, CASE WHEN n >= 5 THEN r[(n + 1) // 2] + r[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * c - median2) > 5 * mad4 AS far FROM e
"""
