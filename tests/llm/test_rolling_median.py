import datetime
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import rolling_median as rm

START = datetime.datetime(2024, 3, 10)
SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, level int, prefix string, state binary, m string"
COLUMNS = ("click_id", "kind", "n", "median2", "mad4", "far")


def doubled(xs):
    xs = sorted(xs)
    return xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]


def brute(rows):
    first = {}
    for i, ts, kind, value in rows:
        if ts is not None:
            c = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) and abs(100 * value + 0.5) < 2**59 else None
            key = (ts, kind is not None, kind or "", c is not None, c or 0)
            first[i] = min(first.get(i, (key, None)), (key, (ts, kind, c)), key=lambda x: x[0]) if i in first else (key, (ts, kind, c))
    series = defaultdict(list)
    for _, (ts, kind, c) in first.values():
        series[kind].append((ts, c))
    out = {}
    for i, (_, (ts, kind, c)) in first.items():
        own = [x for t, x in series[kind] if x is not None and ts - datetime.timedelta(minutes=360) <= t <= ts]
        if len(own) < 5:
            out[i] = (kind, len(own), None, None, None)
            continue
        m = doubled(own)
        r = doubled([abs(2 * x - m) for x in own])
        out[i] = (kind, len(own), m, r, None if c is None else 2 * abs(2 * c - m) > 5 * r)
    return out


def clicks(rng, n, hours, draw, kinds=("a", "a", "a", "b", None, "")):
    out = []
    for i in range(n):
        ts = START + datetime.timedelta(microseconds=rng.randrange(int(hours * 3600e6)))
        if out and rng.random() < 0.1:
            ts = out[-1][1] or ts  # ties
        if rng.random() < 0.05:
            ts = ts.replace(minute=0, second=0, microsecond=0)  # on the edges of cells, and exactly a window apart
        out.append((i, ts if rng.random() > 0.02 else None, rng.choice(kinds), draw(rng)))
    return out + [out[3], out[5], out[5]]


DRAWS = {
    "spread": lambda r: r.choice([None, round(math.exp(r.gauss(3, 2)), 2), -round(math.exp(r.gauss(2, 1)), 2), 0.0, -0.004]),
    "two far clusters": lambda r: r.choice([1.0, 5e9]) + r.randrange(1000) / 100,
    "one value": lambda r: 12.34,
    "huge": lambda r: r.choice([None, math.nan, math.inf, -math.inf, 1e300, r.uniform(-5e15, 5e15), r.uniform(0, 4e15), 3e8 + r.random()]),
    "few values": lambda r: r.choice([1.0, 1.01, 1.02, 7.0]),
}


def result(df):
    rows = df.collect()
    got = {r.click_id: tuple(r[c] for c in COLUMNS[1:]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("name,thin", [*((name, 0.4) for name in DRAWS), ("spread", 3)])
def test_rolling_equals_brute_force(spark, monkeypatch, name, thin):
    monkeypatch.setattr(rm, "THIN", thin)
    rng = random.Random(len(name))
    rows = clicks(rng, 500, 20, DRAWS[name])
    df = spark.createDataFrame([(*r, 1, "x", b"y", "z") for r in rows], SCHEMA).repartition(5)
    assert result(rm.rolling(df)) == brute(rows)


def test_rolling_takes_any_time_and_zone(spark):
    rng = random.Random(9)
    rows = [(i, datetime.datetime(1969, 12, 31, 20) + datetime.timedelta(minutes=rng.randrange(600)), "a", rng.random()) for i in range(200)]
    rows += [(1000 + i, datetime.datetime(2024, 3, 10, 1, 30) + datetime.timedelta(minutes=i), "a", rng.random()) for i in range(200)]  # a clock change in New York
    rows += [(None, START, "a", 1.0), (None, START, "a", 2.0), (-5, START, "a", 3.0)]
    df = spark.createDataFrame([(*r, 1, "x", b"y", "z") for r in rows], SCHEMA)
    want = brute(rows)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert result(rm.rolling(df)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rolling_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = rm.rolling(df)
    assert out.collect() == [] and tuple(out.columns) == COLUMNS
    none = spark.createDataFrame([(1, None, "a", 1.0, 1, "x", b"y", "z")], SCHEMA)
    assert rm.rolling(none).collect() == []


def test_runs_of_queries_count_alike(monkeypatch):
    rng = np.random.default_rng(3)
    us, us0 = np.sort(rng.integers(rm.WIDE, rm.WIDE + 500, 80)), np.sort(rng.integers(0, 500, 60))
    cents, cents0 = rng.integers(-9, 9, 80), rng.integers(-9, 9, 60)
    cents[::7] = rm.NONE
    times = np.unique(us)
    whole = next(rm.slices(times, us, cents, us0, cents0))[1]
    for q, t in enumerate(times):
        own = sorted([c for u, c in zip(us, cents) if u <= t and c != rm.NONE] + [c for u, c in zip(us0, cents0) if u >= t - rm.WIDE])
        assert whole.among[q, -1] == len(own)
        assert [v for v, n in zip(whole.value, np.diff(whole.among[q])) if n] == own
    monkeypatch.setattr(rm, "MATRIX", 500)
    parts = list(rm.slices(times, us, cents, us0, cents0))
    assert len(parts) > 5 and (np.concatenate([e.among for _, e in parts]) == whole.among).all()


def test_codes_keep_the_order():
    rng = np.random.default_rng(2)
    c = np.sort(np.concatenate([rng.integers(-(10**6), 10**6, 500), np.floor(rng.normal(size=500) * 1e17).astype(np.int64), np.arange(-70, 70)]))
    for level in range(len(rm.LEVELS)):
        p = rm.prefixes(rm.code(c), level)
        assert (np.diff(p) >= 0).all()
        low, high = rm.bounds(np.full(len(c), level), p)
        assert (low <= c).all() and (c <= high).all()
    assert (low == high).all()


def test_query_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW clicks AS SELECT * FROM read_parquet('{sf}/clicks.parquet')")
    q = duck.sql(rm.OP12_SQL)
    assert tuple(q.columns) == COLUMNS
    got = [tuple(r[c] for c in COLUMNS) for r in rm.op12_rolling_median(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == set(q.fetchall())


@pytest.mark.parametrize("name,thin,ms", [("spread", None, {1}), ("two far clusters", None, {1}), ("huge", 9, {1, 2})])
def test_some_thousand_points_of_a_window_are_one_cell(spark, monkeypatch, name, thin, ms):
    """No round is run for them; series of one cell and of several stand side by side."""
    monkeypatch.setattr(rm, "STEP", 50, raising=False)
    if thin:
        monkeypatch.setattr(rm, "THIN", thin)
    else:
        monkeypatch.setattr(rm, "descended", None)
    rows = clicks(random.Random(7), 600, 15, DRAWS[name])
    df = spark.createDataFrame([(*r, 1, "x", b"y", "z") for r in rows], SCHEMA).repartition(3)
    assert {r.m for r in rm.cells_of(df.select("click_id", "ts", "kind", "value")).select("m").collect()} == ms
    assert result(rm.rolling(df)) == brute(rows)
