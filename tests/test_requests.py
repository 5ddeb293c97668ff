"""Batches of request events into three tables: replayed, killed and merged ones."""

import datetime

import pytest

from tessera.streaming import requests
from tessera.streaming.requests import EVENT, RequestLog


def at(s):
    return datetime.datetime(2024, 1, 1, 0, 0, s)


def event(i, second=0, tool="search", estimated=None, returned=None, roots=(), evidence=(), version=None, session="s"):
    r = [(k, n, None, " ", sel) for k, n, sel in roots]
    e = [("curated", k, "a", "u", p, True, None, 3) for p, k in enumerate(evidence)]
    return (i, at(second), session, tool, "ok", "", estimated, returned, version, r or None, e)


def state(log):
    rows = lambda name: sorted(tuple(r) for r in log.table(name).collect())
    return {r[0]: r[1:] for r in rows("requests")}, [r[:3] + r[5:] for r in rows("roots")], [(r[0], r[2]) for r in rows("evidence")]


def test_batches_replace_replay_and_merge(spark, tmp_path):
    log = RequestLog(spark, f"file://{tmp_path}/log")
    df = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    assert state(log) == ({}, [], [])
    first = df(
        event("a", 1, estimated=7, roots=[("k", "", True), ("", "n", None)], evidence=["x", "y"]),
        event("a", 0, estimated=9, evidence=["gone"]),
        event(None, 2),
        event("b", 1, returned=5, version="own", session=" "),
        event("b", 1, returned=5, version="own", session=" "),
    )
    assert log.append(first, "w", 0)
    assert not log.append(first, "w", 0)  # run again
    got = state(log)
    assert got[0] == {"a": (at(1), "s", "search", "ok", None, 7, 7, "chars_div_4_v1"), "b": (at(1), None, "search", "ok", None, 5, 5, "own")}
    assert got[1] == [("a", "k", "k", True), ("a", "n", "n", False)]
    assert got[2] == [("a", "x"), ("a", "y")]
    assert [tuple(r)[1:] for r in log.table("counts").collect()] == [(5, 1, 2)]
    assert log.append(df(event("a", 0, tool="later", evidence=["z"])), "w", 1)  # replaces the request with all its parts
    assert log.append(df(event("c")), "other", 0)
    assert log.append(df(), "w", 2)
    got = state(log)
    assert got[0]["a"] == (at(0), "s", "later", "ok", None, 0, 0, None) and sorted(got[0]) == ["a", "b", "c"]
    assert (got[1], got[2]) == ([], [("a", "z")])
    assert not log.compact(4) and log.compact(3) and len(log.runs()) == 1
    assert state(log) == got and log.table("counts").count() == 4
    assert log.written("w") == 2 and not log.append(first, "w", 1) and not log.append(first, "other", 0)
    assert log.append(df(event("d")), "w", 3) and sorted(state(log)[0]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        log.append(first, "", 0)


@pytest.mark.parametrize("when", ["roots", "publish", "published"])
def test_a_killed_batch_is_made_good(spark, tmp_path, monkeypatch, when):
    """A stream that dies while a batch is written, before or just after it is named, leaves the same tables in the end."""
    source, log = f"{tmp_path}/in", RequestLog(spark, f"file://{tmp_path}/log")
    for k in range(3):
        rows = [event(f"r{k}", evidence=["e"]), event("shared", k, tool=f"t{k}", evidence=[f"e{k}"])]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: requests.record(stream(), log.folder, f"file://{tmp_path}/checkpoint", after=2)
    real, calls = {"parts": requests.parts, "publish": RequestLog.publish}, []

    def dies(*a):
        calls.append(1)
        if when == "published":
            real["publish"](*a)
        elif len(calls) != 2:
            return real["parts" if when == "roots" else "publish"](*a)
        if len(calls) == 2:
            raise RuntimeError("killed")

    if when == "roots":
        monkeypatch.setattr(requests, "parts", dies)
    else:
        monkeypatch.setattr(RequestLog, "publish", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.undo()
    run()
    run()
    found, _, evidence = state(log)
    assert sorted(found) == ["r0", "r1", "r2", "shared"]
    assert found["shared"][2] in {"t0", "t1", "t2"} and ("shared", f"e{found['shared'][2][1]}") in evidence and len(evidence) == 4
    assert sum(r.rows for r in log.table("counts").collect()) == 6


def test_one_run_is_read_as_it_is(spark, tmp_path):
    """A merged log is read without looking for each request's latest run."""
    log = RequestLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([event("a", 1, evidence=["x"]), event("a", 2, evidence=["y", "z"]), event("b", 1)], EVENT)
    assert log.append(rows, "w", 0)
    plan = log.table("evidence")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((r[0], r[2]) for r in log.table("evidence").collect()) == [("a", "y"), ("a", "z")]
