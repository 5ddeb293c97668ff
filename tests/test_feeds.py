"""Change feeds against a plain model, in parts and as a whole."""

import random

from tessera.operators import feeds


def model(files, changes):
    """The same by walking through commits; files: path -> (seq, origin, moves)."""
    lives = {p: [(-1, o, m)] for p, (_, o, m) in files.items()}  # the beginnings of each path
    state = {p: s for p, (s, _, _) in files.items()}
    known = set(files)  # paths whose last beginning came after their last deletion
    for seq in sorted({s for s, _ in changes}):
        gone, begun, touched = set(), {}, set()
        for line in (x for s, x in changes if s == seq):
            p = line.strip(" ").split("\t")
            if p[0][0] in "D" and len(p) > 1:
                gone.add(p[1])
            elif p[0][0] in "MT" and len(p) > 1:
                touched.add(p[1])
            elif p[0][0] == "A" and len(p) > 1:
                begun.setdefault(p[1], "")
            elif p[0][0] == "R" and len(p) > 2:
                gone.add(p[1])
                begun[p[2]] = max(begun.get(p[2], ""), p[1])
        before = {p: v[-1] for p, v in lives.items()}
        for p in gone - set(begun) - touched:
            state.pop(p, None)
            known.discard(p)
        for p, source in begun.items():
            old = before.get(source) if source else None
            lives.setdefault(p, []).append((seq, *((old[1], old[2] + 1) if old else (source or p, int(bool(source))))))
            known.add(p)
        for p in set(begun) | touched:
            state[p] = seq
    return {p: (s, *(lives[p][-1][1:] if p in known else (p, 0))) for p, s in state.items()}


def test_feeds_equal_a_model(spark, monkeypatch):
    monkeypatch.setattr(feeds, "STRETCH", 3)
    rng = random.Random(4)
    lines = []
    for seq in range(40):
        for _ in range(rng.randrange(5)):
            a, b = rng.choice("abcdefh"), rng.choice("abcdefgh")
            lines.append((seq, rng.choice(["A\t" + a, "M\t" + a, "T\t" + a, "D\t" + a, f"R100\t{a}\t{b}", f"R9\t{a}\t{b}", f"C75\t{a}\t{b}", "", "A", "R100\t" + a])))
    lines = [(s, x) for s, x in lines if x]
    df = lambda rows: spark.createDataFrame(rows, "seq long, line string")
    start = {"a": (-1, "a0", 2), "z": (-1, "z", 0)}
    files = spark.createDataFrame([(p, *v) for p, v in start.items()], feeds.FILES)
    rows = lambda d: {r.path: (r.seq, r.origin, r.moves) for r in d.collect()}
    expected = model(start, lines)
    whole = feeds.applied(files, df(lines + lines[:9] + [(3, None), (None, "A\tq"), (4, "")]))
    assert rows(whole) == expected and whole.count() == len(expected)
    parts = feeds.applied(feeds.applied(files, df([x for x in lines if x[0] < 17])), df([x for x in lines if x[0] >= 17]))
    assert rows(parts) == expected
    assert rows(feeds.applied(files, df([]))) == start


def test_long_chains_swaps_and_scans(spark):
    df = lambda rows: spark.createDataFrame(rows, "seq long, line string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    none = spark.createDataFrame([], feeds.FILES)
    chain = [(0, "A\tf0"), *((k, f"R100\tf{k - 1}\tf{k}") for k in range(1, 300))]
    assert rows(feeds.applied(none, df(chain))) == [("f299", 299, "f0", 299)]
    swap = feeds.applied(none, df([(0, "A\ta"), (0, "A\tb"), (1, "R100\ta\tb"), (1, "R100\tb\ta"), (2, "R100\tnowhere\tc")]))
    assert rows(swap) == [("a", 1, "b", 1), ("b", 1, "a", 1), ("c", 2, "nowhere", 1)]
    listing = spark.createDataFrame([("b",), ("c",), ("new",), ("new",), ("",), (None,)], "path string")
    assert rows(feeds.rescanned(swap, listing, 5)) == [("b", 1, "a", 1), ("c", 2, "nowhere", 1), ("new", 5, "new", 0)]
