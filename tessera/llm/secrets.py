"""Secret scans by grammar inference.

The labelled credentials are what the base patterns find. From a bounded sample of them a prefix tree is built, and its
states are merged where their next-character statistics are compatible (Hoeffding bounds, red-blue order), which leaves
a probabilistic automaton. Every candidate string of the corpus, of the length and characters that a credential may
have, is then scored: the log-likelihood that the automaton gives to the whole string and its end, against that of the
corpus' ordinary candidates under an order-1 model. Candidates whose format fits the automaton are added to the base
spans, which always stay.

The texts are read twice: once for the two samples, and once to find and score.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, strings, table

#: Fixed values of the base formats.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api_key", "apikey")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")
#: A candidate is a run of credential characters as long as the shortest credential, or longer; and how many such characters there are.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LETTERS = 68
#: Bounds on what is learned from: distinct labelled credentials and distinct candidates, the ones of the smallest
#: hashes. Longer credentials than LONGEST are not learned from; none is cut, and candidates of any length are scored.
SAMPLE_ROWS, LONGEST = 2000, 1024
#: Confidence of the merge test; the chance to leave the automaton at a character; and the log-likelihood ratio, per
#: character and in all, that makes a candidate a secret.
ALPHA, ESCAPE, RATIO, LEAST_RATIO = 0.05, 1e-9, 0.1, 10.0
#: Strings that must have passed two states of different depths before they may be one; and what a letter counts that a
#: state has not seen, if it has seen several others of its kind.
EVIDENCE, UNSEEN = 30, 0.1
#: Kinds of letters.
KIND_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
#: Scores that a task remembers.
REMEMBERED = 100_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches in order; the value's own start is not part of it."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def label_of(text: str, span: tuple[int, int, int]) -> str:
    """The credential itself in a base match."""
    part = text[span[0] : span[2]]
    return ASSIGN.match(part).group(2) if span[1] == 0 else part


def smallest(texts: set[str]) -> list[str]:
    """The SAMPLE_ROWS strings of the smallest hashes: a sample that doesn't depend on how texts are dealt."""
    return sorted(texts, key=lambda x: (zlib.crc32(x.encode()), x))[:SAMPLE_ROWS]


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text): samples of each batch's labelled credentials, and of its other candidates."""
    for batch in batches:
        labels, others = set(), set()
        for text in strings(batch, "text").to_pylist():
            base = base_spans(text)
            labels.update(x for x in (label_of(text, s) for s in base) if len(x) <= LONGEST)
            others.update(c for _, _, c in candidates(text, base) if len(c) <= LONGEST)
            if len(others) > 8 * SAMPLE_ROWS:
                others = set(smallest(others))
        parts = [(True, x) for x in smallest(labels)] + [(False, x) for x in smallest(others)]
        yield pa.RecordBatch.from_pydict({"label": pa.array([k for k, _ in parts], pa.bool_()), "text": pa.array([x for _, x in parts], pa.string())})


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of the candidates that overlap no base span, which come in order of start."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, z = m.span()
        while i < len(base) and base[i][0] < z:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append((a, z, m.group()))
    return out


# ---------------------------------------------------------------- grammar inference


class Automaton:
    """A probabilistic automaton; state 0 is the start. arcs[s][c] = (next state, log probability); stop[s] likewise.

    At each character it may be left, by the chance ESCAPE, for good: all characters and the end are alike from there on.
    So any string has a likelihood, and those of all strings sum to one.
    """

    def __init__(self, arcs: list[dict[str, tuple[int, float]]], stop: list[float]) -> None:
        self.arcs, self.stop = arcs, stop

    def likelihood(self, text: str) -> float:
        """The log-likelihood of a string and its end."""
        s, total = 0, 0.0
        for k, c in enumerate(text):
            step = self.arcs[s].get(c)
            if step is None:
                return total + math.log(ESCAPE) - (len(text) - k + 1) * math.log(LETTERS + 1)
            s, p = step
            total += p + STAY
        return total + STAY + self.stop[s] if self.stop[s] > -math.inf else total + math.log(ESCAPE) - math.log(LETTERS + 1)


STAY = math.log(1 - ESCAPE)


def learn(samples: list[str], alpha: float = ALPHA) -> Automaton:
    """Merges compatible states of the samples' prefix tree into a probabilistic automaton.

    States of one depth are one unless their statistics tell them apart; states of different depths only where enough
    strings bear it out. So few samples give an automaton that knows the lengths of its strings, and many one with loops.
    """
    ends, depth = [0], [0]
    arcs: list[dict[str, list[int]]] = [{}]  # character -> [state, count]
    for text in sorted(samples):
        s = 0
        for c in text:
            if c not in arcs[s]:
                arcs[s][c] = [len(arcs), 0]
                arcs.append({})
                ends.append(0)
                depth.append(depth[s] + 1)
            arcs[s][c][1] += 1
            s = arcs[s][c][0]
        ends[s] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def size(s: int) -> int:
        return ends[s] + sum(n for _, n in arcs[s].values())

    def compatible(a: int, b: int) -> bool:
        first, todo = (a, b), [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = size(a), size(b)
            if depth[a] != depth[b] and min(n, m) < EVIDENCE and (a, b) == first:
                return False
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most >= 1:  # too few strings to tell; fewer still below
                continue
            if abs(ends[a] / n - ends[b] / m) > most:
                return False
            for c in arcs[a].keys() | arcs[b].keys():
                x, y = arcs[a].get(c, (None, 0)), arcs[b].get(c, (None, 0))
                if abs(x[1] / n - y[1] / m) > most:
                    return False
                if x[0] is not None and y[0] is not None and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            for c, (y, n) in arcs[b].items():
                if c in arcs[a]:
                    arcs[a][c][1] += n
                    todo.append((arcs[a][c][0], y))
                else:
                    arcs[a][c] = [y, n]

    red = {0: 0}  # state -> number in the automaton
    while blue := sorted((-arcs[r][c][1], i, c, r) for r, i in red.items() for c in arcs[r] if arcs[r][c][0] not in red):
        _, _, c, r = blue[0]
        b = arcs[r][c][0]
        for x in red:
            if compatible(x, b):
                arcs[r][c][0] = x
                fold(x, b)
                break
        else:
            red[b] = len(red)
    out, stop = [], []
    for r in red:
        seen = {c: (red[x], float(n)) for c, (x, n) in sorted(arcs[r].items())}
        for letters in KIND_LETTERS:
            known = [seen[c] for c in letters if c in seen]
            if len(known) > 1:  # an unseen letter goes where most of its kind go
                most = Counter()
                for x, n in known:
                    most[x] += n
                to = max(most, key=lambda x: (most[x], -x))
                seen |= {c: (to, UNSEEN) for c in letters if c not in seen}
        whole = ends[r] + sum(n for _, n in seen.values()) or 1
        out.append({c: (x, math.log(n / whole)) for c, (x, n) in seen.items()})
        stop.append(math.log(ends[r] / whole) if ends[r] else -math.inf)
    return Automaton(out, stop)


class Background:
    """An order-1 character model of ordinary candidates and their ends, with add-one smoothing."""

    def __init__(self, samples: list[str]) -> None:
        pairs, firsts = Counter(), Counter()
        for text in samples:
            pairs.update(zip("^" + text, text + "$", strict=True))
            firsts.update("^" + text)
        self.logs = {p: math.log((n + 1) / (firsts[p[0]] + LETTERS + 1)) for p, n in pairs.items()}
        self.rest = {c: math.log(1 / (n + LETTERS + 1)) for c, n in firsts.items()}

    def likelihood(self, text: str) -> float:
        """The log-likelihood of a string and its end."""
        flat = -math.log(LETTERS + 1)
        return sum(self.logs.get(p) or self.rest.get(p[0], flat) for p in zip("^" + text, text + "$", strict=True))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long"


def fits(automaton: Automaton, background: Background, ratio: float, text: str) -> bool:
    """Whether the automaton explains a candidate better than ordinary text does, by enough."""
    more = automaton.likelihood(text) - background.likelihood(text)
    return more >= max(LEAST_RATIO, ratio * (len(text) + 1))


def scored(automaton: Automaton | None, background: Background, ratio: float):
    """An Arrow function: the result's rows of documents. Without an automaton there are base spans alone."""

    def told(spans: list[tuple[int, str, int]]) -> str:
        order = {k: i for i, k in enumerate((*KINDS, "inferred"))}
        return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], order[x[1]], x[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def secret(c: str) -> bool:
            found = known.get(c)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = fits(automaton, background, ratio, c)
                if len(c) <= LONGEST:
                    known[c] = found
            return found

        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inferred")}
            for text in strings(batch, "text").to_pylist():
                found = base_spans(text)
                base = [(a, KINDS[k], z) for a, k, z in found]
                more = [(a, "inferred", z) for a, z, c in candidates(text, found) if secret(c)] if automaton else []
                kinds = Counter(k for _, k, _ in base)
                for k in KINDS:
                    out[f"n_{k}"].append(kinds[k])
                out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
                out["spans"].append(told(base + more))
                out["n_inferred"].append(len(more))
            types = {k: pa.string() if k in ("base_sha256", "spans") else pa.int64() for k in out}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), **{k: pa.array(v, types[k]) for k, v in out.items()}})

    return run


def infer(docs: DataFrame) -> tuple[Automaton | None, Background]:
    """The automaton of the credentials in docs' texts (none, if there are none), and the model of other candidates."""
    found = stored(docs.select("text").mapInArrow(sampled, "label boolean, text string").distinct(), "samples")
    sets = {True: set(), False: set()}
    for label in sets:
        rows = found.where(F.col("label") == label).orderBy(F.crc32(F.encode("text", "UTF-8")), "text").limit(SAMPLE_ROWS)
        sets[label] = {r.text for r in rows.collect()}  # SAMPLE_ROWS at most
    drop_stored(found)
    labels = smallest(sets[True])
    return learn(labels) if labels else None, Background(smallest(sets[False]))


def scan(docs: DataFrame, ratio: float = RATIO, learned_from: DataFrame | None = None) -> DataFrame:
    """The secrets of every whole text: counts of the base kinds, a digest of the base spans, and all spans.

    docs has doc_id and text; other columns are ignored. learned_from gives other texts to learn from than docs' own.
    Spans are kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex, inferred). Null
    and empty texts have none: zero counts and empty strings. Repeated rows give repeated rows; an empty table, or one
    without labelled credentials, adds no inferred spans.
    """
    automaton, background = infer(docs if learned_from is None else learned_from)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored(automaton, background, ratio), OUT)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return scan(table(spark, sf_dir, "documents"))
