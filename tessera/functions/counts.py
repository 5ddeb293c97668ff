"""Words and terms of whole texts, counted in Arrow batches.

They are those of `operators.index.words` and `functions.text.terms`, which take them as column functions; lambdas there are
interpreted for every token, so that whole tables of texts are counted here.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa

from .text import LEAST_BYTES, TERM_STOPWORDS

#: Runs of what Python calls a letter or a digit, which may be more than letters and decimal digits; the same with underscores.
WORD, FIELD = re.compile(r"[^\W_]+"), re.compile(r"\w+")
STOP = frozenset(TERM_STOPWORDS)


def plain(w: str) -> bool:
    """Whether a run has letters, decimal digits and underscores alone."""
    return w.isascii() or w.isalpha() or all(map(belongs, w))


def belongs(c: str) -> bool:
    kind = unicodedata.category(c)
    return c == "_" or kind == "Nd" or kind[0] == "L"


def pieces(w: str) -> list[str]:
    """What is left of a run without other numerals."""
    return "".join(c if belongs(c) else " " for c in w).split()


def word_counts(text: str) -> Counter:
    """How often each word stands in a text."""
    found = Counter(WORD.findall(text.lower()))
    for w in [w for w in found if not plain(w)]:
        n = found.pop(w)
        for p in pieces(w):
            found[p] += n
    return found


def identifier_parts(w: str) -> list[str]:
    """functions.text.identifier_parts."""
    kinds = [unicodedata.category(c) for c in w] + [""]
    out = ""
    for i, c in enumerate(w):
        if i and kinds[i] == "Lu" and (kinds[i - 1] in ("Ll", "Nd") or kinds[i - 1] == "Lu" and kinds[i + 1] == "Ll"):
            out += "_"
        out += c
    return [p for p in out.split("_") if p]


@lru_cache(1 << 16)
def terms_of(w: str) -> tuple[str, ...]:
    """The terms that a run of letters, digits and underscores gives."""
    if not plain(w):
        return tuple(t for p in pieces(w) for t in terms_of(p))
    low = w.lower()
    out = [low]
    if w != low or "_" in w:
        parts = [p.lower() for p in identifier_parts(w)]
        out += [p for p in parts if p != low] if len(parts) >= 2 else []
    return tuple(t for t in out if len(t.encode()) >= LEAST_BYTES and t not in STOP)


def term_counts(text: str) -> dict[str, int]:
    """How often each term stands in a text."""
    out: dict[str, int] = {}
    for w, n in Counter(FIELD.findall(text)).items():
        low = w.lower()
        if "_" in w or w[1:] != low[1:] or not (w.isascii() or w.isalpha()):
            for t in terms_of(w):
                out[t] = out.get(t, 0) + n
        elif (len(low) >= LEAST_BYTES or len(low.encode()) >= LEAST_BYTES) and low not in STOP:  # a word without borders is its own term
            out[low] = out.get(low, 0) + n
    return out


def texts(column: pa.Array) -> Iterator[str]:
    """A column's texts; null: empty, and what isn't UTF-8 replaced."""
    return ("" if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist())


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def listed(sizes: list[int], **columns: pa.Array) -> pa.Array:
    """An array of lists of structs, of so many each."""
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def of_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """heading and body of each row become len, their number of words, and ws: each word in order, how often in the heading (heads), and in both (n)."""
    for b in slices(batches):
        ws: list[str] = []
        heads: list[int] = []
        ns: list[int] = []
        lens, sizes = [], []
        for h, x in zip(texts(b.column("heading")), texts(b.column("body")), strict=True):
            top, all_ = word_counts(h), word_counts(x)
            for w, n in top.items():
                all_[w] = all_.get(w, 0) + n
            order = sorted(all_)
            ws += order
            ns += map(all_.__getitem__, order)
            heads += map(top.get, order, repeat(0))
            lens.append(all_.total())
            sizes.append(len(order))
        made = listed(sizes, word=pa.array(ws, pa.string()), heads=pa.array(heads, pa.int32()), n=pa.array(ns, pa.int32()))
        kept = b.drop_columns(["heading", "body"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lens, pa.int64()), made], names=[*kept.schema.names, "len", "ws"])


def of_terms(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """heading and body of each row become v: the most frequent terms of both, ties by term, and how often each stands there."""
    for b in slices(batches):
        ts: list[str] = []
        ns: list[int] = []
        sizes = []
        for h, x in zip(texts(b.column("heading")), texts(b.column("body")), strict=True):
            found = term_counts(f"{h}\n{x}")
            top = sorted(sorted(found), key=found.__getitem__, reverse=True)[:most]  # a reversed sort keeps the order of equals
            ts += top
            ns += map(found.__getitem__, top)
            sizes.append(len(top))
        made = listed(sizes, term=pa.array(ts, pa.string()), tf=pa.array(ns, pa.int64()))
        kept = b.drop_columns(["heading", "body"])
        yield pa.RecordBatch.from_arrays([*kept.columns, made], names=[*kept.schema.names, "v"])
