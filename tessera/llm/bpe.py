"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over each text picks chunk borders from the content alone, so a passage that many documents share is
cut alike in all of them. What lies between a chunk's first and last ASCII white space (its core) is encoded once per
worker process and reused; the text astride a join, from the left chunk's last to the right chunk's first white space,
is encoded anew, with a word of context on either side. The repair holds when the context's own ids come back exactly;
else the window grows by a word each way and is encoded again, at worst to the whole text.

No shuffle is needed: documents stay where they are read, and equal chunks meet in the worker's bounded memo. What is
evicted from a memo is encoded again, so results never depend on it.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, give_back, inverse, powers, raw, strings, table

#: Bytes that the rolling hash sees.
WINDOW = 32
#: A border falls where the hash's top bits are 0: about every 1024 bytes.
TOP = np.uint64(64 - 10)
#: Shortest and longest chunk in bytes.
SHORTEST, LONGEST = 128, 8192
#: Entries of one generation of the word memo and bytes of one generation of the chunk memo; two generations are kept.
WORDS, CHUNK_BYTES = 100_000, 4 << 20

#: Marks that stand apart from a letter or digit before them.
TRAILING = b".,;:"
WHITE = b" \t\n\r\x0b\x0c"
SPACES = [bytes([c]) for c in WHITE]
#: Words of Latin letters, all below U+0180, whose lower case has as many letters.
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Content-defined borders in one text's bytes, the end included; never inside a code point."""
    n = len(data)
    if n <= SHORTEST + WINDOW:
        return np.array([n] if n else [], np.int64)
    marks = []
    for at in range(0, n, 1 << 20):  # bounded memory for very long texts
        part = data[max(0, at - WINDOW) : at + (1 << 20)]
        up, down = scales(len(part) + 1)
        p = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=p[1:])
        h = p[WINDOW:] - p[:-WINDOW]
        h *= down[: len(h)]
        marks.append(np.flatnonzero(h >> TOP == 0) + WINDOW + max(0, at - WINDOW))
    out, last = [], 0
    for m in [*np.unique(np.concatenate(marks)).tolist(), n]:
        while m - last > LONGEST:
            last = back(data, last + LONGEST)
            out.append(last)
        if m == n or m - last >= SHORTEST:
            m = back(data, m)
            if m > last:
                out.append(m)
                last = m
    return np.array(out, np.int64)


_SCALES: list[np.ndarray] = []


def scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base, and of its inverse times a constant that spreads the hash over the top bits."""
    if not _SCALES or len(_SCALES[0]) < n:
        n = max(n, 1 << 17)
        _SCALES[:] = powers(n), powers(n, inverse()) * np.uint64(0xD6E8FEB86659FD93)
    return _SCALES[0], _SCALES[1]


def back(data: np.ndarray, at: int) -> int:
    """The start of the code point that `at` is in."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def byte_letters() -> dict[int, int]:
    """The letter by which byte-level BPE names each byte: itself if it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return dict(zip([b for b in range(256) if b not in prints], range(0x100, 0x200)))


BYTES = byte_letters()


class Memo:
    """A map of two generations; the older is dropped when the younger is full."""

    def __init__(self, most: int) -> None:
        self.most, self.size, self.new, self.old = most, 0, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value, weight: int = 1) -> None:
        self.new[key] = value
        self.size += weight
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0


class Coder:
    """Encodes whole texts; the same ids as the tokenizer gives for the text at once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.model = self.tokenizer.model
        self.words, self.chunks, self.joins = Memo(WORDS), Memo(CHUNK_BYTES), Memo(WORDS // 10)
        self.fresh = 0  # chunks encoded rather than reused

    def piece(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), b" ".join([self.pieces[i] for i in ids])

    def word(self, w: bytes) -> tuple[bytes, bytes]:
        """(ids, decoded text) of one word between white space."""
        found = self.words.old.get(w)
        if found is None:
            s = w.rstrip(TRAILING)
            if len(s) < len(w) and s[-1:].isalnum():
                # the pattern parts a letter or digit from marks after it, so the stem and the marks encode by themselves
                (i, d), (j, e) = (self.words.new.get(x) or self.word(x) for x in (s, w[len(s) :]))
                found = (i + j, d + b" " + e)
            elif w.isalpha():  # ASCII letters only: one piece for the pattern, nothing to normalise but the case
                found = self.piece([x.id for x in self.model.tokenize(w.lower().decode())])
            elif PLAIN.fullmatch(t := w.decode()):  # Latin letters: the same
                found = self.piece([x.id for x in self.model.tokenize(t.lower().encode().decode("latin-1").translate(BYTES))])
            else:
                found = self.piece(self.tokenizer.encode(t, add_special_tokens=False).ids)
        self.words.put(w, found)
        return found

    def spell(self, text: bytes) -> tuple[bytes, bytes]:
        """(ids, decoded text) of a run of words between white space: such words encode each by itself."""
        words = text.split()
        found = list(map(self.words.new.get, words))
        if None in found:
            for k, v in enumerate(found):
                if v is None:
                    found[k] = self.words.new.get(words[k]) or self.word(words[k])
        return b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[0]])

    def core(self, chunk: bytes) -> tuple[int, int, bytes, bytes]:
        """(first white space, last white space, ids, decoded) of a chunk; -1 where it has none. Memoised by content."""
        found = self.chunks.get(chunk)
        if found is None:
            self.fresh += 1
            a = m.start() if (m := SPACE.search(chunk)) else -1
            b = max(map(chunk.rfind, SPACES)) if a >= 0 else -1
            found = (a, b, *(self.spell(chunk[a : b + 1]) if a >= 0 else (b"", b"")))
            self.chunks.put(chunk, found, 200 + len(chunk) + len(found[2]) + len(found[3]))
        return found

    def agreed(self, text: bytes, start: int, end: int) -> bool:
        """Whether text[start:end], which stands astride a join, encodes as its words do by themselves.

        The window has a word of context on either side and grows by one each way until its ids agree.
        """
        a, b = start, end
        while True:
            a, b = word_before(text, a), word_after(text, b)
            window = text[a:b]
            if self.joins.get(window):
                return True
            if self.tokenizer.encode(window.decode(), add_special_tokens=False).ids == np.frombuffer(self.spell(window)[0], "<u4").tolist():
                self.joins.put(window, True)
                return True
            if a == 0 and b == len(text):
                return False

    def encode(self, data: np.ndarray) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, decoded text) of one text's UTF-8 bytes."""
        text = data.tobytes()
        ids: list[bytes] = []
        said: list[bytes] = []
        whole, last, rest = True, 0, 0  # rest: where what stands after the last white space seen begins
        for at in [*cut_points(data).tolist(), None]:
            if at is None:
                i, d, astride = b"", b"", (rest, len(text))
            else:
                a, b, i, d = self.core(text[last:at])
                if a < 0:
                    last = at
                    continue
                astride, rest, last = (rest, last + a), last + b + 1, at
            if astride[1] > astride[0]:
                x, y = self.spell(text[astride[0] : astride[1]])
                if x:
                    ids.append(x)
                    said.append(y)
                whole = whole and self.agreed(text, *astride)
            if i:
                ids.append(i)
                said.append(d)
        if not whole:
            return self.piece(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        return b"".join(ids), b" ".join(said)


def word_before(text: bytes, at: int) -> int:
    """The start of the word that ends before at, or 0."""
    while at > 0 and text[at - 1] in WHITE:
        at -= 1
    while at > 0 and text[at - 1] not in WHITE:
        at -= 1
    return at


def word_after(text: bytes, at: int) -> int:
    """The end of the word that begins after at, or the text's end."""
    while at < len(text) and text[at] in WHITE:
        at += 1
    while at < len(text) and text[at] not in WHITE:
        at += 1
    return at


#: The chunks that this process has encoded, by vocabulary file: they outlive a task; the rest of a coder does not.
_CHUNKS: dict[str, Memo] = {}


def coder(path: str) -> Coder:
    """A coder for a vocabulary file that reuses the chunks which earlier ones of this process have encoded."""
    c = Coder(path)
    c.chunks = _CHUNKS.setdefault(path, c.chunks)
    return c


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(path: str, keep: list[str], ids: bool):
    """A mapInArrow function; ids: give each text's ids and decoded text besides their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            data, offsets = raw(strings(batch, "text"))
            for i, j in blocks(offsets, 2 << 20):
                got = [c.encode(data[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
                out = {k: batch.column(batch.schema.get_field_index(k)).slice(i, j - i) for k in keep}
                out["n_tokens"] = pa.array([len(x) // 4 for x, _ in got], pa.int64())
                out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x, _ in got])
                out["decoded_sha256"] = pa.array([hashlib.sha256(y).hexdigest() for _, y in got])
                if ids:
                    out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
                    out["decoded"] = pa.array([y.decode("utf-8") for _, y in got], pa.string())
                yield pa.RecordBatch.from_pydict(out)
        del c
        give_back()

    return run


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    docs has `text` and the columns of keep, which are carried along; others are ignored. Null and empty texts give no
    ids and an empty decoded text. ids=True adds ids (array<int>) and decoded (string). Repeated rows give repeated
    rows; an empty table gives an empty one.
    """
    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + SCHEMA.split(", ")[1:] + (["ids array<int>", "decoded string"] if ids else [])
    return docs.select(*keep, "text").mapInArrow(encoded(path, list(keep), ids), ", ".join(fields))


def decode(rows: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids: the pieces with a blank between them, special tokens included."""

    @F.pandas_udf("string")
    def text(x):
        import pandas as pd

        c = coder(path)
        return pd.Series([None if v is None else b" ".join([c.pieces[i] for i in v]).decode() for v in x])

    return rows.withColumn(out, text(F.col(column)))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and digests of its ids and of its decoded text."""
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
