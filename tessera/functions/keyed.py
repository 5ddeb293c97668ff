"""Keyed digests in the JVM: HMAC-SHA256 by its published definition (RFC 2104), over sha2 and binary columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the definition: bytes of a block, and what the inner and outer key are crossed with.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def padded_key(key: bytes, value: int) -> bytes:
    """The key, hashed first if it is longer than a block, filled up with zeros and crossed with one byte."""
    short = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    return bytes(b ^ value for b in short.ljust(BLOCK, b"\0"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The digest of a text or binary column under one key, in lower-case hexadecimal; null for null."""
    inner = F.unhex(F.sha2(F.concat(F.lit(padded_key(key, INNER)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(padded_key(key, OUTER)), inner), 256)


def session_hash(raw: Column, salt: bytes = b"") -> Column:
    """What a session is known by: half of the digest of its trimmed name under the install's salt; without a salt, a quarter of its plain digest; empty for a blank name."""
    name = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n\x0b\x0c"))
    return F.when(name == "", "").otherwise(F.left(hmac_sha256(salt, name), F.lit(32)) if salt else F.left(F.sha2(name, 256), F.lit(16)))
