"""Ranks, boosts and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, looks_like_symbol, query_tokens, stem

#: Authorities from the most to the least useful, each with its boost.
AUTHORITIES = (
    ("current_project", 40),
    ("related_internal_project", 30),
    ("curated_internal_recipe", 28),
    ("official_example", 22),
    ("official_documentation", 14),
    ("generated_summary", 8),
    ("third_party_reference", 4),
)
#: Order of symbol kinds; a kind not named comes at 5.
KIND_ORDER = {"function": 0, "method": 1, "declaration": 2, "type": 3, "macro": 3, "constant": 4, "call": 8}


def mapped(key: Column, values: dict, rest) -> Column:
    out = F.lit(rest)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def authority_rank(authority: Column) -> Column:
    return mapped(authority, {a: i for i, (a, _) in enumerate(AUTHORITIES)}, len(AUTHORITIES))


def authority_boost(authority: Column) -> Column:
    return mapped(authority, {a: float(b) for a, b in AUTHORITIES}, 0.0)


def kind_order(kind: Column) -> Column:
    return mapped(kind, KIND_ORDER, 5)


def worth_hydrating(authority: Column) -> Column:
    return authority.isin("current_project", "related_internal_project", "curated_internal_recipe", "official_example", "official_documentation")


def version_preference(version: Column, preferred: Column) -> Column:
    """+5 for the preferred version, -8 for another one; 0 where either is not known."""
    v, p = F.lower(F.trim(version)), F.lower(F.trim(preferred))
    return F.when(p.isin("", "unknown") | (F.coalesce(v, F.lit("")) == ""), 0.0).when(v == p, 5.0).otherwise(-8.0)


def archived_hint(archived: Column, authority: Column, path: Column) -> Column:
    return archived | (F.lower(authority) == "archived") | F.contains(F.lower(path), F.lit("/archive/"))


def composite_score(query: Column, rank: Column, authority: Column, path: Column, title: Column, heading: Column, snippet: Column, archived: Column, deprecated: Column) -> tuple[Column, Column]:
    """(score, match kind): the negated rank plus boosts for authority, names and symbols, less the penalties."""
    q = F.lower(F.trim(query))
    base, whole = F.lower(basename(path)), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    t, h = F.lower(title), F.lower(heading)
    has = lambda text, part: (text != "") & F.contains(text, part)
    exact = (base != "") & ((base == q) | (F.lower(stem(path)) == q))
    names = F.when(exact, 28.0).when(has(base, q), 18.0).when(has(whole, q), 12.0).otherwise(0.0)
    kind = F.when(exact | has(base, q), "filename").when(has(whole, q), "path").when(has(t, q) | has(h, q), "heading").otherwise("body")
    symbols = F.filter(query_tokens(query), looks_like_symbol)
    seen = lambda s: F.contains(F.lower(snippet), F.lower(s)) | F.contains(h, F.lower(s)) | F.contains(t, F.lower(s))
    bias = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + F.when(seen(s), 14.0).otherwise(0.0) + F.when(has(base, F.lower(s)), 8.0).otherwise(0.0))
    score = -rank + authority_boost(authority) + names + F.when(has(t, q), 6.0).otherwise(0.0) + F.when(has(h, q), 10.0).otherwise(0.0) + bias
    score = score - F.when(archived_hint(archived, authority, path), 25.0).otherwise(0.0) - F.when(deprecated, 20.0).otherwise(0.0)
    return score, F.when(F.exists(symbols, seen), "symbol").otherwise(kind)
