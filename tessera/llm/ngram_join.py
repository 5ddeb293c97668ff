"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order, that of their 64-bit hashes. The order is cut into fragments, and with it every
document's set. Two sets that are similar enough differ in at most k n-grams, so of k + 1 + e fragments at least e + 1
agree. How many fragments there are follows from the size of the larger set (bands of sizes; a document takes part in
each band that a partner of its may be in). A set leaves out its e most common fragments: the prefix principle says that
two sets with e + 1 fragments in common still share one of the others. So documents meet only where a rare whole
fragment of theirs agrees, and a passage that many documents hold brings no one together. The rare documents with more
than e empty fragments also meet over their first n-grams in the order, so that no link is lost.

Documents that meet, directly or through others, are a family. Links within one are decided by differences from a
centre C, the n-grams that most of a large family have (nothing, in a small one): the overlap of S and T is |C| - |C-S| -
|C-T| + |x|, x being what the differences of S and of T from C have in common. With w(S) = (den + num) |C-S| + num |S|,
S and T are linked where w(S) + w(T) <= (den + num) (|C| + |x|). Families are dealt into blocks in order of w. Pairs of
blocks that are linked throughout at x = 0, or nowhere at the greatest x, need no more than their sizes. For the others
x is counted, fragment by fragment of the order, and summed per pair, in one task a pair of blocks. Only a spanning
forest and link counts leave a task. Equal sets count as one throughout, so copies cost one row. Links make the
components.

Sets and n-grams are known by 64-bit hashes: of d different sets about d^2 / 2^65 pairs are taken for equal ones by
chance, which is below one up to some 5 * 10^9 sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, blocks, connected_components, drop_stored, give_back, mix64, raw, stored, strings, table, words

#: Ratio of a band's largest to its smallest size. A band with k n-grams to differ in has SPARE + k // SHARE fragments over.
RATIO, SPARE, SHARE = 1.5, 2, 4
#: N-grams of a block of a family, and documents of it; a family of more than a block gets a centre.
BLOCK_GRAMS, BLOCK_DOCS = 1 << 19, 512
#: N-grams of a fragment when overlaps are counted, and of a matrix.
COUNTED, COLUMNS = 1 << 16, 4096
#: Documents up to this many (16 bytes each) are broadcast to pick their texts; beyond it they are joined by a shuffle.
BROADCAST_DOCS = 1_000_000
#: The bits of a meeting hash that tell its slot.
SLOT = np.uint64(127)
#: Sets that a task remembers, so as to send the meeting hashes of copies once.
REMEMBERED = 1 << 18


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, grams): each row's distinct n-gram hashes in ascending order, one row after the other.

    A text with fewer words than n is one n-gram of all its words; one without words has none.
    """
    rows, h = words(data, offsets)
    k = len(offsets) - 1
    count = np.bincount(rows, minlength=k)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    row = np.repeat(np.arange(k), size)
    width = np.minimum(count, n)[row]
    grams = np.full(len(at), np.uint64(n), np.uint64)
    for i in range(n):
        here = width > i
        grams[here] = grams[here] * BASE + h[at[here] + i]
    grams = mix64(grams + width.astype(np.uint64))
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return np.bincount(row[fresh], minlength=k), grams[fresh]


class Bands:
    """Bands of set sizes for similarity num/den, and the fragments of each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.tops = num, den, [1]

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * RATIO)))
        return int(np.searchsorted(self.tops, size))

    def taken(self, size: int) -> range:
        """The bands of the larger set of a pair that a set of this size may be in."""
        return range(self.of(size), self.of(size * self.den // self.num) + 1)

    def differ(self, band: int) -> int:
        """Most n-grams that two similar sets of this band differ in."""
        return 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)


def signatures(grams: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The hashes by which a set (ascending) meets others, and (slot, slack) of each slot.

    A slot is a band's fragments, or a band's first n-grams where too many fragments are empty; the low bits of a hash
    tell its slot. Sets that are similar share more than `slack` hashes of a slot, so the slack most common ones of a
    set need not be looked at.
    """
    out, slots = [], []
    s = len(grams)
    for band in bands.taken(s):
        k = bands.differ(band)
        if not k:
            continue  # only equal sets, which are one already
        spare = SPARE + k // SHARE
        m = k + 1 + spare
        part = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        seal = mix64(np.add.reduceat(mix64(grams), cut) + part[cut] * np.uint64(1 << 20) + np.uint64(band))
        out.append(seal & ~SLOT | np.uint64(2 * band))
        slack = spare - (m - len(cut))
        slots.append((2 * band, max(0, slack)))
        if slack < 0:
            first = mix64(grams[: s - -(-s * bands.num // bands.den) + 1] ^ np.uint64(0x5851F42D4C957F2D + band))
            out.append(first & ~SLOT | np.uint64(2 * band + 1))
            slots.append((2 * band + 1, 0))
    return out, slots


def described(n: int, num: int, den: int, meeting: bool):
    """An Arrow function: each row's set size, 64-bit set hash (the set's node), slots with slacks, and meeting hashes.

    The hashes, by far the largest part, come only if asked for; copies that a task has seen already go without them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        none = ([np.zeros(0, np.uint64)], [])
        for batch in batches:
            data, offsets = raw(strings(batch, "text"))
            ids, seals = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "seal"))
            for i, j in blocks(offsets):
                count, grams = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                ends = np.concatenate([[0], np.cumsum(count)])
                whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(grams ^ np.uint64(1)))])
                nodes = mix64(whole[ends[1:]] - whole[ends[:-1]] + count.astype(np.uint64))
                sigs, slots = [], []
                for node, a, z in zip(nodes.tolist(), ends[:-1], ends[1:], strict=True):
                    got = signatures(grams[a:z], bands) if z > a and node not in seen else none
                    sigs.append(np.concatenate([*(got[0] if meeting else []), none[0][0]]).view(np.int64))
                    slots.append([{"slot": k, "slack": v} for k, v in got[1]])
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(i, j - i),
                        "seal": seals.slice(i, j - i),
                        "n": pa.array(count, pa.int64()),
                        "node": pa.array(nodes.view(np.int64)),
                        "sigs": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in sigs])]), pa.int32()), pa.array(np.concatenate(sigs))),
                        "slots": pa.array(slots, pa.list_(pa.struct([("slot", pa.int32()), ("slack", pa.int32())]))),
                    }
                )
            give_back()

    return run


def listed(n: int):
    """An Arrow function: (node, grams) of each row's set, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(strings(batch, "text"))
            ids = batch.column(batch.schema.get_field_index("node"))
            for i, j in blocks(offsets):
                count, grams = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                at = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_pydict({"node": ids.slice(i, j - i), "grams": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))})
            give_back()

    return run


def common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """The number of common values of each of left and each of right (None: of left), counted by fragments and summed."""
    both = left if right is None else left + right
    grams = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    group = np.cumsum(np.concatenate([[True], grams[1:] != grams[:-1]])) - 1 if len(grams) else grams.astype(int)
    shared = np.bincount(group)[group] > 1 if len(grams) else group
    row, group = row[shared], group[shared]
    a = len(left)
    b = np.arange(len(both)) if right is None else np.arange(a, len(both))
    overlap = np.zeros((a, len(b)), np.int64)
    at = 0
    while at < len(row):  # a fragment of the global order at a time
        end = at + COUNTED
        while end < len(row) and group[end] == group[end - 1]:
            end += 1
        r, g = row[at:end], group[at:end]
        g = np.unique(g, return_inverse=True)[1]
        for c in range(0, g.max() + 1, COLUMNS):
            own = (g >= c) & (g < c + COLUMNS)
            member = np.zeros((len(both), min(COLUMNS, int(g.max()) + 1 - c)), np.float32)
            member[r[own], g[own] - c] = 1
            overlap += (member[:a] @ member[b].T).astype(np.int64)  # at most COLUMNS each, which a float32 holds exactly
        at = end
    return overlap


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, w: np.ndarray, centre: int, num: int, den: int) -> np.ndarray:
    """Pairs (i, j) of similar sets, i < j over left and then right: the differences from a centre of so many n-grams, and w.

    right None: pairs of left. All comparisons are of whole numbers.
    """
    w = np.asarray(w, np.int64)
    a, n = len(left), len(left) + len(right or [])
    b = np.arange(n) if right is None else np.arange(a, n)
    i, j = np.nonzero((den + num) * (centre + common(left, right)) >= w[:a, None] + w[b][None])
    pairs = np.stack([i, b[j]], 1)
    return pairs[pairs[:, 0] < pairs[:, 1]]


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that a union-find needs to connect what all of them connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs.tolist():
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def families(num: int, den: int):
    """A grouped function over a pair of blocks of a family: the spanning forest of its links, and link counts."""

    def run(key, rows):
        rows = rows.sort_values(["block", "node"], kind="stable")
        delta = [np.asarray(x, np.int64).view(np.uint64) for x in rows.delta]
        nodes, left = rows.node.to_numpy(), int((rows.block == key[1]).sum())
        pairs = linked(delta[:left], None if key[1] == key[2] else delta[left:], rows.w.to_numpy(), int(rows.centre.iloc[0]), num, den)
        tree = forest(pairs, len(delta))
        degree = np.bincount(pairs.ravel(), minlength=len(delta)) if len(pairs) else np.zeros(len(delta), np.int64)
        found = np.flatnonzero(degree)
        return pd.DataFrame(
            {
                "a": np.concatenate([nodes[[i for i, _ in tree]] if tree else np.zeros(0, np.int64), nodes[found]]),
                "b": np.concatenate([nodes[[j for _, j in tree]] if tree else np.zeros(0, np.int64), np.zeros(len(found), np.int64)]),
                "links": np.concatenate([np.zeros(len(tree), np.int64), degree[found]]),
            }
        )

    return run


def met_in(members: DataFrame) -> DataFrame:
    """(sig, low, high, c) of the meeting hashes that two sets or more of members (node, sig) have; c counts rows."""
    return members.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high")


def meetings(members: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): sets that meet, each hash's members with its smallest one.

    members (node, sig) are read twice rather than stored: once to find the hashes of several sets, once to pick these.
    """
    met = stored(met_in(members), "met")
    shared = members.join(met.select("sig", "c"), "sig").withColumn("slot", F.col("sig").bitwiseAND(F.lit(int(SLOT))).cast("int"))
    mine = shared.groupBy("node", "slot").agg(F.array_sort(F.collect_set(F.struct("c", "sig"))).alias("own"))  # rarest first; bounded by the set
    slack = known.select("node", F.explode("slots").alias("s")).select("node", "s.slot", "s.slack").distinct()
    rare = mine.join(slack, ["node", "slot"]).where(F.size("own") > F.col("slack"))
    rare = stored(rare.select("node", F.explode(F.expr("slice(own, 1, size(own) - slack)")).alias("x")).select("node", "x.sig"), "rare")
    lows = met_in(rare).select("sig", "low")
    edges = stored(rare.join(lows, "sig").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "meetings", rare.count())
    drop_stored(met)
    drop_stored(rare)
    return edges


def centred(members: DataFrame, grams: DataFrame, num: int, den: int) -> DataFrame:
    """(family, node, block, delta, w, centre) of large families' members: blocks of about a block's size in order of w."""
    rows = members.join(grams, "node")
    often = rows.select("family", F.explode("grams").alias("g")).groupBy("family", "g").agg(F.count(F.lit(1)).alias("c"))
    docs = members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"))
    # at most twice the mean set: a half of the members have each
    centres = often.join(docs, "family").where("2 * c > docs").groupBy("family").agg(F.collect_list("g").alias("c"))
    rows = rows.join(centres, "family", "left").withColumn("c", F.coalesce("c", F.array().cast("array<bigint>")))
    away = F.array_except("c", "grams")
    rows = rows.select("family", "node", F.concat(away, F.array_except("grams", "c")).alias("delta"), ((den + num) * F.size(away) + num * F.size("grams")).cast("long").alias("w"), F.size("c").cast("long").alias("centre"))
    rows = stored(rows, "centred")
    weight = F.greatest(F.lit(BLOCK_GRAMS // BLOCK_DOCS), F.size("delta")).cast("long")
    steps = rows.groupBy("family", "w").agg(F.sum(weight).alias("sum"))  # a row for each value of w in a family
    steps = steps.withColumn("upto", F.sum("sum").over(Window.partitionBy("family").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.coalesce("upto", F.lit(0)) + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(1 << 20) * F.col("sum")
    return rows.join(steps, ["family", "w"]).select("family", "node", F.floor(at / BLOCK_GRAMS).cast("int").alias("block"), "delta", "w", "centre")


def links_within(members: DataFrame, rows: int, grams: DataFrame, num: int, den: int) -> DataFrame:
    """Links within families (family, node), so many rows at most: rows (a, b, 0), which connect what links connect, and (a, 0, number of links)."""
    members = members.join(grams.select("node", F.size("grams").cast("long").alias("size")), "node")
    sizes = stored(members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("grams")), "families", rows)
    large = (F.col("docs") > BLOCK_DOCS) | (F.col("grams") > BLOCK_GRAMS)
    few = members.join(sizes.where(~large).select("family"), "family", "left_semi").join(grams, "node")
    few = few.select("family", "node", F.lit(0).alias("block"), F.col("grams").alias("delta"), (num * F.col("size")).alias("w"), F.lit(0).cast("long").alias("centre"))
    task = lambda rows: rows.groupBy("family", "i", "j").applyInPandas(families(num, den), "a long, b long, links long")
    small = task(few.withColumns({"i": F.lit(0), "j": F.lit(0)}))
    if not sizes.where(large).limit(1).count():
        return stored(small, "links")
    many = stored(centred(members.join(sizes.where(large).select("family"), "family", "left_semi"), grams, num, den), "blocks")
    stats = many.groupBy("family", "block").agg(F.count(F.lit(1)).alias("docs"), F.min("w").alias("low"), F.max("w").alias("high"), F.max(F.size("delta")).alias("most"), F.max("centre").alias("centre"))
    one, two = (stats.select("family", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "docs", "low", "high", "most")), *(["centre"] if k == "i" else [])) for k in "ij")
    both = stored(one.join(two, "family").where("block_i <= block_j"), "pairs")
    whole = (F.col("high_i") + F.col("high_j")) <= (den + num) * F.col("centre")
    never = (F.col("low_i") + F.col("low_j")) > (den + num) * (F.col("centre") + F.least("most_i", "most_j"))
    asked = both.where(~whole & ~never).select("family", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    counted = task(many.join(asked, ["family", "block"]).select("family", "i", "j", "block", "node", "delta", "w", "centre"))
    # blocks linked throughout: as many links as the other block has sets (one less within a block)
    plain = both.where(whole)
    sides = plain.select("family", F.col("block_i").alias("block"), (F.col("docs_j") - F.when(F.col("block_i") == F.col("block_j"), 1).otherwise(0)).alias("n"))
    sides = sides.unionByName(plain.where("block_i < block_j").select("family", F.col("block_j").alias("block"), F.col("docs_i").alias("n")))
    degree = many.select("family", "block", "node").join(sides.groupBy("family", "block").agg(F.sum("n").alias("n")), ["family", "block"])
    degree = degree.select(F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.col("n").alias("links")).where("links > 0")
    # who is linked with anyone at x = 0 is linked with the set of the least w
    first = many.groupBy("family").agg(F.min(F.struct("w", "node")).alias("f"))
    near = many.select("family", "node", "w", "centre").join(first, "family").where(((den + num) * F.col("centre") >= F.col("w") + F.col("f.w")) & (F.col("node") != F.col("f.node")))
    near = near.select(F.col("node").alias("a"), F.col("f.node").alias("b"), F.lit(0).cast("long").alias("links"))
    out = stored(small.unionByName(counted).unionByName(degree).unionByName(near), "links")
    for t in (many, both, sizes):
        drop_stored(t)
    return out


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of docs, under links of Jaccard similarity num/den or more.

    docs has doc_id and text; other columns are ignored. Words are runs of other than ASCII white space, A-Z
    lower-cased; a set is the distinct n-word shingles, all words at once where there are fewer. Null, empty and blank
    texts have the empty set, no link, and are their own component. component_id is the smallest doc_id that links
    reach; n_links counts the different sets that a set is linked with (equal sets, always linked, aside). Repeated rows
    give repeated rows. A null doc_id is in no component but its own (null). An empty table gives an empty one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("seal"))
    shape = "doc_id long, seal long, n long, node long, sigs array<bigint>, slots array<struct<slot:int,slack:int>>"
    found = lambda meeting: source.mapInArrow(described(n, num, den, meeting), shape)
    known = stored(found(False).drop("sigs"), "known")
    n_docs = known.count()
    members = found(True).where("doc_id is not null").select("node", F.explode("sigs").alias("sig"))
    edges = meetings(members, known.where("doc_id is not null"))
    family = stored(connected_components(edges).withColumnRenamed("component", "family"), "family", 2 * edges.count())
    drop_stored(edges)
    reps = stored(known.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "seal")).alias("r")).select("node", "r.doc_id", "r.seal"), "reps", n_docs)
    # the sets themselves, of those that meet
    n_family = family.count()
    candidates = stored(reps.join(family.select("node"), "node"), "candidates", n_family)
    picked = F.broadcast(candidates) if n_family <= BROADCAST_DOCS else candidates
    texts = source.join(picked, ["doc_id", "seal"]).select("node", "text").dropDuplicates(["node"])
    grams = stored(texts.mapInArrow(listed(n), "node long, grams array<bigint>"), "grams")
    links = links_within(family, n_family, grams, num, den)
    for t in (family, candidates, grams):
        drop_stored(t)
    groups = stored(connected_components(links.where("links = 0").select("a", "b")), "groups", n_family)
    degree = links.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    joined = reps.select("node", "doc_id").join(groups, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = stored(joined.join(least, "component").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "components", n_docs)
    for t in (links, groups, reps):
        drop_stored(t)
    rows = known.select("doc_id", F.col("n").alias("n_shingles"), "node")
    none = F.lit(0).cast("long").alias("n_links")
    linkless = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = rows.where(~linkless).join(told, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    return out.unionByName(rows.where(linkless).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), none))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 3-word shingles and its component under links of 0.9 or more."""
    return join(table(spark, sf_dir, "documents"), 3, 90, 100)
