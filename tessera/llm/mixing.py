"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent between 0 (all sources alike) and 1 (as they
are). The exponent is bisected: the largest whose weights' entropy reaches the target, but never so small that a source
would be repeated beyond the limit. A token budget then gives each source its epochs. An epoch is a permutation of the
source's blocks, keyed by epoch; whole epochs take every block, the last one takes blocks in its permutation's order
until the source's budget is spent, and part of the block where that happens.

Nothing is collected by source: each step of the bisection sums powers of the shares on the executors for a grid of
exponents. Where the last epoch of a source ends is found by digits of its blocks' places: sums over at most 2^DIGIT
bins of a source, then over the bins of the one that is cut, then over its few blocks, then over the rows of one block.
That gives one row a source, by which the documents are chosen where they are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, stored, table

#: Tokens of a block, and bits of a digit of a block's place in an epoch.
BLOCK_TOKENS, DIGIT = 200_000, 12
#: Share of the greatest entropy to reach, and times that a document may be used.
ENTROPY, REPEATS = 0.9, 4.0
#: Exponents tried at once, and rounds: the exponent is known to GRID^-ROUNDS.
GRID, ROUNDS = 64, 5
#: Sources up to this many are broadcast to the documents; beyond it they are joined, each dealt over SALTS keys.
BROADCAST_SOURCES, SALTS = 100_000, 64


def exponent(moments: Callable[[list[float]], dict[float, tuple[float, float]]], n: int, least: float, most: float, total: float, entropy: float, repeats: float, budget: float | None = None) -> tuple[float, float]:
    """(exponent, sum of the shares' powers): the largest exponent that reaches the entropy within the limit on repetition.

    moments(ts) gives, for each exponent t, the sums over the n sources of p^t and of p^t ln p, p being a source's
    share; least and most are the extreme shares and total the tokens. entropy is a share of ln(n). Without a budget,
    the budget is the least that uses every document once. Where both targets can't be met, the limit on repetition holds.
    """
    if n < 2:
        return 1.0, 1.0

    def holds(t: float, z: float, e: float) -> tuple[bool, bool]:
        falls = math.log(z) - t * e / z < entropy * math.log(n)  # entropy falls as t grows
        whole = total * most ** (1 - t) * z if budget is None else budget
        return falls, whole * least ** (t - 1) / (z * total) <= repeats * (1 + 1e-12)

    borders, at_one = [], moments([1.0])[1.0]
    for k in (0, 1):
        low, high = 0.0, 1.0
        if not holds(1.0, *at_one)[k]:  # nowhere
            borders.append(1.0)
            continue
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            got = moments(grid)
            first = next((i for i, t in enumerate(grid) if holds(t, *got[t])[k]), GRID)
            low, high = (grid[max(0, first - 1)], grid[first]) if first else (grid[0], grid[0])
            if low == high:
                break
        borders.append(high)
    t = max(borders)
    return t, moments([t])[t][0]


def spent(rows: DataFrame, by: list[str], order: list[Column], size: str) -> DataFrame:
    """rows with `before`: the sum of a size over the rows that come earlier, of the same `by`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))


def ends(narrow: DataFrame, plan: DataFrame, n_blocks: int, n_sources: int, seed: int) -> DataFrame:
    """(s, at, block, rank, row) for each source with a last epoch: the block in which it ends, and the last row taken there.

    Blocks come in order of (at, block), rows of a block in order of (rank, row). rank and row are null where no row of
    the block is taken.
    """
    placed = narrow.join(plan.where("rest > 0").select("s", "full", "rest", "blocks"), "s").withColumn("block", block_of())
    blocks = placed.groupBy("s", "full", "rest", "block").agg(F.sum("tokens").alias("size"))
    at = place(seed)
    left = stored(blocks.select("s", "block", at.alias("at"), "size", F.col("rest").alias("left")), "blocks", n_blocks)
    made, by = [left], ["s"]
    for shift in (64 - DIGIT, 64 - 2 * DIGIT, None):
        digit = F.shiftrightunsigned("at", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)) if shift else F.struct("at", "block")
        rows = made[-1].withColumn("digit", digit)
        bins = spent(rows.groupBy(*by, "digit").agg(F.sum("size").alias("sum"), F.first("left").alias("left")), by, [F.col("digit")], "sum")
        cut = bins.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("sum") > F.col("left"))).select(*by, "digit", (F.col("left") - F.col("before")).alias("rest"))
        rows = rows.join(cut, [*by, "digit"]).drop("left").withColumnRenamed("rest", "left")
        name = f"d{len(made)}"
        by = [*by, name]
        made.append(stored(rows.withColumnRenamed("digit", name) if shift else rows.drop("digit"), "cut", n_blocks))
    block = made[-1].select("s", "block", "at", "left")  # one a source
    inside = placed.join(block, ["s", "block"]).groupBy("s", "block", "at", "left", "row").agg(F.sum("tokens").alias("tokens")).withColumn("rank", F.xxhash64(F.lit(2), "row"))
    inside = spent(inside, ["s", "block"], [F.col("rank"), F.col("row")], "tokens").where("before + tokens <= left")
    last = inside.groupBy("s", "block").agg(F.max(F.struct("rank", "row")).alias("last"))
    out = stored(block.join(last, ["s", "block"], "left").select("s", "at", "block", "last.rank", "last.row"), "ends", n_sources)
    for x in made:
        drop_stored(x)
    return out


def block_of() -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "row"), F.col("blocks"))


def place(seed: int) -> Column:
    """A block's place in its source's last epoch, 63 bits and never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "s", "full", "block"), 1)


def mix(docs: DataFrame, source: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, seed: int = 5) -> DataFrame:
    """docs' columns once for each use of a row, with mix_epoch (from 0), mix_block, mix_key and mix_weight added.

    docs has doc_id, text and the column source. A document's tokens are its words (1 at least, so empty and null texts
    count 1); a null source is a source of its own. Without a budget every row is used at least once. With one, a
    source whose part is smaller than its tokens gives a part of its rows: that is the operator's purpose. Sorting by
    mix_key gives the mixture's order. Repeated rows are rows of their own, ranked together. An empty table gives an
    empty one. Columns of the added names are replaced; any other names may stand in docs, as its rows travel in one
    struct.
    """
    added = ["mix_epoch", "mix_block", "mix_key", "mix_weight"]
    base = docs.drop(*added)
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))
    tokens = F.greatest(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")), F.lit(1)).cast("long")
    row = F.xxhash64(F.lit(seed), "doc_id", "text")
    narrow = stored(base.select(key.alias("s"), tokens.alias("tokens"), row.alias("row")), "tokens")
    sums = stored(narrow.groupBy("s").agg(F.sum("tokens").alias("tokens")), "sources", narrow.select("s").distinct().count())
    of = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    total = float(of.total or 1)

    def moments(ts: list[float]) -> dict[float, tuple[float, float]]:
        share = F.col("tokens") / total
        rows = sums.select(share.alias("p"), F.explode(F.array(*map(F.lit, ts))).alias("t")).groupBy("t").agg(F.sum(F.pow("p", "t")).alias("z"), F.sum(F.pow("p", "t") * F.log("p")).alias("e"))
        return {r.t: (r.z, r.e) for r in rows.collect()}  # a row for each exponent of the grid

    t, z = exponent(moments, of.n, (of.least or 1) / total, (of.most or 1) / total, total, entropy, repeats, budget)
    whole = budget if budget is not None else total * ((of.most or 1) / total) ** (1 - t) * z
    weight = F.pow(F.col("tokens") / total, F.lit(t)) / z
    part = F.lit(float(whole)) * weight
    full = F.floor(part / F.col("tokens") + 1e-9).cast("int")
    plan = sums.select("s", weight.alias("weight"), full.alias("full"), F.greatest(F.lit(0), F.floor(part - full * F.col("tokens") + 1e-6)).cast("long").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("blocks"))
    last = ends(narrow, plan, of.n + int(total // BLOCK_TOKENS), of.n, seed)
    plan = stored(plan.join(last, "s", "left").select("s", "weight", "full", "rest", "blocks", F.struct("at", "block").alias("end"), F.struct("rank", "row").alias("end_row")), "plan", of.n)
    for x in (narrow, sums, last):
        drop_stored(x)
    wide = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("doc"), key.alias("s"), row.alias("row"))
    if of.n <= BROADCAST_SOURCES:
        wide = wide.join(F.broadcast(plan), "s")
    else:  # a source of many rows is dealt over salted keys
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = wide.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["s", "salt"])
    wide = wide.withColumn("block", block_of())
    mine, within = F.struct(place(seed).alias("at"), "block"), F.struct(F.xxhash64(F.lit(2), "row").alias("rank"), "row")
    more = F.when(F.col("rest") == 0, False).when(F.col("end.at").isNull(), True).when(mine < F.col("end"), True)
    more = more.when(mine > F.col("end"), False).otherwise(F.coalesce(within <= F.col("end_row"), F.lit(False)) & F.col("end_row.rank").isNotNull())
    uses = F.col("full") + more.cast("int")
    out = wide.withColumn("epoch", F.explode(F.when(uses > 0, F.sequence(F.lit(0), uses - 1)).otherwise(F.array().cast("array<int>"))))
    # epochs follow one another evenly in each source's part of the mixture; within an epoch blocks are permuted
    spot = (F.pmod(F.xxhash64(F.lit(seed), "s", "epoch", "block"), F.lit(1 << 20)) + F.pmod(F.xxhash64(F.lit(2), "row", "epoch"), F.lit(1 << 20)) / (1 << 20)) / (1 << 20)
    place_in = (F.col("epoch") + spot) / (F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0))
    return out.select("doc.*", F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), place_in.alias("mix_key"), F.col("weight").alias("mix_weight"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use of a document in the mixture: its epoch, block, place and its source's weight."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", "mix_epoch", "mix_block", "mix_key", "mix_weight")
