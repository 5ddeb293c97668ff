"""I-Match fingerprints over randomised lexicon subsets. DataFrame functions only.

A term's document frequency is counted over all documents, by its 64-bit hash. The lexicon is the terms whose normalised
inverse document frequency lies in a band, a table in the shared folder that grows with the corpus; its random subsets
are classes of the term's hash. A document's signature in a subset combines the hashes of its
sorted distinct terms there by exclusive or, which takes them in any order, so no sort crosses tasks. The most frequent
terms are broadcast, as many as a bound allows, and settle nearly all occurrences where they stand; only occurrences of rarer
terms are shuffled to meet the rest of the lexicon, and their share of a signature is joined to the others' by exclusive or. The
fingerprint is the string of all signatures; two fingerprints are as like as the share of subsets, among those where
either has a term, whose signatures agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FILE_ROWS, drop_stored, partitions, stored, table

#: So many of the lexicon's terms, the most frequent ones, are broadcast; occurrences of others are joined by a shuffle.
BROADCAST_TERMS = 1 << 20
#: For that choice terms are counted by eighths of a doubling of their frequency, each parted by the hash into so many classes.
LEVEL_CLASSES = 16
#: Band of ln(N / df) / ln(N) for a corpus of N documents.
BAND = (0.12, 0.9)
#: (classes, subsets taken of them) of each partition of the lexicon: fine subsets outlive edits, coarse ones tell near copies.
#: The coarsest partition is taken whole, so each term of the lexicon is in a subset.
SUBSETS = ((256, 16), (64, 12), (16, 16))
N_SUBSETS = sum(n for _, n in SUBSETS)
#: A document with fewer terms in the band is fingerprinted by all its terms.
LEAST_TERMS = 4
#: The lexicon is written by one task for so many partitions of the session's: it is small beside the texts.
LEXICON_SHARE = 8
#: Characters of a signature.
DIGITS = 8


def terms_of(text: Column) -> Column:
    """The distinct terms' hashes, in any order: runs of letters and digits, in lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def frequencies(docs: DataFrame) -> DataFrame:
    """(h, df) of the terms found in docs' column t; counted within tasks first."""
    return docs.select(F.explode(terms_of(F.col("t"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def next_rows(keys: DataFrame, n: int) -> DataFrame:
    """For distinct rows (doc_id, _a, _b, n_chars, copies): with (_na, _nb), the keys of the next row in order of doc_id.

    Rows are dealt into n ranges of doc_id. The rows at a range's lower border are also dealt, as guests, to the range
    before (the first one's to the last), where they follow the others; so no range needs to see another.
    """
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = keys.select(F.percentile_approx(at, [i / n for i in range(n)], 10 * n).alias("c"), F.min(at).alias("m")).first()
    values = sorted({*(found["c"] or []), *([found["m"]] if found["m"] is not None else [])})
    cuts, wide = F.array(*map(F.lit, values)).cast("array<long>"), max(1, math.isqrt(len(values)))
    block = F.size(F.filter(F.array(*map(F.lit, values[::wide])).cast("array<long>"), lambda c: c <= F.col("_at")))  # the block of cuts, then the cut
    within = F.size(F.filter(F.slice(cuts, (F.col("_block") - 1) * wide + 1, F.lit(wide)), lambda c: c <= F.col("_at")))
    own = keys.withColumn("_at", at).withColumn("_block", F.greatest(block, F.lit(1))).withColumn("_part", (F.col("_block") - 1) * wide + within).drop("_block")
    guest = F.struct(F.when(F.col("_part") == 1, F.size(cuts)).otherwise(F.col("_part") - 1).alias("part"), F.lit(1).alias("guest"))
    mine = F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest"))
    dealt = own.select("*", F.explode(F.when(F.array_contains(cuts, F.col("_at")), F.array(mine, guest)).otherwise(F.array(mine))).alias("_to"))
    w = Window.partitionBy("_to.part").orderBy("_to.guest", "_at", "_a", "_b")
    after = dealt.withColumn("_na", F.lead("_a").over(w)).withColumn("_nb", F.lead("_b").over(w))
    return after.where("_to.guest = 0").drop("_to", "_at", "_part")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among the subsets where either fingerprint has one; 1 for equal fingerprints."""
    empty, slots = "0" * DIGITS, F.array(*[F.lit(i * DIGITS + 1) for i in range(N_SUBSETS)])
    x, y = (lambda i: F.substr(a, i, F.lit(DIGITS))), (lambda i: F.substr(b, i, F.lit(DIGITS)))
    used = F.size(F.filter(slots, lambda i: (x(i) != empty) | (y(i) != empty)))
    same = F.size(F.filter(slots, lambda i: (x(i) == y(i)) & (x(i) != empty)))
    return F.when(a == b, F.lit(1.0)).when(used == 0, F.lit(0.0)).otherwise(same / used)


def shared_out(lexicon: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the lexicon's most frequent terms, at most BROADCAST_TERMS; those in the band of the others, None if there are no others)."""
    if lexicon.count() <= BROADCAST_TERMS:
        return lexicon, None
    level = F.floor(F.log2("df") * 8) * LEVEL_CLASSES + F.pmod(F.col("h"), F.lit(LEVEL_CLASSES))
    least, total = 64 * 8 * LEVEL_CLASSES, 0
    for r in sorted(lexicon.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > BROADCAST_TERMS:
            break
        least = r["level"]
    return lexicon.where(level >= least), lexicon.where((level < least) & F.col("in_band"))


def sums(k: int, mine: Callable[[int], Column], band: Column) -> list[Column]:
    """For texts 0 to k - 1: n_i terms in the band, all_i joining all terms, s_i joining those in the band by subset (null without one).

    Rows are distinct terms of a document, with m, the term's hash; mine tells whether text i has it.
    """
    out = []
    for i in range(k):
        out += [F.count(F.when(mine(i) & band, 1)).alias(f"n_{i}"), F.bit_xor(F.when(mine(i), F.col("m"))).alias(f"all_{i}")]
        signatures, shift = [], 0
        for classes, taken in SUBSETS:
            c = F.shiftrightunsigned(F.col("m"), shift).bitwiseAND(F.lit(classes - 1))
            signatures += [F.bit_xor(F.when(mine(i) & band & (c == j), F.xxhash64("m"))) for j in range(taken)]
            shift += 8
        out.append(F.array(*[F.shiftright(x, 64 - 4 * DIGITS).cast("int") for x in signatures]).alias(f"s_{i}"))
    return out


def written(n: Column, joint: Column, signatures: Column) -> Column:
    """The fingerprint of a text of n terms in the band, from all its terms' joined hash and the array of its signatures."""

    def sign(x: Column) -> Column:
        return F.when(x.isNull(), F.lit("0" * DIGITS)).otherwise(F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0")))

    return F.when(n >= LEAST_TERMS, F.array_join(F.transform(signatures, sign), "")).otherwise(F.repeat(sign(F.shiftright(joint, 64 - 4 * DIGITS)), N_SUBSETS))


def either(a: Column, b: Column) -> Column:
    """a and b joined by exclusive or; the other one where one is null."""
    return F.coalesce(a.bitwiseXOR(b), a, b)


def fingerprints(docs: DataFrame, ids: list[str], carried: list[str], texts: list[str], lexicon: DataFrame) -> DataFrame:
    """A stored table of one row for each row of docs, with ids (which must be distinct), carried and fp_0, fp_1 ...: the fingerprints of the columns texts.

    lexicon is lexicon_of() as a stored table: counting it reads no rows. Terms that aren't broadcast (they are rare, outside the
    band or cut by an edit) leave their document as rows of their own, one for all its texts; those found in the rest of the lexicon come back.
    """
    ks = range(len(texts))
    common, rest = shared_out(lexicon)

    def tagged(i: int) -> Column:
        return F.transform(terms_of(F.col(texts[i])), lambda h: F.struct(F.lit(i).alias("which"), h.alias("h")))

    none = F.array(F.struct(F.lit(None).cast("int").alias("which"), F.lit(None).cast("long").alias("h")))  # each document has a row that isn't of an open term
    rows = docs.select(*ids, *carried, F.explode(F.concat(none, *map(tagged, ks))).alias("x")).select(*ids, *carried, "x.which", "x.h")
    rows = rows.join(F.broadcast(common.select("h", "in_band")), "h", "left").withColumn("m", F.xxhash64("h"))
    own = sums(len(texts), lambda i: F.col("which") == i, F.coalesce("in_band", F.lit(False)))
    if rest is None:
        got = rows.groupBy(*ids, *carried).agg(*own)
        return stored(got.select(*ids, *carried, *[written(F.col(f"n_{i}"), F.col(f"all_{i}"), F.col(f"s_{i}")).alias(f"fp_{i}") for i in ks]), "prints")
    settled, is_open = F.col("open").isNull(), F.col("open").isNotNull()
    got = rows.groupBy(*ids, *carried, F.when(F.col("in_band").isNull(), F.col("h")).alias("open")).agg(*own)
    kept = [F.when(settled, F.col(c)).alias(c) for c in (*carried, *(f"{x}_{i}" for x in ("n", "all", "s") for i in ks))]
    parts = stored(got.select(*ids, "open", *kept, *[F.when(is_open, F.col(f"all_{i}").isNotNull()).alias(f"has_{i}") for i in ks]), "parts")
    opened = parts.where(is_open).select(*ids, "open", F.xxhash64("open").alias("m"), *[f"has_{i}" for i in ks])
    joint = opened.groupBy(*ids).agg(*[F.bit_xor(F.when(F.col(f"has_{i}"), F.col("m"))).alias(f"all_{i}") for i in ks])
    found = opened.join(rest.select(F.col("h").alias("open")), "open").select(*ids, "m", *[f"has_{i}" for i in ks]).repartition(*ids)  # narrow rows, summed there
    found = found.groupBy(*ids).agg(*sums(len(texts), lambda i: F.col(f"has_{i}"), F.lit(True)))
    out = parts.where(settled).alias("a").join(joint.alias("b"), ids, "left").join(found.alias("c"), ids, "left")
    prints = [
        written(
            F.col(f"a.n_{i}") + F.coalesce(f"c.n_{i}", F.lit(0)),
            either(F.col(f"a.all_{i}"), F.col(f"b.all_{i}")),
            F.coalesce(F.zip_with(f"a.s_{i}", f"c.s_{i}", either), f"a.s_{i}"),
        ).alias(f"fp_{i}")
        for i in ks
    ]
    done = stored(out.select(*ids, *carried, *prints), "prints")
    drop_stored(parts)
    return done


def lexicon_of(docs: DataFrame, n: int, band: tuple[float, float] = BAND) -> DataFrame:
    """(h, df, in_band) of the terms that aren't too rare for the band of normalised inverse document frequency over n documents."""
    nidf = (F.log(F.lit(float(max(n, 2)))) - F.log(F.col("df").cast("double"))) / F.log(F.lit(float(max(n, 2))))
    return frequencies(docs).where(nidf <= band[1]).select("h", "df", (nidf >= band[0]).alias("in_band"))


def fingerprint(docs: DataFrame, column: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(text, fingerprint) for each distinct text of docs (null: empty), the lexicon drawn from all of docs' rows."""
    t = docs.select(F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("t"))
    lexicon = stored(lexicon_of(t, t.count(), band), "lexicon")
    keyed = t.distinct().select("t", F.xxhash64("t").alias("_a"), F.xxhash64(F.lit(1), "t").alias("_b"))
    return keyed.join(fingerprints(keyed, ["_a", "_b"], [], ["t"], lexicon), ["_a", "_b"]).select(F.col("t").alias("text"), F.col("fp_0").alias("fingerprint"))


def fingerprints_and_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited text and to the next document.

    docs has doc_id and text; other columns are ignored. Null texts count as empty. The order is by doc_id (null first),
    equal ids by their texts' hashes; repeated rows (same id and text) stand at one place in it and get the same result.
    A single document is its own next one. A text without terms has the empty fingerprint (zeros), which is like
    another one by 1. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    ids = [F.xxhash64("doc_id", "t").alias("_a"), F.xxhash64(F.lit(1), "doc_id", "t").alias("_b")]
    rows = t.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), *ids).groupBy("doc_id", "n_chars", "_a", "_b").agg(F.count(F.lit(1)).alias("copies"))
    order = stored(next_rows(rows, partitions(spark)), "order", docs.count())
    n = order.agg(F.sum("copies")).first()[0] or 0
    lexicon = stored(lexicon_of(t, n, band), "lexicon", FILE_ROWS * max(1, partitions(spark) // LEXICON_SHARE))
    texts = t.select(*ids, "t").dropDuplicates(["_a", "_b"])
    starts = texts.join(order.select(F.col("_a").alias("_pa"), F.col("_b").alias("_pb"), F.col("_na").alias("_a"), F.col("_nb").alias("_b"), F.expr("n_chars div 4").alias("m")), ["_a", "_b"])
    starts = starts.select(F.col("_pa").alias("_a"), F.col("_pb").alias("_b"), F.expr("substring(t, 1, cast(m as int))").alias("start"))
    edited = F.concat(F.expr("substring(t, 1, cast(n_chars - n_chars div 4 as int))"), "start").alias("edited")
    both = texts.join(order.select("_a", "_b", "doc_id", "n_chars"), ["_a", "_b"]).join(starts, ["_a", "_b"]).select("_a", "_b", "doc_id", "n_chars", "t", edited)
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = fingerprints(both, ["_a", "_b"], ["doc_id", "n_chars", "edited_sha256"], ["t", "edited"], lexicon)
    following = prints.select(F.col("_a").alias("_na"), F.col("_b").alias("_nb"), F.col("fp_0").alias("fp_next"))
    out = prints.join(order.select("_a", "_b", "_na", "_nb", "copies"), ["_a", "_b"]).join(following, ["_na", "_nb"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("fp_0").alias("fingerprint"),
        F.col("fp_1").alias("edited_fingerprint"),
        likeness(F.col("fp_0"), F.col("fp_1")).alias("near_edited"),
        likeness(F.col("fp_0"), F.col("fp_next")).alias("near_next"),
    )


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints_and_edits(table(spark, sf_dir, "documents"))
