"""Curated recipes: search, review, invariants, and their Markdown read into fields by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_fold
from ..sources.shared import fresh

REVIEWED, CURATED = "human_reviewed", "curated_internal_recipe"


def search(recipes: DataFrame, task: str = "", technology: str = "", language: str = "", roots: list[str] = (), limit: int = 5) -> DataFrame:
    """Recipes that hold the words given, reviewed ones first, then the newest; ties by uri."""
    cond = F.lit(True)
    for column, part in (("technology", technology), ("language", language)):
        if part:
            cond = cond & contains_fold(F.col(column), F.lit(part))
    if task:
        cond = cond & (contains_fold(F.col("subject"), F.lit(task)) | contains_fold(F.col("body"), F.lit(task)))
    if roots:
        cond = cond & F.col("root_name").isin(*roots)
    return recipes.where(cond).orderBy(F.when(F.col("review_status") == REVIEWED, 0).otherwise(1), F.desc("created_at"), "uri").limit(limit)


def held_authority(authority: Column, review: Column) -> Column:
    """Only reviewed recipes may be curated ones; the rest are generated summaries."""
    return F.when((authority == CURATED) & (review != REVIEWED), "generated_summary").otherwise(authority)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recipes with new ones (uri) in place of old ones, authorities held to the invariant; the last of a uri counts."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("created_at")))).where("_r = 1").drop("_r")
    last = last.withColumn("authority", held_authority(F.col("authority"), F.col("review_status")))
    return old.join(last.select("uri"), "uri", "left_anti").unionByName(last)


def lineage(recipes: DataFrame) -> DataFrame:
    """(uri, origin, steps) of recipes (uri, replaces): the recipe that each one's chain of replacements began with, and its length.

    Every round doubles how far each recipe has looked back, so a chain of n is resolved in about log2(n) joins, each one
    a table in the shared folder. replaces may be null or name a recipe that isn't there, which then is the origin. A
    chain that comes back to itself is refused with ValueError. uris must differ.
    """
    spark = recipes.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = fresh(spark, "lineage")
        df.write.parquet(path)
        return spark.read.parquet(path)

    named = recipes.select("uri", "replaces").where("uri is not null")
    outside = named.select(F.col("replaces").alias("uri")).where("uri is not null").distinct().join(named.select("uri"), "uri", "left_anti")
    first = named.unionByName(outside.withColumn("replaces", F.lit(None).cast(dict(named.dtypes)["uri"])))
    at = kept(first.select("uri", F.coalesce("replaces", "uri").alias("origin"), F.col("replaces").isNotNull().cast("long").alias("steps")))
    for _ in range(at.count().bit_length() + 1):
        ahead = at.select(F.col("uri").alias("origin"), F.col("origin").alias("to"), F.col("steps").alias("more"))
        after = kept(at.join(ahead, "origin").select("uri", F.col("to").alias("origin"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        at = after.select("uri", "origin", "steps")
        if not after.where("moved").limit(1).count():
            return at.join(named.select("uri"), "uri", "left_semi")
    raise ValueError("recipes replace each other in a circle")


def review(recipes: DataFrame, uri: str, status: str) -> DataFrame:
    """Promotes or demotes one recipe; its authority follows."""
    mine = F.col("uri") == uri
    out = recipes.withColumn("review_status", F.when(mine, status).otherwise(F.col("review_status")))
    target = F.when(F.col("review_status") == REVIEWED, CURATED).otherwise("generated_summary")
    return out.withColumn("authority", F.when(mine, target).otherwise(F.col("authority")))


#: What a section is by words in its heading, unless others are there too; the first that fits.
SECTIONS = (
    ("cleanup", ("cleanup", "teardown", "shutdown", "terminate"), ()),
    ("includes", ("include", "import", "header"), ()),
    ("prereqs", ("prereq",), ()),
    ("prereqs", ("requirement",), ("api", "cleanup")),
    ("apis", ("api",), ()),
    ("apis", ("functions", "symbols"), ("sequence", "init")),
    ("sequence", ("initialization", "init order", "sequence", "steps", "procedure", "workflow", "call order"), ()),
    ("constraints", ("constraint", "must not", "rule"), ()),
    ("pitfalls", ("pitfall", "gotcha", "warning", "common error", "avoid"), ()),
    ("examples", ("example", "sample"), ()),
    ("version", ("version",), ()),
)
#: Words of a text whose numbered lists count as its steps, and the characters that an example may have.
ORDER_WORDS, MOST_EXAMPLE = ("initialize", "init", "sequence", "steps", "then call", "call order"), 600
BLANK = " \t\r\x0b\x0c"


def holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def section_kind(title: Column) -> Column:
    """What a section with this heading is; `body` where no word tells."""
    t, out = F.lower(F.trim(title)), F.lit("body")
    for kind, words, unless in reversed(SECTIONS):
        out = F.when(holds(t, words) & ~holds(t, unless), kind).otherwise(out)
    return F.coalesce(out, F.lit("body"))


def clip(text: Column, n: int | Column) -> Column:
    """At most n characters, cut back to white space within the last 40, and marked where anything is cut."""
    n = F.lit(n) if isinstance(n, int) else n
    tail = F.reverse(F.substr(F.left(text, n), F.greatest(n - 39, F.lit(1))))
    back = F.array_min(F.filter(F.array(F.instr(tail, " "), F.instr(tail, "\n")), lambda k: k > 0))
    keep = F.when((n > 41) & back.isNotNull(), n - back).otherwise(n)
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.left(text, keep), F.lit("…")))


def lines_of(recipes: DataFrame, key: str) -> DataFrame:
    """(key, at, line, section, title, kind, ordered, item) of each recipe's (key, body) lines.

    A heading is a line of one to three marks, white space and words; an item follows a number with a point or bracket
    (ordered) or a mark -, * or +. Neither is looked for between fences. section counts headings, 0 before the first.
    """
    line = recipes.select(key, F.posexplode(F.split("body", "\n", -1)).alias("at", "line"))
    bare = F.ltrim(F.col("line"))
    is_blank = lambda c: F.contains(F.lit(BLANK), c) & (c != "")
    after = lambda text, k: F.substr(text, k + 1)
    w = Window.partitionBy(key).orderBy("at")
    fence = F.startswith(bare, F.lit("```")) | F.startswith(bare, F.lit("~~~"))
    plain = ~fence & (F.sum(fence.cast("int")).over(w) % 2 == 0)
    marks = F.char_length("line") - F.char_length(F.ltrim(F.col("line"), F.lit("#")))
    title = F.btrim(after(F.col("line"), marks), F.lit(BLANK))
    heading = plain & marks.between(1, 3) & is_blank(F.substr(F.col("line"), marks + 1, F.lit(1))) & (title != "")
    digits = F.char_length(bare) - F.char_length(F.ltrim(bare, F.lit("0123456789")))
    ordered = (digits > 0) & F.substr(bare, digits + 1, F.lit(1)).isin(".", ")")
    marked = ordered | ((digits == 0) & F.substr(bare, F.lit(1), F.lit(1)).isin("-", "*", "+"))
    item = F.btrim(after(bare, digits + 1), F.lit(BLANK))
    found = plain & marked & is_blank(F.substr(bare, digits + 2, F.lit(1))) & (item != "")
    out = line.select(key, "at", "line", heading.alias("heading"), F.when(heading, title).alias("title"), ordered.alias("ordered"), F.when(found & ~heading, item).alias("item"))
    out = out.select(key, "at", "line", "heading", F.sum(F.col("heading").cast("int")).over(w).alias("section"), F.last("title", True).over(w).alias("title"), "ordered", "item")
    return out.withColumn("kind", section_kind(F.col("title")))


def read(recipes: DataFrame, key: str = "uri") -> DataFrame:
    """(key, apis, includes, prereqs, sequence, cleanup, constraints, pitfalls, examples, version) of recipes (key, body).

    In a section numbered items come before others. Steps of a cleanup section end the sequence they follow, marked so; a
    recipe without steps takes its numbered items, if there are two or more and its text speaks of an order. A recipe
    without text or sections has empty fields; keys must differ.
    """
    l = lines_of(recipes, key)
    tokens = F.filter(F.transform(F.split("line", "`", -1), lambda t, i: F.when((i % 2 == 1) & t.rlike("^[A-Za-z_][A-Za-z0-9_:.#]*$"), t)), lambda t: t.isNotNull())
    source = F.startswith(F.ltrim("line"), F.lit("#include")) | F.startswith(F.ltrim("line"), F.lit("import "))
    none = F.array().cast("array<string>")
    # what a line gives to its section's field: its place there (0: API names, 1: numbered items, 2: others) and texts
    given = F.array(
        F.struct(F.when((F.col("kind") == "apis") & ~F.col("heading"), F.lit(0)).alias("rank"), tokens.alias("texts")),
        F.struct(F.when(F.col("item").isNotNull(), F.when(F.col("ordered"), 1).otherwise(2)).alias("rank"), F.when(F.col("kind") == "apis", F.array(F.btrim("item", F.lit("`")))).otherwise(F.array("item")).alias("texts")),
        F.struct(F.when((F.col("kind") == "includes") & source, F.lit(3)).alias("rank"), F.array(F.trim(F.btrim("line", F.lit(BLANK)))).alias("texts")),
    )
    each = l.select(key, "section", "kind", "at", "ordered", F.explode(given).alias("g")).where("g.rank is not null and size(g.texts) > 0")
    packed = F.sort_array(F.collect_list(F.struct("section", "g.rank", "at", "kind", "g.texts")))
    fields = each.groupBy(key).agg(packed.alias("all"), F.sort_array(F.collect_list(F.when((F.col("g.rank") == 1) & F.col("ordered"), F.struct("at", F.col("g.texts")[0].alias("t"))))).alias("numbered"))
    whole = l.where("not heading").groupBy(key, "section", "kind").agg(F.btrim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"), F.lit(BLANK + "\n")).alias("content"))
    texts = whole.where((F.col("content") != "") & F.col("kind").isin("examples", "version")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "kind", "content"))).alias("texts"))
    of = lambda *kinds: F.flatten(F.transform(F.filter("all", lambda x: x["kind"].isin(*kinds)), lambda x: x["texts"]))
    steps = F.flatten(F.transform(F.filter("all", lambda x: x["kind"].isin("sequence", "cleanup")), lambda x: F.transform(x["texts"], lambda t: F.when(x["kind"] == "cleanup", F.concat(F.lit("Cleanup: "), t)).otherwise(t))))
    spoken = (F.size("numbered") >= 2) & holds(F.lower("body"), ORDER_WORDS)
    out = recipes.select(key, "body").join(fields, key, "left").join(texts, key, "left")
    filled = lambda c: F.coalesce(c, none)
    own = F.filter("texts", lambda x: x["kind"] == "version")
    return out.select(
        key,
        filled(F.array_distinct(of("apis"))).alias("apis"),
        filled(F.array_distinct(of("includes"))).alias("includes"),
        *(filled(of(k)).alias(k) for k in ("prereqs", "cleanup", "constraints", "pitfalls")),
        filled(F.when(F.size(steps) > 0, steps).when(spoken, F.transform("numbered", lambda x: x["t"]))).alias("sequence"),
        filled(F.transform(F.filter("texts", lambda x: x["kind"] == "examples"), lambda x: clip(x["content"], MOST_EXAMPLE))).alias("examples"),
        F.coalesce(F.btrim(F.substring_index(F.element_at(F.when(F.size(own) > 0, own), -1)["content"], "\n", 1), F.lit(BLANK)), F.lit("")).alias("version"),
    )
