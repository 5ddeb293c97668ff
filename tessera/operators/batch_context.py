"""Context packages for a table of tasks: what search, recipes and symbols found for each, trimmed to a budget of tokens.

A task's hits are one array of at most a dozen short excerpts, and all else is column functions over it, so that a batch
of any size is one grouping by task. The budget is a fold over a fixed number of steps: each looks at the size of the
package as JSON and takes away the next thing on the list, until it fits or nothing is left to take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.excerpts import clean_body
from ..functions.ranking import AUTHORITIES, authority_rank
from .recipes import clip, holds

#: How many of each a package has at first, and characters of its texts.
MOST_APIS, MOST_SYMBOLS, MOST_EXAMPLES, MOST_CITATIONS, MOST_TOKENS = 8, 6, 2, 5, 2500
EXCERPT, SIGNAL, CONVENTION, SUMMARY = 600, 180, 160, 60
#: Words that tell what a hit is about.
PITFALL, CONSTRAINT, WORKFLOW = ("pitfall", "error", "fail"), ("must", "require", "constraint"), ("sequence", "steps", "initialization", "init order", "call order")
#: Fixed values of the budget: steps at most, characters to a token, and what goes in which order: a field and how many of
#: its entries are kept; `shorten` halves the last entry's text if it is long, `clear` takes what is left.
STEPS, PER_TOKEN, LONG_TEXT = 40, 4, 80
CUTS = (
    ("follow_ups", 0), ("conventions", 0), ("apis", 4), ("symbols", 2), ("citations", 3), ("examples", 1), ("pitfalls", 0), ("constraints", 1), ("prerequisites", 0),
    ("examples", "shorten"), ("constraints", "shorten"), ("apis", 2), ("symbols", 1), ("missing", 0), ("summary", "shorten"), ("note", "clear"), ("examples", "clear"), ("constraints", "clear"),
)
NOTE = "estimated from serialized JSON payload (utf8_runes/4)"
#: The fields that a client sees, in the order of the payload.
FIELDS = "task summary apis symbols includes prerequisites sequence examples constraints pitfalls conventions citations coverage freshness missing follow_ups note".split()
EXAMPLE = "array<struct<uri:string,title:string,excerpt:string>>"
CITATION = "array<struct<uri:string,title:string,section:string,authority:string,root_name:string,version:string>>"
TYPES = {"symbols": "array<struct<name:string,kind:string>>", "examples": EXAMPLE, "citations": CITATION} | dict.fromkeys(("task", "summary", "coverage", "freshness", "note"), "string")


def api_words(task: Column) -> Column:
    """The words of a task that read as API names."""
    words = F.transform(F.split(F.trim(task), r"\s+"), lambda w: F.btrim(w, F.lit("`,.;()<>\"'")))
    mixed = lambda w: w.rlike("[A-Z]") & w.rlike("[a-z]")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & (F.contains(w, F.lit("::")) | F.contains(w, F.lit(".")) | F.contains(w, F.lit("_")) | mixed(w))))


def items(text: Column) -> Column:
    """The items of a text's numbered lists, then those of its other lists."""
    lines = F.transform(F.split(text, "\n"), F.ltrim)
    digits = lambda l: F.char_length(l) - F.char_length(F.ltrim(l, F.lit("0123456789")))
    after = lambda l, k: F.trim(F.substr(l, k))
    blank = lambda l, k: F.substr(l, k, F.lit(1)).isin(" ", "\t")
    numbered = F.filter(lines, lambda l: (digits(l) > 0) & F.substr(l, digits(l) + 1, F.lit(1)).isin(".", ")") & blank(l, digits(l) + 2) & (after(l, digits(l) + 3) != ""))
    other = F.filter(lines, lambda l: F.left(l, F.lit(1)).isin("-", "*", "+") & blank(l, F.lit(2)) & (after(l, F.lit(3)) != ""))
    return F.concat(F.transform(numbered, lambda l: after(l, digits(l) + 3)), F.transform(other, lambda l: after(l, F.lit(3))))


def payload(of) -> Column:
    """The package as compact JSON."""
    return F.to_json(F.struct(*[of(f).alias(f) for f in FIELDS]))


def tokens_of(of) -> Column:
    return F.ceil(F.char_length(payload(of)) / PER_TOKEN).cast("int")


def last_text(field: str, value: Column) -> Column:
    return F.get(value, F.lit(0))["excerpt"] if field == "examples" else F.get(value, F.lit(0))


def applies(field: str, rule, value: Column) -> Column:
    """Whether a cut has something to take."""
    if isinstance(rule, int):
        return F.size(value) > rule
    if field in ("summary", "note"):
        return F.char_length(value) > (SUMMARY + 1 if rule == "shorten" else 0)
    return (F.size(value) == 1) & (F.lit(True) if rule == "clear" else F.octet_length(last_text(field, value)) > LONG_TEXT)


def cut(field: str, rule, value: Column) -> Column:
    """A field's value after a cut."""
    kind = TYPES.get(field, "array<string>")
    if isinstance(rule, int):
        return F.slice(value, F.lit(1), F.size(value) - 1)
    if rule == "clear":
        return F.lit("") if field == "note" else F.array().cast(kind)
    if field == "summary":
        return F.concat(F.left(value, F.lit(SUMMARY)), F.lit("…"))
    text = last_text(field, value)
    short = clip(text, (F.octet_length(text) / 2).cast("int"))
    return F.transform(value, lambda x: x.withField("excerpt", short)) if field == "examples" else F.array(short)


def trimmed(package: DataFrame, most: str) -> DataFrame:
    """The package's fields within the budget in the column `most`, or as near as STEPS cuts come; with cuts, their number.

    A budget of 0 or less leaves the package alone. Each step is two turns: one finds the cut, the next makes it.
    """
    soft = {"apis": MOST_APIS, "symbols": MOST_SYMBOLS}

    def turn(acc: Column, i: Column) -> Column:
        of = lambda f: acc[f]
        find = F.lit(0)
        for k, (field, rule) in reversed(list(enumerate(CUTS, 1))):
            find = F.when(applies(field, rule, of(field)), k).otherwise(find)
        fits = tokens_of(of) <= acc["most"]
        after = {f: of(f) for f in FIELDS}
        for k, (field, rule) in enumerate(CUTS, 1):
            after[field] = F.when(acc["k"] == k, cut(field, rule, of(field))).otherwise(after[field])
        looked = F.struct(*[of(f).alias(f) for f in FIELDS], F.when(fits, 0).otherwise(find).cast("int").alias("k"), acc["n"].alias("n"), acc["most"].alias("most"))
        made = F.struct(*[after[f].alias(f) for f in FIELDS], acc["k"].alias("k"), (acc["n"] + F.when(acc["k"] > 0, 1).otherwise(0)).cast("int").alias("n"), acc["most"].alias("most"))
        return F.when(acc["k"] == 0, acc).when(i % 2 == 1, looked).otherwise(made)

    first = lambda f: F.when(F.col(most) > 0, F.slice(f, 1, soft[f])).otherwise(F.col(f)) if f in soft else F.col(f)
    begin = F.struct(*[first(f).alias(f) for f in FIELDS], F.when(F.col(most) > 0, -1).otherwise(0).cast("int").alias("k"), F.lit(0).cast("int").alias("n"), F.col(most).cast("int").alias("most"))
    done = package.select("*", F.aggregate(F.sequence(F.lit(1), F.lit(2 * STEPS)), begin, turn).alias("_done"))
    return done.withColumns({f: F.col(f"_done.{f}") for f in FIELDS}).withColumn("cuts", F.col("_done.n")).drop("_done")


def assembled(tasks: DataFrame, hits: DataFrame, chunks: DataFrame, found: DataFrame | None = None, recipes: DataFrame | None = None, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(qid, FIELDS, roots, cuts, estimated_tokens, fingerprint): one package for each task.

    tasks has qid and task, and may have version (asked for) and most_tokens (the budget). hits has qid, rank and
    chunk_id, a dozen or so a task; chunks their texts and attributes; found (qid, place, name, kind) symbols; recipes one
    (qid, subject) a task with the fields that recipes.read gives. A task without any of these gives an empty package of
    low coverage. qids must differ.
    """
    none = F.array().cast("array<string>")
    t = tasks.select("qid", F.trim("task").alias("task"), (F.lower(F.trim("version")) if "version" in tasks.columns else F.lit("")).alias("want"), (F.coalesce("most_tokens", F.lit(most_tokens)) if "most_tokens" in tasks.columns else F.lit(most_tokens)).alias("most"))
    text = F.coalesce(F.col("body"), F.lit(""))
    rows = hits.select("qid", "rank", "chunk_id").join(chunks.select("chunk_id", "uri", "title", "heading", "authority", "root_name", "product_version", "archived", "body"), "chunk_id")
    rows = rows.select("qid", F.struct("rank", "chunk_id", "uri", "title", F.coalesce("heading", F.lit("")).alias("section"), "authority", "root_name", F.coalesce("product_version", F.lit("")).alias("version"), F.coalesce("archived", F.lit(False)).alias("archived"), clip(clean_body(text), EXCERPT).alias("excerpt")).alias("h"))
    rows = rows.groupBy("qid").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    out = t.join(rows, "qid", "left")
    if found is not None:
        one = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "name", "kind"))).alias("syms"))
        out = out.join(one, "qid", "left")
    if recipes is not None:
        out = out.join(recipes.select("qid", F.struct("subject", "apis", "includes", "prereqs", "sequence", "constraints", "pitfalls", "examples", "version").alias("r")), "qid", "left")
    of = lambda f, empty: F.coalesce(F.col("r")[f], empty) if recipes is not None else empty
    hs = F.coalesce("hs", F.array().cast(dict(rows.dtypes)["hs"]))
    out = out.withColumn("hs", hs).withColumn("syms", F.coalesce(F.transform("syms", lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"))), F.array().cast(TYPES["symbols"])) if found is not None else F.array().cast(TYPES["symbols"]))
    low = lambda h: F.lower(F.concat(h["section"], F.lit(" "), h["excerpt"]))
    texts = lambda cond, n: F.array_distinct(F.transform(F.filter("hs", cond), lambda h: clip(h["excerpt"], n)))
    official = [a for a, _ in AUTHORITIES][:4]
    examples = F.transform(F.filter("hs", lambda h: h["authority"].isin(*official) | F.contains(low(h), F.lit("example"))), lambda h: F.struct(h["uri"].alias("uri"), h["title"].alias("title"), h["excerpt"].alias("excerpt")))
    cited = F.transform("hs", lambda h: F.struct(h["uri"].alias("uri"), h["title"].alias("title"), h["section"].alias("section"), h["authority"].alias("authority"), h["root_name"].alias("root_name"), h["version"].alias("version")))
    cited = F.filter(cited, lambda c, i: (i == 0) | ~F.exists(F.slice(F.transform("hs", lambda h: h["uri"]), F.lit(1), i), lambda u: u == c["uri"]))
    steps = F.get(F.filter(F.transform(F.filter("hs", lambda h: holds(low(h), WORKFLOW)), lambda h: items(h["excerpt"])), lambda x: F.size(x) >= 2), F.lit(0))
    own = F.col("r")["sequence"] if recipes is not None else F.lit(None).cast("array<string>")
    lines = F.flatten(F.transform("hs", lambda h: F.filter(F.transform(F.split(h["excerpt"], "\n"), F.trim), lambda l: F.startswith(l, F.lit("#include")))))
    out = out.select(
        "qid", "task", "want", "most",
        F.coalesce(of("subject", F.lit(None).cast("string")), F.get("hs", F.lit(0))["title"], F.lit("")).alias("summary"),
        F.array_distinct(F.concat(of("apis", none), F.transform("syms", lambda s: s["name"]), api_words(F.col("task")))).alias("apis"),
        F.col("syms").alias("symbols"),
        F.array_distinct(F.concat(of("includes", none), lines)).alias("includes"),
        of("prereqs", none).alias("prerequisites"),
        F.coalesce(F.when(F.size(own) > 0, own), steps, none).alias("sequence"),
        F.slice(F.concat(F.transform(of("examples", none), lambda e: F.struct(F.lit("").alias("uri"), F.col("r")["subject"].alias("title"), e.alias("excerpt"))) if recipes is not None else F.array().cast(EXAMPLE), examples), 1, MOST_EXAMPLES).alias("examples"),
        F.array_distinct(F.concat(of("constraints", none), texts(lambda h: holds(low(h), CONSTRAINT), SIGNAL))).alias("constraints"),
        F.array_distinct(F.concat(of("pitfalls", none), texts(lambda h: holds(low(h), PITFALL), SIGNAL))).alias("pitfalls"),
        texts(lambda h: h["authority"] == "current_project", CONVENTION).alias("conventions"),
        F.slice(cited, 1, MOST_CITATIONS).alias("citations"),
        F.exists("hs", lambda h: h["archived"]).alias("archived"),
        F.lit(NOTE).alias("note"),
    )
    count = lambda c: F.when(c, 1).otherwise(0)
    some = lambda c: F.size(c) > 0
    points = 2 * count(some("apis") | some("symbols")) + 2 * count(some("examples")) + count(F.size("citations") >= 3) + count(some("constraints") | some("pitfalls")) + count(some("sequence"))
    versions = F.array_distinct(F.filter(F.transform("citations", lambda c: F.lower(F.trim(c["version"]))), lambda v: ~v.isin("", "unknown")))
    asked = ~F.coalesce("want", F.lit("")).isin("", "unknown")
    fresh = F.when(~some("citations"), "unknown").when(F.col("archived"), "stale").when((F.size(versions) > 1) | (asked & some(versions) & ~F.array_contains(versions, F.col("want"))), "mixed")
    fresh = fresh.when(asked & ~some(versions), "unknown").when(some(versions), "version-specific").when(F.exists("citations", lambda c: authority_rank(c["authority"]) <= 2), "current").otherwise("unknown")
    out = out.withColumns({"coverage": F.when(points >= 5, "high").when(points >= 2, "medium").otherwise("low"), "freshness": fresh})
    gaps = (("No symbols matched the task.", ~some("symbols")), ("No source-grounded call sequence was located.", ~some("sequence")), ("The version of the sources is not known.", F.col("freshness") == "unknown"))
    known = lambda pairs: F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in pairs]), lambda m: m.isNotNull())
    out = out.withColumns({"missing": known(gaps), "follow_ups": known((("Search the web: local sources don't cover this.", (F.col("coverage") == "low") | F.col("freshness").isin("stale", "mixed", "unknown")),))})
    out = trimmed(out.select("qid", *FIELDS, "most"), "most")
    return out.select("qid", *FIELDS, F.array_distinct(F.transform("citations", lambda c: c["root_name"])).alias("roots"), "cuts", tokens_of(F.col).alias("estimated_tokens"), F.sha2(payload(F.col), 256).alias("fingerprint"))
