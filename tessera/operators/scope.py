"""Which roots requests cover, for whole tables of requests: named outright, inferred from texts, or a knowledge group's.

Tables: requests (request_id, query, explicit: array of names), roots (root_name), cues (cue, root, weight), groups (id, name,
policies: JSON text) and members (group_name, root_name, role, priority). All lookups are joins on equal keys; what is
looked for within a query is found by its first three characters and looked at in the text only then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Roles whose roots always belong to a group's scope; the other role; words that tell product families,
#: and endings that a name loses where none of these words is in it.
ALWAYS = ("official_documentation", "official_example", "curated_knowledge", "current_project")
RELATED = "related_project"
FAMILIES = ("network", "plugin", "device", "embedded", "database", "sqlite", "control", "mcp", "logging", "config", "concurrency", "http", "cache", "protocol", "noise")
ENDINGS = ("sdk", "app", "service", "docs", "server", "tool", "reference", "project", "lib")
#: Policies of a group that has none, what a named root scores, and the share of the best score that is kept.
POLICIES = {"allowCrossRootRetrieval": True, "preferCurrentProjectWhenSpecified": True, "includeRelatedProjectsForPatterns": True, "maxRelatedProjects": 3}
ROOT_NAMED, KEPT_SHARE = 100, 60


def policies(text: Column) -> Column:
    """A struct of policies from JSON: all defaults for blank, {} and broken text, else what is missing is false or 0."""
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in POLICIES.items())
    p = F.from_json(text, f"{kinds}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    whole = (blank == "null") | (~blank.isin("", "{}") & blank.startswith("{") & p["_broken"].isNull())
    zero = lambda v: F.lit(False) if isinstance(v, bool) else F.lit(0)
    value = lambda k, v: F.when(whole, F.coalesce(p[k], zero(v))).otherwise(F.lit(v))
    fields = {k: value(k, v) for k, v in POLICIES.items()}
    fields["maxRelatedProjects"] = F.greatest(fields["maxRelatedProjects"], F.lit(0))
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def family(root: Column) -> Column:
    """The product family that a root's name tells; if none, the name itself, in lower case and without one ending of its role."""
    r = F.regexp_replace(F.regexp_replace(F.lower(F.trim(root)), "^example-", ""), "^demo-", "")
    out = F
    for word in FAMILIES:
        out = out.when(F.contains(r, F.lit(word)), "database" if word == "sqlite" else word)
    rest = F.regexp_replace(r, f"-({'|'.join(ENDINGS)})$", "")
    return out.otherwise(F.when(rest != r, rest).otherwise(F.concat(F.lit("other:"), r)))


def from_config(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a parsed configuration of groups, camel-case names as in its file."""
    import json

    groups = config.get("groups") or []
    named = [(g.get("id", ""), g.get("name") or g.get("id", ""), json.dumps({**POLICIES, **(g.get("policies") or {})})) for g in groups]
    inside = [(n, m["rootName"], m.get("role") or RELATED, int(m.get("priority") or 0)) for g, (_, n, _) in zip(groups, named, strict=True) for m in g.get("members") or []]
    return spark.createDataFrame(named, "id string, name string, policies string"), spark.createDataFrame(inside, "group_name string, root_name string, role string, priority int")


def group_of(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(root_name, key): the id (the name, without one) of each root's first group by name."""
    g = groups.select(F.col("name").alias("group_name"), F.coalesce(F.nullif(F.col("id"), F.lit("")), "name").alias("key"))
    return members.join(g, "group_name").groupBy("root_name").agg(F.min_by("key", "group_name").alias("key"))


def looked_up(groups: DataFrame) -> DataFrame:
    """(key, name, id, p): groups by id and by name in lower case; of several with one key those by id, then the first by name."""
    g = groups.select("name", F.coalesce(F.nullif(F.col("id"), F.lit("")), "name").alias("id"), F.lower("id").alias("by_id"), F.lower("name").alias("by_name"), policies(F.col("policies")).alias("p"))
    keys = g.select(F.posexplode(F.array("by_id", "by_name")).alias("way", "key"), "name", "id", "p").where("key <> ''")
    return keys.groupBy("key").agg(F.min_by(F.struct("name", "id", "p"), F.struct("way", "name")).alias("g")).select("key", "g.*")


def expand(asks: DataFrame, groups: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(ask_id, group, roots, reason) of asks (ask_id, group, preferred, project, only_preferred), one row each.

    A group is named by id or name in any case. Its roots are, in this order: those of standing roles by priority, the
    project, preferred projects as listed, and related ones up to the policy's number; all that are there if that makes
    none. With only_preferred, preferred roots of the group and the project alone, by name, if there is one. reason is
    null, unknown_group, forbidden (by policy) or no_members; then roots is empty. ask_ids must differ.
    """
    clean = F.transform(F.coalesce("preferred", F.array().cast("array<string>")), lambda x: F.trim(x))
    a = asks.select("ask_id", F.lower(F.trim("group")).alias("key"), clean.alias("preferred"), F.trim("project").alias("project"), F.coalesce("only_preferred", F.lit(False)).alias("only"))
    named = a.join(looked_up(groups), "key", "left")
    place = F.row_number().over(Window.partitionBy("group_name", "role").orderBy(F.desc("priority"), "root_name"))
    m = members.select("group_name", "root_name", "role", F.coalesce("priority", F.lit(0)).alias("priority")).distinct()
    present = m.join(roots.select("root_name").distinct(), "root_name", "left_semi").withColumn("place", place)
    rows = named.where("p.allowCrossRootRetrieval").join(present.withColumnRenamed("group_name", "name"), "name")
    at, mine = F.array_position("preferred", F.col("root_name")), F.col("root_name") == F.col("project")
    rank = lambda stage, n: F.struct(F.lit(stage).alias("stage"), n.cast("long").alias("n"), F.col("root_name").alias("root"))
    chosen = (
        F.when(F.col("role").isin(*ALWAYS), rank(0, -F.col("priority")))
        .when(F.col("p.preferCurrentProjectWhenSpecified") & mine, rank(1, F.lit(0)))
        .when((at > 0) & (F.col("role") == RELATED), rank(2, at))
        .when(F.col("p.includeRelatedProjectsForPatterns") & (F.col("role") == RELATED) & (F.col("place") <= F.col("p.maxRelatedProjects")), rank(3, F.col("place")))
    )
    found = rows.groupBy("ask_id").agg(
        F.collect_list(chosen).alias("chosen"),
        F.collect_list(rank(0, -F.col("priority"))).alias("all"),
        F.collect_set(F.when(F.col("only") & (at > 0), F.col("root_name"))).alias("liked"),
        F.collect_set(F.when(mine, F.col("root_name"))).alias("own"),
    )
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(c), lambda x: x["root"]))
    scope = F.when(F.size("liked") > 0, F.array_sort(F.array_union("liked", "own"))).when(F.size("chosen") > 0, ordered("chosen")).otherwise(ordered("all"))
    out = named.select("ask_id", "id", "p").join(found.select("ask_id", scope.alias("roots")), "ask_id", "left")
    reason = F.when(F.col("id").isNull(), "unknown_group").when(~F.col("p.allowCrossRootRetrieval"), "forbidden").when(F.col("roots").isNull(), "no_members")
    return out.select("ask_id", F.col("id").alias("group"), F.coalesce("roots", F.array().cast("array<string>")).alias("roots"), reason.alias("reason"))


def infer(requests: DataFrame, roots: DataFrame, cues: DataFrame) -> DataFrame:
    """(request_id, roots, hints) of requests (request_id, query) in which a cue or a root's name stands, case aside.

    Roots that are there score their cues' weights and 100 if named; those with 60 % of the best score stay, by name.
    """
    names = roots.select(F.col("root_name").alias("root")).where("root <> ''").distinct()
    own = names.select(F.lower("root").alias("cue"), F.concat(F.lit("root:"), "root").alias("hint"), "root", F.lit(ROOT_NAMED).alias("weight"))
    needles = cues.where("cue <> ''").select("cue", F.trim("cue").alias("hint"), "root", F.col("weight").cast("int").alias("weight")).unionByName(own)
    texts = requests.select("request_id", F.lower("query").alias("text"))
    runs = texts.select("request_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)(?=(.{1,3}))"), F.lit(1)))).alias("run"))
    runs = runs.select("request_id", F.explode(F.array_distinct(F.array("run", F.left("run", F.lit(2)), F.left("run", F.lit(1))))).alias("run"))
    first = needles.select("cue", F.left("cue", F.lit(3)).alias("run")).distinct()
    near = runs.join(first, "run").select("request_id", "cue").distinct()
    hits = near.join(texts, "request_id").where(F.contains("text", "cue")).select("request_id", "cue").join(needles, "cue")
    told = hits.groupBy("request_id").agg(F.array_sort(F.collect_set("hint")).alias("hints"))
    scores = hits.join(names, "root", "left_semi").groupBy("request_id", "root").agg(F.sum("weight").alias("score"))
    best = scores.groupBy("request_id").agg(F.max("score").alias("top"), F.collect_list(F.struct("root", "score")).alias("all"))
    kept = F.transform(F.filter("all", lambda x: x["score"] * 100 >= F.col("top") * KEPT_SHARE), lambda x: x["root"])
    return told.join(best.select("request_id", F.array_sort(kept).alias("roots")), "request_id", "left")


def resolve(requests: DataFrame, roots: DataFrame, cues: DataFrame, groups: DataFrame, members: DataFrame, family_of=family) -> DataFrame:
    """(request_id, roots, group, reason, detail, hints), one row a request.

    Names given outright count before what texts tell; without them the only root there is, or the inferred ones. Several
    roots of one group become the group's scope; without groups they must be of one family. reason is null, or why a
    choice is needed: unknown_root (detail: the first such name), no_roots, not_inferred, several_groups (detail: their
    keys), forbidden (by the group's policy) or several_families; then roots has what was found so far. Nulls and blanks
    among explicit are ignored; request_ids must differ.
    """
    empty = F.array().cast("array<string>")
    names = roots.select("root_name").where("root_name <> ''").distinct()
    some = [r.root_name for r in names.limit(2).collect()]
    said = requests.select("request_id", "query", F.filter(F.transform(F.coalesce("explicit", empty), lambda x: F.trim(x)), lambda x: x != "").alias("said"))
    told = said.select("request_id", F.posexplode("said").alias("place", "root_name")).join(names.withColumn("known", F.lit(True)), "root_name", "left")
    told = told.groupBy("request_id").agg(F.min(F.when(F.col("known").isNull(), F.struct("place", "root_name")))["root_name"].alias("unknown"), F.array_sort(F.collect_set("root_name")).alias("given"))
    base = said.select("request_id", "said").join(told, "request_id", "left")
    free = F.size("said") == 0
    if len(some) > 1:
        base = base.join(infer(said.where(free), names, cues).select("request_id", F.col("roots").alias("read"), "hints"), "request_id", "left")
    else:
        base = base.withColumns({"read": F.array(*map(F.lit, some)).cast("array<string>"), "hints": F.array(F.lit("only one root in database")) if some else empty})
    wanted = F.when(free, F.coalesce("read", empty)).when(F.col("unknown").isNull(), F.col("given")).otherwise(empty)
    hints = F.when(free, F.coalesce("hints", empty)).when(F.col("unknown").isNull(), F.array(F.lit("explicit rootName"))).otherwise(empty)
    reason = F.when(F.col("unknown").isNotNull(), "unknown_root").when(F.size(wanted) == 0, "not_inferred" if some else "no_roots")
    base = base.select("request_id", wanted.alias("wanted"), hints.alias("hints"), reason.alias("reason"), F.col("unknown").alias("detail"))
    each = base.where(F.size("wanted") > 1).select("request_id", F.explode("wanted").alias("root_name")).join(group_of(groups, members), "root_name", "left")
    each = each.groupBy("request_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.count_distinct(family_of(F.col("root_name"))).alias("families"))
    asks = group_of(groups, members).select(F.col("key").alias("ask_id"), F.col("key").alias("group"), F.lit(None).cast("array<string>").alias("preferred"), F.lit("").alias("project"), F.lit(False).alias("only_preferred")).distinct()
    scopes = expand(asks, groups, members, names).select(F.col("ask_id").alias("key"), F.col("roots").alias("scope"), F.col("reason").alias("barred"), F.col("group").alias("found"))
    out = base.join(each, "request_id", "left").withColumn("key", F.when(F.size("keys") == 1, F.get("keys", F.lit(0)))).join(scopes, "key", "left")
    taken = F.col("scope").isNotNull() & F.col("barred").isNull()
    why = F.coalesce("reason", F.when(F.size("keys") > 1, "several_groups").when(F.col("barred") == "forbidden", "forbidden").when((F.size("keys") == 0) & (F.col("families") > 1), "several_families"))
    return out.select(
        "request_id",
        F.when(taken, F.col("scope")).otherwise(F.col("wanted")).alias("roots"),
        F.when(taken, F.col("found")).alias("group"),
        why.alias("reason"),
        F.coalesce("detail", F.when(F.size("keys") > 1, F.array_join("keys", ", "))).alias("detail"),
        F.when(taken, F.concat("hints", F.array(F.concat(F.lit("knowledgeGroup:"), "found")))).otherwise(F.col("hints")).alias("hints"),
    )
