"""Playbooks: several searches about a subject, the best hit of each chunk, frequent API names, and a Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.excerpts import CALLS
from ..functions.text import content_tokens

#: Weights of the queries, of where an API name stands, and how many are named.
SUBJECT, EXAMPLE, SAMPLE, TOKEN = 8.0, 5.0, 5.0, 1.0
PER_TOKEN, IN_SUBJECT, IN_SAMPLE, MOST_APIS = 25.0, 6, 3, 10
#: Names that are called everywhere, and starts of names of tests and dialogs, in lower case.
NOISE = "if for while switch return sizeof typeof printf scanf gets puts main usermain sprintf snprintf fprintf malloc free memcpy memset".split()
NOISE_STARTS = ("dialog", "test")


def queries(subjects: DataFrame) -> DataFrame:
    """(qid, part, query, weight): a subject's queries: itself, as an example, as a sample, and each of its words."""
    s = subjects.select("qid", F.trim("subject").alias("subject"))
    made = F.array(
        F.struct(F.col("subject").alias("query"), F.lit(SUBJECT).alias("weight")),
        F.struct(F.concat("subject", F.lit(" example")).alias("query"), F.lit(EXAMPLE).alias("weight")),
        F.struct(F.concat("subject", F.lit(" sample")).alias("query"), F.lit(SAMPLE).alias("weight")),
    )
    words = F.transform(F.array_distinct(content_tokens(F.col("subject"))), lambda t: F.struct(t.alias("query"), F.lit(TOKEN).alias("weight")))
    return s.select("qid", F.posexplode(F.concat(made, words)).alias("part", "q")).select("qid", "part", "q.query", "q.weight")


def recall(hits: DataFrame, subjects: DataFrame, chunks: DataFrame, limit: int = 30) -> DataFrame:
    """(qid, rank, chunk_id, score): hits (qid, chunk_id, score, weight) of all queries, each chunk by its best.

    A score is weighted and raised for each word of the subject that the chunk's path or title holds.
    """
    w = Window.partitionBy("qid", "chunk_id").orderBy(F.desc("_s"))
    best = hits.withColumn("_s", F.col("score") * F.col("weight")).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "chunk_id", "_s")
    tokens = subjects.select("qid", F.transform(content_tokens(F.col("subject")), F.lower).alias("ts"))
    b = best.join(chunks.select("chunk_id", F.lower(F.concat_ws(" ", "path", "title")).alias("where")), "chunk_id").join(tokens, "qid")
    b = b.withColumn("score", F.col("_s") + PER_TOKEN * F.size(F.filter("ts", lambda t: F.contains(F.col("where"), t))))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= limit).select("qid", "rank", "chunk_id", "score")


def frequent_apis(texts: DataFrame, subjects: DataFrame, limit: int = MOST_APIS) -> DataFrame:
    """(qid, rank, api, n): API names called, by weighted count over texts (qid, text, kind); samples and the subject weigh more."""
    names = F.concat(*[F.regexp_extract_all("text", F.lit(c), 1) for c in CALLS])
    names = F.filter(names, lambda n: ~F.lower(n).isin(*NOISE) & ~F.lower(n).rlike("^(" + "|".join(NOISE_STARTS) + ")"))
    weight = F.when(F.col("kind") == "snippet", 4).when(F.col("kind") == "sample", IN_SAMPLE).otherwise(1)
    n = texts.select("qid", weight.alias("w"), F.explode(names).alias("api")).groupBy("qid", "api").agg(F.sum("w").alias("n"))
    n = n.join(subjects.select("qid", F.lower("subject").alias("s")), "qid").withColumn("n", F.col("n") + F.when(F.contains("s", F.lower("api")), IN_SUBJECT).otherwise(0))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "api"))).where(F.col("rank") <= limit).select("qid", "rank", "api", "n")


def render(subject: str, hits: list[dict], apis: list[str], steps: list[str]) -> str:
    """A playbook as Markdown."""
    cell = lambda s: str(s).replace("|", "\\|").replace("\n", " ")
    out = [f"# {subject}", "", "## APIs", "", *[f"- `{a}`" for a in apis], "", "## Steps", "", *[f"{i}. {s}" for i, s in enumerate(steps, 1)], "", "## Sources", "", "| Title | Path |", "| --- | --- |"]
    return "\n".join([*out, *[f"| {cell(h['title'])} | {cell(h['path'])} |" for h in hits], ""])
