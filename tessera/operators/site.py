"""Pages of generated sites: the element that holds a page's own text, found by the depth of its tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: an element of so many characters or fewer is not taken for the page's text.
TOO_SHORT = 40
#: Elements that may hold the text, whose depth is followed.
FOLLOWED = ("div", "article", "main", "section")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's quoted value in an opening tag, in lower case; empty without it."""
    return F.lower(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)""", 1))


def preference(profile: Column, name: Column, tag: Column) -> Column:
    """How well an opening tag of a profile's page announces the text: 1 best, null not at all."""
    role, classes, own = attribute(tag, "role"), attribute(tag, "class"), attribute(tag, "id")
    sphinx = F.when((name == "div") & (role == "main"), 1).when((name == "div") & F.contains(classes, F.lit("document")), 2)
    sphinx = sphinx.when(own.isin("content", "main-content") | (classes == "body"), 3).when(name.isin("article", "main"), 4)
    doxygen = F.when((name == "div") & F.contains(classes, F.lit("contents")), 1)
    return F.when(profile == "sphinx", sphinx).when(profile == "doxygen", doxygen)


def main_elements(pages: DataFrame, key: str) -> DataFrame:
    """(key, main): what the main element of each page (key, html, profile) holds; of other pages, all of it.

    A page is cut at its tags, depth is a running sum over each page's tags of a name, and an element ends where the depth
    falls below that of its start, or with the page. Among the elements of the best preference that are long enough the
    first is taken. Scripts, styles and comments are dropped first, as tags in them are none. Keys must differ; a page
    without text gives null.
    """
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->", "")
    cut = pages.select(key, "html", "profile", F.split(bare, "<", -1).alias("pieces"), (F.char_length(bare) + 1).alias("whole"))
    some = cut.where(F.col("profile").isin("sphinx", "doxygen"))
    piece = some.select(key, "profile", "whole", F.posexplode("pieces").alias("at", "piece"))
    word = F.lower(F.regexp_extract("piece", r"^/?([A-Za-z][A-Za-z0-9]*)", 1))
    size = F.sum(F.char_length("piece") + 1).over(Window.partitionBy(key).orderBy("at"))
    tags = piece.withColumn("until", size).withColumn("name", word).where((F.col("at") > 0) & F.col("name").isin(*FOLLOWED))
    tag = F.substring_index("piece", ">", 1)
    ends = F.startswith("piece", F.lit("/")) | F.endswith(tag, F.lit("/"))
    step = F.when(F.startswith("piece", F.lit("/")), -1).when(F.endswith(tag, F.lit("/")), 0).otherwise(1)
    deep = Window.partitionBy(key, "name").orderBy("at")
    tags = tags.select(key, "profile", "whole", "at", "until", "name", tag.alias("tag"), (F.char_length("piece") - F.char_length(tag)).alias("rest"), ends.alias("ends"), step.alias("step"), F.sum(step).over(deep).alias("depth"))
    best = preference(F.col("profile"), F.col("name"), F.col("tag"))
    opened = tags.where(~F.col("ends")).withColumn("best", best).where("best is not null")
    opened = opened.select(key, "at", "name", "depth", "best", "whole", (F.col("until") - F.col("rest")).alias("from"))
    closed = tags.where("step < 0").select(key, "name", F.col("at").alias("close"), F.col("depth").alias("under"), (F.col("until") - F.char_length("tag") - F.col("rest") - 1).alias("to"))
    met = opened.join(closed.withColumn("depth", F.col("under") + 1), [key, "name", "depth"], "left").where("close is null or close > at")
    met = met.groupBy(key, "at", "best", "from").agg(F.min(F.struct("close", "to")).alias("c"))
    # an element whose ends all lie before it is left without one
    met = opened.select(key, "at", "best", "from", "whole").join(met, [key, "at", "best", "from"], "left")
    long = met.where(F.coalesce("c.to", "whole") - F.col("from") - 1 > TOO_SHORT)  # one is the tag's own end
    first = long.groupBy(key).agg(F.min(F.struct("best", "at", "c.close")).alias("m")).select(key, "m.at", "m.close")
    inside = F.array_join(F.slice("pieces", F.col("at") + 1, F.coalesce(F.col("close"), F.size("pieces")) - F.col("at")), "<")
    inside = F.substr(inside, F.instr(inside, ">") + 1)
    main = F.when(F.col("at").isNotNull(), inside).otherwise(F.col("html"))
    return cut.join(first, key, "left").select(key, main.alias("main"))
