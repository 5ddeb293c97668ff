"""Excerpts: the telling lines of a text, windows around them, and text cleaned of markup. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reads as a call of an API: a name that begins with a capital, perhaps qualified or with a member,
#: or a name with underscores, before an opening bracket. And what a line counts for what it holds.
CALLS = (r"\b((?:[A-Za-z_]\w*::)?[A-Z][A-Za-z0-9]+(?:\.[A-Z][A-Za-z0-9]+)?)\s*\(", r"\b([a-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\s*\(")
PER_TOKEN, API_LINE, CALL_LINE, SIGNATURE_LINE, LONG_LINE = 2, 6, 4, 5, 400
SIGNATURES = ("int f_", "void f_", "long f_", "f_file *")


def holds_call(text: Column) -> Column:
    """Whether a text calls an API."""
    return text.rlike(CALLS[0]) | text.rlike(CALLS[1])


def line_scores(lines: Column, tokens: Column) -> Column:
    """How telling each line is: tokens of the subject in it, API calls, and signatures; a long line without calls hardly counts.

    Each step reads what the one before has made: a lambda computes an expression anew wherever it stands.
    """
    read = F.transform(lines, lambda l: F.struct(l.alias("l"), F.lower(l).alias("low"), holds_call(l).alias("api")))

    def score(x: Column) -> Column:
        held = F.size(F.filter(tokens, lambda t: (t != "") & F.contains(x["low"], F.lower(t))))
        signature = F.lit(False)
        for s in SIGNATURES:
            signature = signature | F.contains(x["low"], F.lit(s))
        sums = PER_TOKEN * held + F.when(x["api"], API_LINE).otherwise(0) + F.when(F.contains(x["low"], F.lit("f_")) & F.contains(x["l"], F.lit("(")), CALL_LINE).otherwise(0)
        return sums + F.when(signature, SIGNATURE_LINE).otherwise(0)

    scored = F.transform(read, lambda x: F.struct(score(x).alias("s"), ((F.octet_length(x["l"]) > LONG_LINE) & ~x["api"]).alias("long")))
    return F.transform(scored, lambda x: F.when(x["long"] & (x["s"] > 0), 1).otherwise(x["s"]))


def line_score(line: Column, tokens: Column) -> Column:
    """How telling one line is."""
    return F.get(line_scores(F.array(line), tokens), F.lit(0))


def best_line(lines: Column, tokens: Column) -> Column:
    """The place (from 0) of the first line of the highest score; -1 where no line scores."""
    best = F.array_max(F.transform(line_scores(lines, tokens), lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
    return F.coalesce(F.get(F.transform(F.array(best), lambda b: F.when(b["s"] > 0, -b["i"]).otherwise(-1)), F.lit(0)), F.lit(-1))


def window_at(lines: Column, best: Column, most: int) -> Column:
    """At most so many lines, a third of them before the one at a place; empty for a place below 0."""
    start = F.greatest(F.lit(0), F.least(best - most // 3, F.size(lines) - most))
    first = F.get(lines, start)
    blob = (start < best) & (F.octet_length(first) > LONG_LINE) & ~holds_call(first)
    end = F.least(start + most, F.size(lines))
    end = F.when(blob & (end <= best), F.least(F.size(lines), best + most)).otherwise(end)
    start = F.when(blob, best).otherwise(start)
    return F.when(best < 0, "").otherwise(F.btrim(F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n"), F.lit(" \t\r\n")))


def window_around(text: Column, tokens: Column, most: int) -> Column:
    """At most so many lines, a third of them before the most telling one; empty where none is."""
    lines = F.split(text, "\n")
    return window_at(lines, best_line(lines, tokens), most)


def around_subject(text: Column, tokens: Column, budget: int) -> Column:
    """At most so many characters, a quarter of them before the most telling line."""
    lines = F.split(text, "\n")
    best = best_line(lines, tokens)
    offset = F.when(best > 0, F.char_length(F.array_join(F.slice(lines, 1, F.greatest(best, F.lit(0))), "\n")) + 1).otherwise(0)
    start = F.greatest(F.lit(0), F.least(offset - budget // 4, F.char_length(text) - budget))
    return F.when(F.char_length(text) <= budget, text).otherwise(F.substr(text, start + 1, F.lit(budget)))


def trimmed_excerpt(text: Column, most: int) -> Column:
    """The first lines of a text, without copyright notices, comment marks, fences and blank lines at its start."""
    lines = F.split(F.btrim(text, F.lit(" \t\r\n")), "\n")
    noise = lambda l: F.trim(l).isin("", "*/", "/*") | F.contains(l, F.lit("Copyright")) | F.startswith(F.trim(l), F.lit("```"))
    first = F.coalesce(F.get(F.filter(F.transform(lines, lambda l, i: F.when(~noise(l), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(lines))
    return F.btrim(F.array_join(F.slice(lines, first + 1, F.lit(most)), "\n"), F.lit(" \t\r\n"))


def clean_body(text: Column) -> Column:
    """A text without tags and images, entities read once; what stands between angles in an include stays.

    Lines that include nothing (their file was a tag) become one remark where there are several in a row.
    """
    out = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?m)^([ \t]*#[ \t]*include[ \t]*)<([^>\r\n]+)>", "$1\x01$2\x02")
    out = F.regexp_replace(out, r"</?[A-Za-z][A-Za-z0-9]*\b[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.translate(F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", ""), "\x01\x02", "<>")
    out = F.regexp_replace(out, r"(?m)(?:^[ \t]*#[ \t]*include[ \t]*\n){2,}", "/* #include … */\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))
