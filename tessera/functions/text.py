"""Column functions over text: tokens, identifiers, symbols, excerpts, paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search query, and in a term vector.
QUERY_STOPWORDS = (
    "a an the and or to of in on for with from into by as is are be this that it at add use using make create please "
    "how do does can should must need needed new"
).split()
TERM_STOPWORDS = (
    "the and for with that this from into your are was were been have has had not but you all any can may use using "
    "used via when then than also such only over after before about void null true false return func function class "
    "const var let int string bool error nil"
).split()
#: Fixed values of the token rules.
QUERY_OPERATORS = ("AND", "OR", "NOT", "NEAR")
TRIMMED = ".,;:()[]{}\"'"
LEAST_BYTES = 3
MOST_TERMS = 48
RUNES_PER_TOKEN = 4

IDENTIFIER_BORDER = r"_|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def lit_array(values) -> Column:
    return F.array(*map(F.lit, values))


def query_tokens(q: Column) -> Column:
    """White-space fields of a query, without operator words standing alone."""
    return F.filter(F.split(F.trim(q), r"\s+"), lambda t: (t != "") & ~F.upper(t).isin(*QUERY_OPERATORS))


def content_tokens(q: Column) -> Column:
    """The query tokens that carry meaning; all of them if none does."""
    tokens = query_tokens(q)

    def carries(t: Column) -> Column:
        bare = F.lower(F.btrim(t, F.lit(TRIMMED)))
        return (F.octet_length(bare) >= LEAST_BYTES) & ~bare.isin(*QUERY_STOPWORDS)

    kept = F.filter(tokens, carries)
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def match_query(q: Column, joiner: str = " AND ") -> Column:
    """The full-text query: each content token as a quoted phrase."""
    clean = F.filter(F.transform(content_tokens(q), lambda t: F.trim(F.replace(t, F.lit('"'), F.lit("")))), lambda t: ~t.isin("", "*"))
    return F.array_join(F.transform(clean, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), joiner)


def identifier_parts(token: Column) -> Column:
    """An identifier's parts: at underscores, lower to upper, digit to upper, and acronym to word."""
    return F.filter(F.split(token, IDENTIFIER_BORDER), lambda p: p != "")


def terms(text: Column) -> Column:
    """Terms of a text, in order: each word in lower case, then its parts if it has several; no short or stop words."""
    raw = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}_]+)"), 1)

    def expand(w: Column) -> Column:
        parts = F.transform(identifier_parts(w), F.lower)
        several = F.concat(F.array(F.lower(w)), F.when(F.size(parts) >= 2, F.filter(parts, lambda p: p != F.lower(w))).otherwise(F.array().cast("array<string>")))
        return F.when(w.rlike(r"_|.\p{Lu}"), several).otherwise(F.array(F.lower(w)))  # other words have no border

    return F.filter(F.flatten(F.transform(raw, expand)), lambda t: (F.octet_length(t) >= LEAST_BYTES) & ~t.isin(*TERM_STOPWORDS))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + n / (df + 1)) + 1, n at least 1 and df at least 0."""
    return F.log(F.lit(1.0) + F.greatest(n, F.lit(1)).cast("double") / (F.greatest(df, F.lit(0)) + 1)) + 1


def token_estimate(text: Column) -> Column:
    """Code points by four, rounded up."""
    return F.ceil(F.char_length(text) / RUNES_PER_TOKEN).cast("long")


def clip_excerpt(text: Column, n: int) -> Column:
    """At most n code points; a longer text is cut back to white space within 40 bytes, and marked."""
    head = F.left(text, F.lit(n))
    back = F.regexp_extract(head, r"^([\s\S]*)[ \n][^ \n]*$", 1)
    near = (F.octet_length(head) - F.octet_length(back) <= 40) & (back != "")
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.rtrim(F.when(near, back).otherwise(head)), F.lit("…")))


def marked_excerpt(text: Column, words: Column, n: int) -> Column:
    """The n white-space fields around the first one that holds one of the words, with such fields between <b> and </b>.

    A text without any of them gives its first n fields; an ellipsis stands for what is left out.
    """
    fields = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hit = lambda w: F.arrays_overlap(F.regexp_extract_all(F.lower(w), F.lit(r"([\p{L}\p{Nd}]+)"), 1), words)
    at = F.coalesce(F.get(F.filter(F.transform(fields, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    start = F.greatest(F.lit(0), F.least(at - n // 2, F.size(fields) - n))
    shown = F.transform(F.slice(fields, start + 1, F.lit(n)), lambda w: F.when(hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    left, right = F.when(start > 0, "… ").otherwise(""), F.when(start + n < F.size(fields), " …").otherwise("")
    return F.concat(left, F.array_join(shown, " "), right)


# ---------------------------------------------------------------- symbols


def bare_symbol(name: Column) -> Column:
    """Trimmed, without one pair of trailing parentheses."""
    return F.regexp_replace(F.trim(name), r"\(\)$", "")


def symbol_norm(name: Column) -> Column:
    return F.lower(F.regexp_replace(bare_symbol(name), r"\s+", ""))


def _qualifier(name: Column) -> tuple[Column, Column]:
    n = bare_symbol(name)
    cases = [(F.locate, "::"), (F.locate, "."), (F.locate, "#")]
    last = space = None
    for _, sep in reversed(cases):
        has = F.contains(n, F.lit(sep))
        tail = F.substring_index(n, sep, -1)
        head = F.left(n, F.char_length(n) - F.char_length(tail) - len(sep))
        last = F.when(has, tail).otherwise(n if last is None else last)
        space = F.when(has, head).otherwise(F.lit("") if space is None else space)
    return last, space


def unqualified(name: Column) -> Column:
    """What follows the last `::`, or else the last `.`, or else the last `#`."""
    return _qualifier(name)[0]


def namespace(name: Column) -> Column:
    return _qualifier(name)[1]


def looks_like_symbol(token: Column) -> Column:
    """Whether a query token reads as a code symbol."""
    upper, lower = token.rlike("[A-Z]"), token.rlike("[a-z]")
    return (token != "") & (token.rlike(r"[:.#()/<>]") | (upper & lower) | F.contains(token, F.lit("_")) | (upper & (F.octet_length(token) > 2)))


# ---------------------------------------------------------------- paths and names


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]", "")


def slug(text: Column, n: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(n))


def uri_scheme(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^([a-z]+)://", 1)


def uri_root(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[a-z]+://([^/]*)", 1)


def uri_path(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[a-z]+://[^/]*/(.*)$", 1)


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~path.rlike(r"^[/\\]") & ~F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s == "..")


#: Product words in a root's name, in the order that decides, and role endings.
FAMILIES = "network plugin device embedded database sqlite control mcp logging config concurrency http cache protocol noise".split()
ROLE_ENDINGS = "-sdk -app -service -docs -server -tool -reference -project -lib".split()


def root_family(root: Column) -> Column:
    r = F.regexp_replace(F.regexp_replace(F.lower(F.trim(root)), "^example-", ""), "^demo-", "")
    out = F.concat(F.lit("other:"), r)
    for end in reversed(ROLE_ENDINGS):
        out = F.when(r.endswith(end), F.left(r, F.char_length(r) - len(end))).otherwise(out)
    for word in reversed(FAMILIES):
        out = F.when(F.contains(r, F.lit(word)), F.lit("database" if word == "sqlite" else word)).otherwise(out)
    return out


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else: how LIKE compares."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_fold(text: Column, part: Column) -> Column:
    return F.contains(fold_ascii(text), fold_ascii(part))
