"""Web pages as column expressions: titles, links, relative paths, address policy, versions, plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings and folders that a crawl passes over.
SKIPPED_ENDINGS = "css js png jpg jpeg gif svg ico woff woff2 ttf map pdf zip php".split()
SKIPPED_PARTS = r"/_static/|/_images/|(^|/)doxygen_crawl\.html$|(^|/)search_[^/]*$"
HREF = r"""(?i)href\s*=\s*["']([^"'#][^"']*)["']"""
PRIVATE_V4 = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^(22[4-9]|23[0-9])\."
BLOCKED_HOSTS = r"^(localhost|localhost\.localdomain|metadata|metadata\.google\.internal)$|\.(local|internal|localhost)$"


def title(html: Column) -> Column:
    """The title element's text with white space made single."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def hrefs(html: Column) -> Column:
    """Link targets as they are written, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda x: F.trim(x))


def hostname_like(s: Column) -> Column:
    return ~s.rlike(r"[/\\?#]") & ~s.rlike(r"\.html?$") & s.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")


def skipped_href(ref: Column) -> Column:
    r = F.lower(F.trim(ref))
    bare = ~F.contains(r, F.lit("://")) & ~r.rlike(r"^(/|\./|\.\./)") & hostname_like(r)
    return (r == "") | r.rlike(r"^(#|javascript:|mailto:|tel:)") | bare


def resolved(base: Column, ref: Column) -> Column:
    """The absolute address of a link: without query, fragment and dot segments."""
    clean = F.regexp_replace(F.trim(ref), r"[?#].*$", "")
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+)(/.*/|/)?[^/]*$", "$1$2")
    folder = F.when(folder.rlike(r"^https?://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    joined = (
        F.when(clean.rlike(r"^https?://"), clean)
        .when(clean.rlike(r"^//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), clean))
        .when(clean.rlike("^/"), F.concat(origin, clean))
        .otherwise(F.concat(folder, clean))
    )
    segments = F.split(F.regexp_replace(joined, r"^https?://[^/]+/?", ""), "/")
    walk = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.regexp_extract(joined, r"^(https?://[^/]+)", 1), F.lit("/"), F.array_join(walk, "/"))


def skipped_path(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(rf"\.({'|'.join(SKIPPED_ENDINGS)})$") | p.rlike(SKIPPED_PARTS) | hostname_like(F.element_at(F.split(p, "/"), -1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def relative_path(url: Column) -> Column:
    """The path below the host; index.html for a folder."""
    p = F.regexp_replace(url_path(url), "^/", "")
    return F.when((p == "") | p.endswith("/"), F.concat(p, F.lit("index.html"))).otherwise(p)


def blocked_host(h: Column) -> Column:
    return (h == "") | h.rlike(BLOCKED_HOSTS) | (h.rlike(r"^\d+\.\d+\.\d+\.\d+$") & h.rlike(PRIVATE_V4))


def allowed_url(url: Column, prefixes: list[str]) -> Column:
    """http or https, no private or blocked host, and below one of the prefixes (any, if there are none)."""
    below = F.lit(not prefixes)
    for p in prefixes:
        below = below | F.startswith(url, F.lit(p))
    return url.rlike("^https?://") & ~blocked_host(host(url)) & below


def semver(token: Column) -> Column:
    return token.rlike(r"^\d+\.\d+(\.\d+)?$")


def version_in(text: Column) -> Column:
    """The last of the final three words that reads as a version."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    bare = F.transform(F.slice(F.reverse(words), 1, 3), lambda w: F.regexp_replace(F.lower(F.btrim(w, F.lit("():,"))), "^v", ""))
    return F.coalesce(F.get(F.filter(bare, semver), F.lit(0)), F.lit(""))


def plain_text(html: Column) -> Column:
    """A page's text: chrome, scripts and tags dropped, the common entities read, white space made single."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def markdown(html: Column) -> Column:
    """Headings, list items, code and paragraphs of a page as Markdown lines; other tags dropped."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript|title)\b[^>]*>.*?</\1>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "**$1**")
    out = F.regexp_replace(out, r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", "*$1*")
    out = F.regexp_replace(out, r"(?is)<code>(.*?)</code>", "`$1`")
    out = F.regexp_replace(out, r"""(?is)<a\b[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</p>|<br\s*/?>|</div>|</tr>", "\n\n"), r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n"))


# ---------------------------------------------------------------- profiles of generated sites

#: Pages that hold no text of a site made by either generator.
SPHINX_CHROME = ("search.html", "genindex.html", "py-modindex.html", "_sources/", "searchindex.js", "_static/")
DOXYGEN_STARTS = ("namespacemembers", "functions_", "globals_", "annotated", "search_")
DOXYGEN_PAGES = ("classes.html", "files.html", "namespaces.html", "doxygen_crawl.html", "search.html", "dir_*.html", "jquery.js")


def sphinx_chrome(path: Column) -> Column:
    """Whether a path of a Sphinx site is of its search, indexes or files."""
    out = F.lit(False)
    for part in SPHINX_CHROME:
        out = out | F.contains(F.lower(path), F.lit(part))
    return out


def doxygen_chrome(path: Column) -> Column:
    """Whether a path of a Doxygen site is of its lists and search."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    out = base.isin(*DOXYGEN_PAGES) | base.endswith(".php") | F.contains(low, F.lit("/search/"))
    for start in DOXYGEN_STARTS:
        out = out | F.startswith(base, F.lit(start))
    return out


def content_kind(path: Column, content_type: Column) -> Column:
    """html, markdown or text: by the ending of a path, and else by the type that came with it."""
    p, t = F.lower(path), F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(p.rlike(r"\.(html?|xhtml)$"), "html").when(p.rlike(r"\.(md|markdown|mdx)$"), "markdown").when(p.rlike(r"\.(txt|rst|text)$"), "text").when(t.rlike("html"), "html").when(t.rlike("markdown"), "markdown").otherwise("text")
