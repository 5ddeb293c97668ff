"""Web pages: titles, links, addresses and text, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..operators import site
from ..sources import tables as T

P = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


def titles(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", web.title(F.col("html")).alias("title"), F.sha2("html", 256).alias("hash"))


def links(spark, sf):
    l = T.table(spark, sf, "pages").select("page_id", F.posexplode(web.hrefs(F.col("html"))).alias("pos", "href"))
    return l.where(~web.skipped_href(F.col("href")))


LINKS_SQL = r"""WITH l AS (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#][^"'']*)["'']', 1) AS hs FROM pages))
SELECT page_id, CAST(pos AS INT) AS pos, trim(h) AS href FROM l WHERE NOT (trim(h) = '' OR regexp_matches(lower(trim(h)), '^(#|javascript:|mailto:|tel:)')
 OR (NOT contains(h, '://') AND NOT regexp_matches(lower(trim(h)), '^(/|\./|\.\./)') AND NOT regexp_matches(lower(trim(h)), '[/\\?#]') AND NOT regexp_matches(lower(trim(h)), '\.html?$') AND regexp_matches(lower(trim(h)), '^[a-z0-9-]+(\.[a-z0-9-]+)+$')))"""


def relative(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", web.relative_path(F.col("url")).alias("path"), web.host(F.col("url")).alias("host"))


def policy(spark, sf):
    made = F.element_at(F.array(F.col("url"), F.lit("http://localhost/x"), F.lit("http://10.1.2.3/a"), F.lit("ftp://a.b/c"), F.lit("https://8.8.8.8/"), F.lit("http://172.20.0.1/"), F.lit("http://db.internal/")), (F.col("page_id") % 7 + 1).cast("int"))
    p = T.table(spark, sf, "pages").select("page_id", made.alias("u"))
    return p.select("page_id", web.allowed_url(F.col("u"), []).alias("allowed"))


def text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", web.plain_text(F.col("html")).alias("text"))


TEXT_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<header\b[^>]*>.*?</header>|<footer\b[^>]*>.*?</footer>|<aside\b[^>]*>.*?</aside>|<noscript\b[^>]*>.*?</noscript>', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b"""


_DROPPED = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "nav", "header", "footer", "aside", "noscript", "title"))
_MARKS = [(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "chr(10) || chr(10) || '" + "#" * n + " \\1' || chr(10) || chr(10)") for n in range(1, 7)] + [
    (r"(?is)<li\b[^>]*>(.*?)</li>", "chr(10) || '- \\1'"),
    (r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "'**\\1**'"),
    (r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", "'*\\1*'"),
    (r"(?is)<code>(.*?)</code>", "'`\\1`'"),
    (r"""(?is)<a\b[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>""", "'[\\2](\\1)'"),
    (r"(?i)</p>|<br\s*/?>|</div>|</tr>", "chr(10) || chr(10)"),
    (r"(?s)<[^>]*>", "''"),
]


def markdown_sql() -> str:
    out = f"regexp_replace(html, '(?is){_DROPPED}', '', 'g')"
    for pattern, by in _MARKS:
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, trim({out}, ' ' || chr(9) || chr(10)) AS markdown FROM pages"


def resolved(spark, sf):
    """The addresses that pages link to, with how many pages link there."""
    l = T.table(spark, sf, "pages").select("page_id", "url", F.explode(web.hrefs(F.col("html"))).alias("href")).where(~web.skipped_href(F.col("href")))
    u = l.select("page_id", web.resolved(F.col("url"), F.col("href")).alias("to")).where(~web.skipped_path(web.url_path(F.col("to"))))
    return u.groupBy("to").agg(F.count_distinct("page_id").alias("pages"))


_BARE = r"(NOT contains(x, '://') AND NOT regexp_matches(x, '^(/|\./|\.\./)') AND NOT regexp_matches(x, '[/\\?#]') AND NOT regexp_matches(x, '\.html?$') AND regexp_matches(x, '^[a-z0-9-]+(\.[a-z0-9-]+)+$'))"
_ENDINGS = "|".join(web.SKIPPED_ENDINGS)
RESOLVED_SQL = rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#][^"'']*)["'']', 1)) AS h FROM pages),
 k AS (SELECT page_id, url, trim(h) AS h, lower(trim(h)) AS x FROM l),
 c AS (SELECT *, regexp_replace(h, '[?#].*$', '') AS c, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+)(/.*/|/)?[^/]*$', '\1\2') AS f FROM k WHERE NOT (x = '' OR regexp_matches(x, '^(#|javascript:|mailto:|tel:)') OR {_BARE})),
 j AS (SELECT page_id, CASE WHEN regexp_matches(c, '^https?://') THEN c WHEN starts_with(c, '//') THEN regexp_extract(url, '^(https?:)', 1) || c WHEN starts_with(c, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || c
   ELSE CASE WHEN regexp_matches(f, '^https?://[^/]+$') THEN f || '/' ELSE f END || c END AS j FROM c),
 w AS (SELECT page_id, regexp_extract(j, '^(https?://[^/]+)', 1) || '/' || array_to_string(list_reduce(list_prepend([], list_transform(string_split(regexp_replace(j, '^https?://[^/]+/?', ''), '/'), lambda s: [s])),
   lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, s) END), '/') AS "to" FROM j),
 p AS (SELECT *, lower(regexp_extract("to", '^https?://[^/?#]+([^?#]*)', 1)) AS q FROM w),
 b AS (SELECT *, split_part(q, '/', -1) AS x FROM p)
SELECT "to", count(DISTINCT page_id) AS pages FROM b WHERE NOT (regexp_matches(q, '\.({_ENDINGS})$') OR regexp_matches(q, '{web.SKIPPED_PARTS}') OR (NOT regexp_matches(x, '[/\\?#]') AND NOT regexp_matches(x, '\.html?$') AND regexp_matches(x, '^[a-z0-9-]+(\.[a-z0-9-]+)+$'))) GROUP BY 1"""


def version(spark, sf):
    t = F.concat(F.lit("Guide v"), (F.col("page_id") % 4).cast("string"), F.lit("."), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit(" (stable)")).otherwise(F.lit("")))
    return T.table(spark, sf, "pages").select("page_id", web.version_in(t).alias("version"))


def main_elements(spark, sf):
    """Pages set into the frames of two generators, a third of them into none."""
    frame = lambda before, after: F.concat(F.lit(before), "html", F.lit(after))
    k = F.col("page_id") % 3
    html = F.when(k == 0, frame(*FRAMES[0])).when(k == 1, frame(*FRAMES[1])).otherwise(F.col("html"))
    profile = F.when(k == 0, "sphinx").when(k == 1, "doxygen").otherwise("sphinx")
    out = site.main_elements(T.table(spark, sf, "pages").select("page_id", html.alias("html"), profile.alias("profile")), "page_id")
    return out.select("page_id", F.sha2("main", 256).alias("main_sha256"), F.char_length("main").alias("n_chars"))


FRAMES = (
    ('<div class="top"><div>menu</div></div><div class="document"><div><div role="main"><div>', "</div></div></div><div>aside</div></div><footer>end</footer>"),
    ('<div class="header"><div>menu</div></div><div class="contents"><div class="textblock">', '</div><div>more</div></div><hr class="footer"/><div>end</div>'),
)
_CLASS, _ROLE, _ID = (rf"""lower(regexp_extract(tag, '\s{a}\s*=\s*["'']([^"'']*)', 1, 'i'))""" for a in ("class", "role", "id"))
MAIN_SQL = rf"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{FRAMES[0][0]}' || html || '{FRAMES[0][1]}' WHEN 1 THEN '{FRAMES[1][0]}' || html || '{FRAMES[1][1]}' ELSE html END AS html, CASE WHEN page_id % 3 = 1 THEN 'doxygen' ELSE 'sphinx' END AS profile FROM pages),
 b AS (SELECT *, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS bare FROM p),
 s AS (SELECT page_id, profile, string_split(bare, '<') AS l FROM b),
 x AS (SELECT page_id, profile, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM s),
 y AS (SELECT *, lower(regexp_extract(piece, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, split_part(piece, '>', 1) AS tag FROM x WHERE pos > 0),
 t AS (SELECT *, CASE WHEN piece LIKE '/%' THEN -1 WHEN tag LIKE '%/' THEN 0 ELSE 1 END AS step, {_CLASS} AS c, {_ROLE} AS r, {_ID} AS i FROM y WHERE name IN ('div', 'article', 'main', 'section')),
 d AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY pos) AS depth,
   CASE WHEN step < 1 THEN NULL WHEN profile = 'doxygen' THEN CASE WHEN name = 'div' AND contains(c, 'contents') THEN 1 END WHEN name = 'div' AND r = 'main' THEN 1 WHEN name = 'div' AND contains(c, 'document') THEN 2
     WHEN i IN ('content', 'main-content') OR c = 'body' THEN 3 WHEN name IN ('article', 'main') THEN 4 END AS best FROM t),
 e AS (SELECT o.page_id, o.pos, o.best, min(z.pos) AS close FROM d o LEFT JOIN d z ON z.page_id = o.page_id AND z.name = o.name AND z.step < 0 AND z.depth = o.depth - 1 AND z.pos > o.pos WHERE o.best IS NOT NULL GROUP BY ALL),
 f AS (SELECT e.*, substr(array_to_string(l[pos + 1:coalesce(close, len(l))], '<'), instr(array_to_string(l[pos + 1:coalesce(close, len(l))], '<'), '>') + 1) AS inside FROM e JOIN s USING (page_id)),
 g AS (SELECT page_id, arg_min(inside, best * 1000000000::BIGINT + pos) AS inside FROM f WHERE length(inside) > 40 GROUP BY page_id)
SELECT page_id, sha256(coalesce(inside, html)) AS main_sha256, CAST(length(coalesce(inside, html)) AS INT) AS n_chars FROM p LEFT JOIN g USING (page_id)"""


QUERIES = {
    "main_element": (main_elements, MAIN_SQL),
    "html_title": (titles, r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, sha256(html) AS hash FROM pages"),
    "html_links": (links, LINKS_SQL),
    "html_to_text": (text, TEXT_SQL),
    "html_to_markdown": (lambda s, d: T.table(s, d, "pages").select("page_id", web.markdown(F.col("html")).alias("markdown")), markdown_sql()),
    "url_relpath": (relative, f"SELECT page_id, CASE WHEN {P} IN ('', '/') OR ends_with({P}, '/') THEN regexp_replace({P}, '^/', '') || 'index.html' ELSE regexp_replace({P}, '^/', '') END AS path, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages"),
    "url_policy": (policy, "SELECT page_id, page_id % 7 IN (0, 4) AS allowed FROM pages"),
    "resolved_links": (resolved, RESOLVED_SQL),
    "title_version": (version, "SELECT page_id, (page_id % 4) || '.' || (page_id % 7) AS version FROM pages"),
}
