"""The main element of pages, against a plain walk over the tags."""

import random
import re

from tessera.operators import site


def brute(html, profile):
    if html is None:
        return None
    if profile not in ("sphinx", "doxygen"):
        return html
    bare = re.sub(r"(?s)<!--.*?-->", "", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html))
    tags = [(m.start(), m.group(0), m.group(1).lower()) for m in re.finditer(r"<(/?[A-Za-z][A-Za-z0-9]*)[^<>]*>?", bare)]
    found = []
    for k, (at, tag, name) in enumerate(tags):
        if name not in site.FOLLOWED or tag.rstrip(">").endswith("/"):
            continue
        get = lambda a: (re.search(rf"""(?i)\s{a}\s*=\s*["']([^"']*)""", tag) or ["", ""])[1].lower()
        if profile == "sphinx":
            rules = [name == "div" and get("role") == "main", name == "div" and "document" in get("class"), get("id") in ("content", "main-content") or get("class") == "body", name in ("article", "main")]
        else:
            rules = [name == "div" and "contents" in get("class")]
        if not any(rules):
            continue
        depth, end = 1, len(bare)
        for at2, tag2, name2 in tags[k + 1 :]:
            depth += (name2 == name and not tag2.rstrip(">").endswith("/")) - (name2 == "/" + name)
            if depth == 0:
                end = at2
                break
        inside = bare[at + len(tag) : end]
        if len(inside) > site.TOO_SHORT:
            found.append((rules.index(True), at, inside))
    return min(found)[2] if found else html


LONG = "Words that are the page's own text, and more than forty characters of it. "
PAGES = [
    f'<body><nav>n</nav><div class="document"><div role="main"><div>a</div>{LONG}<div><div>deep</div></div>end</div>after</div><footer>f</footer></body>',
    f'<div class="header"><div>x</div></div><div class="contents"><div class="inner">{LONG}</div>tail</div><hr class="footer"/>',
    f"<main><section>{LONG}</section></main>more",
    f'<div role="main">short</div><div class="document">{LONG}</div>',
    f'<!-- <div role="main"> --><script>var a = "<div>";</script><DIV ROLE="main">{LONG}<div/>x</DIV>y',
    f'<div role="main">{LONG} never closed <div>inner</div>',
    f'</div></div><article>{LONG}</article></article>',
    f'<div id="content">{LONG}</div>', "<p>no element</p>", "", None, "a < b and c > d",
]


def test_main_elements_equal_a_walk_over_the_tags(spark):
    rng = random.Random(7)
    pages = list(PAGES)
    parts = ["<div>", "</div>", '<div class="contents x">', '<div role="main">', "</article>", "<article>", "<main id='content'>", "</main>", "<br/>", "<p>", "text " * 5, LONG, "<section/>"]
    pages += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    rows = [(3 * k + i, h, p) for k, h in enumerate(pages) for i, p in enumerate(("sphinx", "doxygen", "other"))]
    got = {r.k: r.main for r in site.main_elements(spark.createDataFrame(rows, "k long, html string, profile string"), "k").collect()}
    assert len(got) == len(rows)
    for k, h, p in rows:
        assert got[k] == brute(h, p), (h, p)
