"""Main text of hand-made pages with known content."""

import re

from pyspark.sql import functions as F

from semcode.llm import html_extract as H
from tests.conftest import SF_SMALL

P1, P2 = "The first paragraph has a fair number of words in it.", "Short one &amp; done."
FURNITURE = [
    '<nav><a href="/">Home</a> <a href="/b">About us</a></nav>', '<div class="ad">Buy now, a very good offer for you today.</div>',
    '<div id="cookie-notice">We use cookies to make this page better for everyone who reads it.</div>',
    '<aside>Related stories that nobody reads and more words here</aside>', '<form><label>Mail</label><input><button>Send</button></form>',
    '<script>var t="</p><p>not text</p>";</script>', "<style>p{margin:0}</style>", "<!-- a comment <p>with markup</p> -->",
    '<section class="comments"><p>First! What a great article, I liked it very much indeed.</p></section>',
    '<div class="sidebar-left"><ul><li><a href="/x">Link one</a><li><a href="/y">Link two</a></ul></div>', "<footer>&copy; 2020 Example</footer>",
    '<div style="display: none">hidden words</div>', '<div role="navigation">Skip to content</div>', "<noscript>Please turn on scripts</noscript>",
]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; U</title></head><body>{body}</body></html>"


def text(source, weights=H.DEFAULTS):
    return H.Page(source).main_text(weights)


def test_furniture_goes_inside_and_outside_the_article():
    want = "Head line\nThe first paragraph has a fair number of words in it.\nShort one & done."
    for f in FURNITURE:
        inner = f"<h1>Head <i>line</i></h1><p>{P1}\n{f}<p>{P2}"
        for body in (f"{f}<article><h1>Head line</h1><p>{P1}</p><p>{P2}</p></article>{f}", f"<article>{inner}</article>",
                     f"{f}<main><h1>Head\n\tline</h1><p>{P1}<p>{P2}</main>{f}", f"{f}<h1>Head line</h1><p>{P1}</p><p>{P2}</p>{f}"):
            assert text(page(body)) == want, body


def test_names_that_are_titles_keep_their_text_inside_the_article():
    named = ["<section id='discussion'>{}</section>", "<section id='related-work'>{}</section>", "<section id='comments'>{}</section>",
             "<h2 id='search-results'>{}</h2>", "<h2 id='navigation'>{}</h2>", "<div id='legal-basis'>{}</div>",
             "<div class='search-theory'>{}</div>", "<p class='form-of-government'>{}</p>", "<div class='alert' role='note'>{}</div>",
             "<math><mi>{}</mi></math>", "<p><label>{}</label></p>", "<fieldset>{}</fieldset>", "<object data='x'>{}</object>"]
    for tag in ("article", "main"):
        for n in named:
            part = n.format("These words belong to it")
            got = text(page(f"<{tag}><h1>Head line</h1><p>{P1}</p>{part}<p>{P2}</p></{tag}>"))
            assert "These words belong to it" in got and got.endswith("Short one & done."), (n, got)
        assert "Mail" not in text(page(f"<{tag}><p>{P1}</p><form><label>Mail</label></form><p>{P2}</p></{tag}>"))


def test_scores_decide_on_pages_that_declare_content():
    long = "".join(f"<p>{P1}</p>" for _ in range(20))
    want = "\n".join([P1] * 20)
    lead = f"<h1>Head line</h1><p>{P1}</p>"
    assert text(page(f"<article><p>Short teaser</p></article><div>{'<div>' * 8}{long}{'</div>' * 8}</div>")) == want
    assert text(page(f"{lead}<article>{long}</article>")) == f"Head line\n{P1}\n{want}"
    items = "<ul>" + f"<li>{P1}</li>" * 3 + "</ul>"
    assert text(page(f"<article>{long}{items}</article>")) == "\n".join([P1] * 23)


WRAPPERS = ["<form id=aspnetForm action='/p'>{}</form>", '<div class="layout sidebar-right">{}</div>', '<div class="site header-fixed">{}</div>',
            '<div class="search-page">{}</div>', '<div role="dialog">{}</div>', "<header>{}</header>", "<form><div class='nav-site'>{}</div></form>"]


def test_wrappers_named_like_furniture_keep_the_article():
    paragraphs = "".join(f"<p>{P1} Part {i}</p>" for i in range(6))
    want = "\n".join(f"{P1} Part {i}" for i in range(6))
    around = "".join(FURNITURE) + "<div class='related-posts'><article><p>Another story, told in short.</p></article></div>"
    for w in WRAPPERS:
        for main in ("<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<main><div class='sidebar-right'><article>{}</article></div></main>"):
            assert text(page(w.format(around + main.format(paragraphs) + around))) == want, (w, main)
        assert text(page(w.format(around + paragraphs + around))) == want, w
        replies = "<ol class='comment-list'><li><article class='comment'><p>" + "A long reply of many words. " * 60 + "</p></article></ol>"
        assert text(page(w.format(f"<article>{paragraphs}</article>{replies}"))) == want, w
    assert text(page(f"<article><p>{P1}</p><div class='widget'><p>{P1}</p></div></article>")) == f"{P1}\n{P1}"
    assert text(page(f"<article><p>{P1}</p><form><p>Your mail</p><p>Your name</p></form></article>")) == P1


def test_work_is_linear_in_depth():
    import time
    start = time.time()
    for name in ("div", "p><table", "li", "form", "div class=sidebar", "article", "b"):
        n = 100_000
        got = text(f"<{name}>" * n + "deep words")
        assert got == "deep words" or name in ("form", "div class=sidebar", "article"), name
    assert time.time() - start < 60


def test_scan_and_weights_against_plain_versions(spark):
    import math
    import random
    from collections import Counter
    rng = random.Random(5)
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(12).collect()
    weights = H.fit_weights(spark.createDataFrame([(r.page_id, r.html) for r in rows], "page_id long, html string"))
    inside, outside = Counter(), Counter()
    for r in rows:
        p = H.Page(r.html)
        assert p.declared == 1
        for kind, words, at in zip(p.kinds, p.words, p.inside):
            (inside if at else outside)[kind] += max(1, words) if kind[0] == "w" else 1
    for kind in {*inside, *outside}:
        same = [k for k in {*inside, *outside} if k[0] == kind[0]]
        i, o = (1 + sum(c[k] for k in same) for c in (inside, outside))
        odds = math.log((inside[kind] + 0.5) / i) - math.log((outside[kind] + 0.5) / o)
        low, high = (0.05, 3.0) if kind[0] == "w" else (-1.0 if kind == "t:cut" else -5.0, -0.02)
        n, prior = inside[kind] + outside[kind], H.DEFAULTS.get(kind, H.DEFAULTS["w:text" if kind[0] == "w" else "t:other"])
        assert abs(weights[kind] - (n * min(high, max(low, odds)) + H.PRIOR * prior) / (n + H.PRIOR)) < 1e-12
    for _ in range(200):  # the region: best sum over all pairs of ends
        body = "".join(rng.choice([f"<p>{rng.randrange(999)} w", "</p>", "<div>", "</div>", "<a href=x>l m</a>", "<ul><li>i", "</ul>", "<br>", "t u v"])
                       for _ in range(rng.randrange(30)))
        p = H.Page(body)
        s = p.scores(H.DEFAULTS)
        sums = {(a, b): sum(s[a:b + 1]) for a in range(len(s)) for b in range(a, len(s))}
        best = max(sums.values(), default=0)
        got = p.main_text(H.DEFAULTS)
        if best <= 0:
            assert got == ""
            continue
        texts = set()
        for (a, b), v in sums.items():
            if v > best - 1e-9:
                parts = {}
                for kind, t, k in zip(p.kinds, p.texts, p.block):
                    if p.block[a] <= k <= p.block[b]:
                        parts[k] = parts.get(k, "") + (t or (" " if kind == "t:br" else ""))
                texts.add("\n".join(x for x in (" ".join(v.split()) for v in parts.values()) if x))
        assert got in texts


def test_blocks_references_and_broken_markup():
    assert text(page("<article><p>a<b>b</b> c<br>d</p><ul><li>x<li>y</ul>&lt;z&gt; &eacute;&#233;&#xe9; &nope;</article>")) == \
        "ab c d\nx\ny\n<z> ééé &nope;"
    assert text("<article><p>open <b>bold<br><p>next") == "open bold\nnext"
    assert text("<article><p>cut tag <a href=\"x") == "cut tag"
    assert text("<article><p>one</p><script>never closed <p>two") == "one"
    assert text("<article><p>one</p><!-- never closed <p>two") == "one"
    assert text("<article><p>5 < 6 and 7 > 3 <p>a <3 b</article>") == "5 < 6 and 7 > 3\na <3 b"
    assert text("<article><p title='x > y' class=\"a'b\">one</p></article>") == "one"
    assert text("") == text("<p></p>") == text("<nav>menu</nav>") == ""
    assert text("plain words only") == "plain words only"


def test_weights_come_from_labelled_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    w = H.fit_weights(pages)
    assert w["w:text"] > 0 and all(v < 0 for k, v in w.items() if k[0] == "t") and w["w:outside"] < 0
    assert H.fit_weights(pages.limit(0)) == H.DEFAULTS


def test_query_and_cases(spark):
    from html import unescape

    from semcode.llm.queries import QUERIES
    out = {r.page_id: r for r in QUERIES["op1_html_extract"](spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert out[r.page_id].text == "\n".join(x for x in want if x) and out[r.page_id].n_chars == len(out[r.page_id].text)
    rows = [(1, "u", None), (2, "u", ""), (3, None, page(f"<article><p>{P1}</article>")), (3, None, page(f"<article><p>{P1}</article>")),
            (None, "v", "<p>" * 20_000 + "deep"), (4, "w", page("<article>" + f"<p>{P1}</p>" * 20_000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("kind", F.lit(2))
    got = {(r.page_id, r.url, r.n_chars) for r in H.extract(df).collect()}
    assert got == {(1, "u", 0), (2, "u", 0), (3, None, len(P1)), (None, "v", 4), (4, "w", 20_000 * (len(P1) + 1) - 1)}
    assert H.extract(df.limit(0)).collect() == []
