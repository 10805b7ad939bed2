"""Main text of web pages by the maximum-scoring subsequence.

A page becomes one sequence of events: words and tags.  Words score positive,
tags negative, with weights learnt from labelled pages; one linear scan finds
the contiguous region with the best sum, and its blocks are the main text.
Subtrees that never hold content (menus, footers, asides, scripts, comments,
adverts, hidden parts: by element, role or whole class or id token) are cut out
and count as one tag.  Others that are named like furniture (forms, headers,
dialogs, and elements with an everyday word such as sidebar or search in class
or id) may be wrappers of the page: they are cut only when read to their end,
and stay if they hold at least half of the page's declared words or, on pages
that declare nothing, two paragraphs and four times the words outside of every
such element.  Within declared content a class or id counts only as a whole
token of an unambiguous list, and ids only on plain containers.

Weights are log odds of an event kind inside and outside the content of
labelled pages, and of a tag's position, drawn towards default weights that
count as ``PRIOR`` events each.  A declaration labels a page for
learning; the region is found by the scan on every page.  Labelled are pages that declare their content (one ``article``,
``main``, ``role=main`` or ``itemprop=articleBody`` element); at most
``max_pages`` of them, those with the smallest hash of their id, are read (the
documented sample).  The kinds are a fixed list, so the table of weights is small.

Defined cases: null or empty html gives an empty text; unclosed and stray tags,
cut tags, unterminated comments and scripts are read as a browser would, to the
end of the page; without labelled pages, default weights hold; white space is what ``str.split``
calls so, no-break spaces included; the work is linear in the page at any depth of
nesting; pages repeated
or sharing an id are read one by one; an empty table gives an empty table;
extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 2_000
LEAST_TAG = -0.01
PRIOR = 50  # events that a default weight counts as

#: element lists of the HTML standard and usual names of page furniture (fixed values)
RAW = {"script", "style", "noscript", "iframe", "template", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE = {"nav", "footer", "aside", "menu", "button", "select", "svg", "canvas", "audio", "video", "datalist", "map"}
MAYBE = {"header", "form", "dialog", "search"}
ROLES = {"navigation", "menu", "menubar", "toolbar", "tablist"}
MAYBE_ROLES = {"banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "status", "note"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
         "promotion", "banner", "sidebar", "sidebars", "rail", "menu", "nav", "navbar", "navigation", "breadcrumb",
         "breadcrumbs", "header", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
         "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "social", "share",
         "sharing", "related", "recommended", "recommendations", "trending", "comment", "comments", "commentlist",
         "disqus", "reply", "replies", "respond", "discussion", "widget", "widgets", "toolbar", "pagination", "pager",
         "skip", "search", "form", "copyright", "legal", "disclaimer", "alert", "toast", "hidden", "tags", "taglist",
         "teaser", "outbrain", "taboola"}
#: within declared content: roles that are also used for content, and the whole
#: class or id tokens that are furniture whatever the text is about (other names
#: there are left to the scores)
CONTENT_ROLES = {"alert", "status", "note"}
SURE = {"sidebar", "sidebars", "sidebar-left", "sidebar-right", "left-sidebar", "right-sidebar", "masthead", "popup", "pager"}
#: whole tokens that are furniture anywhere, whatever is inside
ALWAYS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper",
          "sponsored-links", "navbar", "nav-menu", "main-menu", "main-navigation", "post-navigation", "breadcrumb", "breadcrumbs",
          "site-footer", "cookie-notice", "cookie-banner", "cookie-bar", "cookie-consent", "gdpr-notice", "newsletter-signup",
          "newsletter-form", "subscribe-form", "signup-form", "login-form", "search-form", "comment-form", "social-share",
          "social-links", "share-buttons", "share-bar", "sharedaddy", "related-posts", "related-articles", "recommended-posts",
          "comments", "comments-area", "comment-list", "commentlist", "comment-respond", "disqus", "disqus-thread", "widget-area",
          "pagination", "skip-link", "outbrain", "taboola"}
#: elements whose id names them as a part of the page; ids of others (headings,
#: sections, ...) are slugs of their titles
NAMED_BY_ID = {"div", "ul", "ol"}
TOP = {"html", "body", "article", "main"}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body", "head"}
KINDS = BLOCK | VOID | FURNITURE | MAYBE | {"a", "abbr", "b", "cite", "code", "em", "font", "i", "q", "s", "small", "span", "strong",
                                    "sub", "sup", "time", "u"}

_TAG = re.compile(r"<(?:!--(?P<c>.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
                  r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<loose>/?[a-zA-Z][^>]*(?:>|\Z)))", re.S)
_ATTR = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[^a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_STATE = re.compile(r"\b(?:has|with|without|no)[-_][a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attrs(text: str) -> dict[str, str]:
    return {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(text)}


def _furniture(name: str, attrs: str, within: bool) -> int:
    """2: the element's subtree holds no content; 1: nor does it unless the element
    wraps the content of the page; ``within``: inside the article."""
    if name in TOP:
        return 0
    if name in FURNITURE:
        return 2
    maybe = int(name in MAYBE and not (name == "header" and within))
    if not attrs.strip():
        return maybe
    low = " " + attrs.lower()
    if re.search(r"\s(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", low) or _HIDDEN.search(low):
        return 2
    a = _attrs(attrs)
    role = a.get("role", "").lower()
    if role in ROLES:
        return 2
    if role in MAYBE_ROLES and not (within and role in CONTENT_ROLES):
        maybe = 1
    said = a.get("class", "") + (" " + a.get("id", "") if name in NAMED_BY_ID or not within else "")
    tokens = re.sub(r"([a-z])([A-Z])", r"\1-\2", said).lower().replace("_", "-").split()
    if not ALWAYS.isdisjoint(tokens):
        return 2
    if within:
        return maybe or int(not SURE.isdisjoint(tokens))
    parts = _PARTS.split(_STATE.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()))
    return maybe or int(not NAMES.isdisjoint(parts))


def _declares(name: str, attrs: str) -> bool:
    if name in ("article", "main"):
        return True
    a = _attrs(attrs) if attrs else {}
    return a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody"


#: elements that end an open one of the same name unless a list or table lies between
SIBLINGS = ("li", "tr", "td", "th", "dt", "dd", "option")
HOLDERS = ("ul", "ol", "table", "tr", "dl", "select")
WALLS = ("button", "td", "th", "table", "object")


class Page:
    """The event sequence: ``kinds`` (feature names), ``words`` (0 for a tag),
    ``texts`` (of word events), ``block`` (running block number), ``inside``
    (depth of declared content: 0, 1, or 2 for any more)."""

    __slots__ = ("kinds", "words", "texts", "block", "inside", "declared")

    def __init__(self, source: str):
        self.kinds, self.words, self.texts, self.block, self.inside = [], [], [], [], []
        stack: list[tuple[str, bool, int, int]] = []  # element, cut from here on, depth of content, its place in maybe
        open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by element
        maybe: list[list[int]] = []  # first event, end, depth of content around it, enclosing place in maybe
        starts: list[int] = []  # first events of declared content
        inner = -1  # place in maybe of the innermost open one
        cut, content, block, pos, n = False, 0, 0, 0, len(source)

        def emit(kind, words, text):
            self.kinds.append(kind)
            self.words.append(words)
            self.texts.append(text)
            self.block.append(block)
            self.inside.append(0 if cut else min(2, content))

        def push(name, gone, depth, at):
            open_at[name].append(len(stack))
            stack.append((name, gone, depth, at))

        def pop():
            nonlocal cut, content, inner
            name, _, _, at = stack.pop()
            open_at[name].pop()
            if at >= 0:
                maybe[at][1] = len(self.kinds)
                inner = maybe[at][3]
            cut, content = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

        def last(names):
            return max((open_at[x][-1] for x in names if open_at[x]), default=-1)

        def said(raw):
            if raw and not cut:
                words = len(raw.split())
                if words or raw:
                    top = stack[-1][0] if stack else ""
                    emit("w:a" if any(s[0] == "a" for s in stack[-3:]) else
                         "w:" + (top if top in ("li", "td", "th", "dt", "dd", "option", "head") else "text"), words, raw)

        while pos < n:
            m = _TAG.search(source, pos)
            if m is None:
                said(source[pos:])
                break
            said(source[pos:m.start()])
            pos = m.end()
            name = m["name"]
            if name is None:
                if m["loose"]:  # quotes that never close: read the tag up to its bracket
                    name = re.match(r"/?([a-zA-Z][^\s/>]*)", m["loose"])[1]
                    end, attrs = m["loose"].startswith("/"), ""
                else:
                    continue
            else:
                end, attrs = bool(m["end"]), m["attrs"]
            name = name.lower()
            if not end and name in RAW:
                close = _RAW_END[name].search(source, pos)
                pos = close.end() if close else n
                if not cut:
                    emit("t:cut", 0, None)
                continue
            if name in BLOCK:
                block += 1
            if end:
                if not cut:
                    emit("t:" + (name if name in KINDS else "other"), 0, None)
                if open_at[name]:
                    for _ in range(len(stack) - open_at[name][-1]):
                        pop()
                continue
            # implied ends
            if name in CLOSES_P and open_at["p"] and last(WALLS) < open_at["p"][-1]:
                for _ in range(len(stack) - open_at["p"][-1]):
                    pop()
            if name in SIBLINGS and open_at[name] and open_at[name][-1] == last((name, *HOLDERS)):
                for _ in range(len(stack) - open_at[name][-1]):
                    pop()
            if not cut:
                emit("t:" + (name if name in KINDS else "other"), 0, None)
            if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCK and name != "a":
                continue
            depth, gone, at = content, cut, -1
            if not cut:
                depth += _declares(name, attrs)
                known = _furniture(name, attrs, depth > 0)
                gone = known == 2
                if depth and not content and not gone:
                    starts.append(len(self.kinds) - 1)
                if known == 2:  # a cut subtree is one event
                    self.kinds[-1] = "t:cut"
                elif known:
                    at = len(maybe)
                    maybe.append([len(self.kinds) - 1, 0, content, inner])
                    inner = at
            push(name, gone, depth, at)
            cut, content = gone, depth
        while stack:
            pop()
        gaps = self._gaps(maybe)
        before = [bisect_left(gaps, (x + 1,)) - 1 for x in starts]
        self.declared = sum(i < 0 or x >= gaps[i][1] for x, i in zip(starts, before))
        self._cut(gaps)

    def _gaps(self, maybe) -> list[tuple[int, int]]:
        """Events of the elements named like furniture that do not wrap the content."""
        if not maybe:
            return []
        said = [0, *accumulate(self.words)]
        declared = [[0, *accumulate(w if d > at else 0 for w, d in zip(self.words, self.inside))] for at in (0, 1)]
        paragraphs = [0, *accumulate(k == "t:p" for k in self.kinds)]
        children = defaultdict(list)
        for at, m in enumerate(maybe):
            children[m[3]].append(at)
        gaps, todo = [], [(-1, 0, len(self.kinds))]
        while todo:
            around, lo, hi = todo.pop()
            words = {at: said[maybe[at][1]] - said[maybe[at][0]] for at in children[around]}
            free = said[hi] - said[lo] - sum(words.values())
            most = max(words.values(), default=0)
            for at, w in words.items():
                first, end, depth, _ = maybe[at]
                if declared[0][-1]:
                    own = declared[depth][end] - declared[depth][first] if depth < 2 else 0
                    wraps = 2 * own >= declared[0][-1]
                else:
                    wraps = w == most and 4 * free <= w and paragraphs[end] - paragraphs[first] > 1
                if wraps:
                    todo.append((at, first, end))
                else:
                    gaps.append((first, end))
        return sorted(gaps)

    def _cut(self, gaps) -> None:
        """Each gap becomes one event."""
        if not gaps:
            return
        rows = list(zip(self.kinds, self.words, self.texts, self.block, self.inside))
        kept, pos = [], 0
        for lo, hi in gaps:
            kept += rows[pos:lo]
            kept.append(("t:cut", 0, None, *rows[lo][3:]))
            pos = hi
        kept += rows[pos:]
        self.kinds, self.words, self.texts, self.block, self.inside = map(list, zip(*kept))

    def scores(self, weights: dict[str, float]) -> list[float]:
        """Per event, by the same weights on every page; tags within declared content
        cost less by the learnt weight of that position, words score alike anywhere."""
        near = weights["at:inside"]
        out = []
        for kind, words, inside in zip(self.kinds, self.words, self.inside):
            if kind[0] == "w":
                out.append(words * weights.get(kind, weights["w:text"]))
            else:
                w = weights.get(kind, weights["t:other"])
                out.append(min(LEAST_TAG, w + near) if inside else w)
        return out

    def main_text(self, weights: dict[str, float]) -> str:
        best, best_at, total, start = 0.0, None, 0.0, 0
        for i, s in enumerate(self.scores(weights)):
            if total <= 0:
                total, start = 0.0, i
            total += s
            if total > best:
                best, best_at = total, (start, i)
        if best_at is None:
            return ""
        first, last = self.block[best_at[0]], self.block[best_at[1]]
        blocks: dict[int, list[str]] = defaultdict(list)
        for kind, text, block in zip(self.kinds, self.texts, self.block):
            if first <= block <= last:
                if text is not None:
                    blocks[block].append(text)
                elif kind == "t:br":
                    blocks[block].append(" ")
        done = (" ".join(_html.unescape("".join(x)).split()) for x in blocks.values())
        return "\n".join(x for x in done if x)


#: weights before any labelled page was seen: words for, tags against (``w:outside``
#: enters no score; readers of the table find it)
DEFAULTS = {"w:text": 1.0, "w:a": 0.1, "w:li": 0.3, "w:td": 0.3, "w:th": 0.1, "w:head": 0.1, "w:outside": -2.0,
            "at:inside": 0.5, "t:other": -0.5, "t:cut": -0.5, "t:p": -0.05, "t:br": -0.05, "t:a": -1.0, "t:li": -1.0,
            "t:div": -2.0, "t:ul": -1.0, "t:td": -0.5, "t:tr": -0.5, "t:body": -3.0, "t:head": -3.0, "t:footer": -3.0,
            "t:nav": -3.0, "t:b": -0.05, "t:i": -0.05, "t:em": -0.05, "t:strong": -0.05, "t:span": -0.1, "t:code": -0.05,
            "t:h1": -0.1, "t:h2": -0.1, "t:h3": -0.1, "t:blockquote": -0.1, "t:article": -0.1, "t:section": -0.3, "t:main": -0.1}


def _drawn(learnt: float, events: int, default: float) -> float:
    """``learnt`` from ``events``, drawn towards the default that counts as ``PRIOR`` events."""
    return (events * learnt + PRIOR * default) / (events + PRIOR)


def _tally(batches):
    for b in batches:
        sums = defaultdict(lambda: [0, 0])
        pages = 0
        for source in b.column(0):
            page = Page(source.as_py() or "")
            if page.declared != 1:
                continue
            pages += 1
            for kind, words, inside in zip(page.kinds, page.words, page.inside):
                at = 0 if inside else 1
                sums[kind][at] += max(1, words) if kind[0] == "w" else 1
        sums["pages"][0] += pages
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()], pa.int64()),
                                          pa.array([v[1] for v in sums.values()], pa.int64())], names=["kind", "inside", "outside"])


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES) -> dict[str, float]:
    """Weights from at most ``max_pages`` labelled pages (ids are picked first, so
    only their html is read); one row per event kind reaches the driver."""
    declared = F.lower(html_col).rlike("<(article|main)[ >]|role=.?main|itemprop=.?articlebody")
    ids = (pages.where(declared & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
           .orderBy(F.xxhash64("__id"), "__id").limit(max_pages))
    picked = pages.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).select(F.col(html_col).alias("html"))
    rows = (picked.mapInArrow(_tally, "kind string, inside long, outside long").groupBy("kind")
            .agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect())
    count = {r["kind"]: (r["i"], r["o"]) for r in rows}
    if not count.pop("pages", (0, 0))[0]:
        return dict(DEFAULTS)
    weights = dict(DEFAULTS)
    for sort in "wt":
        own = {k: v for k, v in count.items() if k[0] == sort}
        i, o = sum(v[0] for v in own.values()) + 1, sum(v[1] for v in own.values()) + 1
        if sort == "t":  # how much likelier a tag lies in the content than not
            weights["at:inside"] = _drawn(min(1.0, max(0.0, math.log(i / o))), i + o, DEFAULTS["at:inside"])
        for k, (a, b) in own.items():
            odds = math.log((a + 0.5) / i) - math.log((b + 0.5) / o)
            if sort == "w":  # words speak for content
                odds = min(3.0, max(0.05, odds))
            else:  # tags speak against it; a cut subtree alone does not end a region
                odds = max(-1.0 if k == "t:cut" else -5.0, min(-0.02, odds))
            weights[k] = _drawn(odds, a + b, DEFAULTS.get(k, DEFAULTS["w:text" if sort == "w" else "t:other"]))
    return weights


def extract(pages: DataFrame, weights: dict[str, float] | None = None, html_col: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` per page, in one narrow pass."""
    w = dict(DEFAULTS) if weights is None else weights
    at = len(keep)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [Page(t.as_py() or "").main_text(w) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=[*part.schema.names[:at], "text", "n_chars"])
    d = pages.select(*keep, html_col)
    return d.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in d.dtypes[:at]) + ", text string, n_chars long")
