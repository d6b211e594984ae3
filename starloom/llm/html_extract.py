"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into a tree of elements. Each element has features of its tag and
attributes, those of its ancestors, of its subtree (text, links, density), of its
depth and place and of its siblings. Gradient-boosted trees give the log-odds that an
element holds main text. Decoding then picks, over the whole tree, the most probable
choice in which what lies in a dropped element is dropped too; it is a sum over
subtrees, from the leaves up.

The trees are trained on a bounded sample of the pages themselves, in which
semantic elements (article, main; nav, footer, aside, form ...) label the text, and on
the same texts laid out anew with other tags and class names and with the usual
things around an article.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from starloom.llm import trees
from starloom.llm.common import map_rows
from starloom.llm.trees import Trees

MAX_PAGES = 300         # pages to train on, those of least hashed id
LONG = 2_000            # characters from which more of them say nothing more
MAX_TRAIN_CHARS = 1 << 16  # longer pages are extracted like others but not trained on

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements by what HTML says of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template noscript iframe".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp select option optgroup small span strike strong sub sup svg time tt u var wbr".split())
# Elements of formulas and drawings are no nodes: a formula's text is its paragraph's, a drawing's text is the svg's.
PARTS = set("math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction".split())
PARTS |= set("g path circle rect line polyline polygon ellipse text tspan textpath use defs symbol desc clippath mask lineargradient radialgradient stop pattern marker filter foreignobject animate animatetransform".split())
CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
P_SCOPE = set("table td th caption button object html body".split())

# Words of class names, ids and roles by what they say about an element.
HINTS = {
    "content": "article post content main entry story text body prose copy paragraph",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toolbar tabs links toc",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted banner adsense",
    "comment": "comment comments reply replies respond discussion disqus thread reader",
    "footer": "footer foot copyright legal imprint colophon bottom",
    "header": "header masthead logo topbar top branding site head",
    "side": "sidebar side aside widget related recommended trending popular share social rail more",
    "notice": "cookie consent notice alert popup modal overlay newsletter subscribe signup login banner gdpr warning",
    "form": "form search input subscribe login contact",
    "byline": "byline author date meta tags tag category caption",
}
HINT = {}
for _kind, _words in HINTS.items():
    for _word in _words.split():
        HINT.setdefault(_word, []).append(list(HINTS).index(_kind))
TAGS = {t: k for k, t in enumerate("html body main article section div p h1 h2 h3 h4 blockquote pre ul ol li dl dt dd table tr td th figure figcaption span a b i em strong small header footer nav aside form button label fieldset details summary address dialog svg select option".split(), 1)}
GROUPS = ("article main", "nav menu", "footer", "header", "aside", "form button label fieldset dialog select option", "h1 h2 h3 h4", "p blockquote pre", "ul ol li dl dt dd", "table tr td th", "a")


class Page:
    """Elements in page order and segments, runs of text between the borders of blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.start, self.depth, self.length = ["html"], [0], [""], [0], [0], len(source)
        self.segments: list[list[tuple[int, str]]] = []
        self.stack, self.open = [0], []
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self.end(name)
                continue
            attrs = m[3] if m[2] else m[6]
            if name in RAW and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else size
                continue
            self.begin(name, attrs, at)
        self.border()

    def text(self, text: str) -> None:
        if text.strip() or self.open:
            self.open.append((self.stack[-1], text))

    def border(self) -> None:
        if self.open:
            self.segments.append(self.open)
            self.open = []

    def pop_to(self, depth: int) -> None:
        if any(self.tag[i] not in INLINE for i in self.stack[depth:]):
            self.border()
        del self.stack[depth:]

    def begin(self, name: str, attrs: str, at: int) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in PARTS:
            return
        if name in CLOSES_P or name == "li":
            # A drawing or choice without a closing tag ends where a block begins.
            for d in range(len(self.stack) - 1, 0, -1):
                t = self.tag[self.stack[d]]
                if t in ("svg", "select"):
                    self.pop_to(d)
                if t not in INLINE:
                    break
        if name == "option":
            self.text(" ")
        if name not in INLINE:
            self.border()
        if name in ("html", "body", "head"):
            if name in (self.tag[i] for i in self.stack) or name == "head":
                return
        if name in CLOSES_P:
            for d in range(len(self.stack) - 1, 0, -1):
                t = self.tag[self.stack[d]]
                if t == "p":
                    self.pop_to(d)
                    break
                if t in P_SCOPE:
                    break
        if name in SAME:
            own, scope = SAME[name]
            for d in range(len(self.stack) - 1, 0, -1):
                t = self.tag[self.stack[d]]
                if t in own.split():
                    self.pop_to(d)
                    break
                if t in scope:
                    break
        if name in VOID:
            return
        self.tag.append(name)
        self.depth.append(self.depth[self.stack[-1]] + 1)
        self.parent.append(self.stack[-1])
        self.attrs.append(attrs)
        self.start.append(at)
        if not attrs.endswith("/") or name != "svg":
            self.stack.append(len(self.tag) - 1)

    def end(self, name: str) -> None:
        if name in PARTS:
            return
        for d in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[d]] == name:
                self.pop_to(d)
                return
        if name not in INLINE:
            self.border()

    def blocks(self, keep) -> list[str]:
        """Text of the segments' kept elements: references decoded, white space turned into one space."""
        out = []
        for segment in self.segments:
            text = " ".join("".join([html.unescape(t) if "&" in t else t for i, t in segment if keep[i]]).split())
            if text:
                out.append(text)
        return out


def hints(attrs: str) -> tuple[list[int], bool]:
    """Kinds of hints in class, id, role and label attributes; whether the element is hidden."""
    out = [0] * len(HINTS)
    if not attrs or "=" not in attrs:
        return out, "hidden" in attrs.split()
    hidden = False
    for name, value in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            for word in TOKEN.findall(value):
                for k in HINT.get(word.lower(), ()):
                    out[k] += 1
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name == "hidden" or (name == "aria-hidden" and "true" in value):
            hidden = True
    return out, hidden


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Numbers of the elements of each depth, from the top."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


class Forest:
    """The elements of several pages, with whatever is summed up or handed down done depth by depth for all of them."""

    def __init__(self, pages: list[Page]):
        self.sizes = np.array([len(p.tag) for p in pages], np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.parent = np.concatenate([np.array(p.parent, np.int64) + f for p, f in zip(pages, first)])
        self.parent[first] = first
        self.top = np.repeat(first, self.sizes)
        self.depth = np.concatenate([np.array(p.depth, np.int64) for p in pages])
        self.levels = levels(self.depth)

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.copy()
        for at in self.levels[:0:-1]:
            np.add.at(out, self.parent[at], out[at])
        return out

    def above(self, values: np.ndarray) -> np.ndarray:
        """Sums over ancestors."""
        out = np.zeros_like(values)
        for at in self.levels[1:]:
            out[at] = out[self.parent[at]] + values[self.parent[at]]
        return out


TAG_GROUPS = {t: k for k, names in enumerate(GROUPS) for t in names.split()}
STOPS = re.compile(r"[.,?!]")


def features(pages: list[Page], forest: Forest) -> np.ndarray:
    """One row per element of the pages."""
    n, parent = len(forest.parent), forest.parent
    hint, group = np.zeros((n, len(HINTS) + 1), np.float32), np.zeros((n, len(GROUPS)), np.float32)
    own, links, stops, pieces = (np.zeros(n) for _ in range(4))
    at = 0
    for page in pages:
        for i, attrs in enumerate(page.attrs):
            if attrs and ("=" in attrs or "hidden" in attrs):
                kinds, hidden = hints(attrs)
                hint[at + i, :-1], hint[at + i, -1] = kinds, hidden
        for segment in page.segments:
            for i, text in segment:
                size = len(text.strip())
                if size:
                    own[at + i] += size
                    pieces[at + i] += 1
                    stops[at + i] += len(STOPS.findall(text))
        at += len(page.tag)
    tags = [t for p in pages for t in p.tag]
    code = np.array([TAGS.get(t, 0) for t in tags], float)
    kind = np.array([TAG_GROUPS.get(t, -1) for t in tags])
    group[np.flatnonzero(kind >= 0), kind[kind >= 0]] = 1
    above_hint, above_group = forest.above(hint), forest.above(group)
    a = GROUPS.index("a")
    links = np.where((group[:, a] > 0) | (above_group[:, a] > 0), own, 0)
    total, link, stop, inner = (forest.up(v) for v in (own, links, stops, np.ones(n)))
    child = forest.depth > 0
    children = np.bincount(parent[child], minlength=n).astype(float)
    block = np.isin(kind, [GROUPS.index("h1 h2 h3 h4"), GROUPS.index("p blockquote pre")]) & child
    paragraphs = np.bincount(parent[block], minlength=n).astype(float)
    # Place among siblings: children of a parent stand in page order.
    order = np.argsort(np.where(child, parent, -1), kind="stable")
    run = np.arange(n) - np.maximum.accumulate(np.where(np.r_[True, np.diff(np.where(child, parent, -1)[order]) != 0], np.arange(n), 0))
    place = np.empty(n)
    place[order] = run + 1
    siblings = np.where(child, children[parent], 0)
    mean = np.where(siblings > 0, (total[parent] - own[parent]) / np.maximum(siblings, 1), 0)
    whole = np.maximum(total[forest.top], 1.0)
    start = np.concatenate([np.array(p.start) / max(p.length, 1) for p in pages])
    columns = [
        code, forest.depth, np.log1p(np.minimum(own, LONG)), np.log1p(np.minimum(total, LONG)), link / np.maximum(total, 1), np.minimum(total / inner, LONG), stop / np.maximum(total, 1) * 100, np.log1p(inner), children, paragraphs,
        total / whole, start, place / np.maximum(siblings, 1), siblings, np.log1p(np.minimum(mean, LONG)), np.minimum(total / np.maximum(mean, 1), 100), np.minimum(pieces, 20),
        link[parent] / np.maximum(total[parent], 1), np.log1p(np.minimum(total[parent], LONG)), paragraphs[parent],
    ]
    return np.column_stack([*columns, hint, np.minimum(above_hint, 3), group, np.minimum(above_group, 3)]).astype(np.float32)


def decode(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """Most probable choice of kept elements in which every kept element's parent is kept."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    kept, dropped = yes.copy(), no.copy()  # of the subtree, with its top kept or dropped
    for at in forest.levels[:0:-1]:
        np.add.at(kept, forest.parent[at], np.maximum(kept[at], dropped[at]))
        np.add.at(dropped, forest.parent[at], dropped[at])
    keep = forest.depth == 0  # the page itself
    for at in forest.levels[1:]:
        keep[at] = keep[forest.parent[at]] & (kept[at] > dropped[at])
    return keep


def kept_by(model: trees.Trees, pages: list[Page]) -> list[np.ndarray]:
    """Kept elements of each page."""
    if not pages:
        return []
    forest = Forest(pages)
    return np.split(decode(forest, model(features(pages, forest))), np.cumsum(forest.sizes)[:-1])


# Layouts to train on.
CONTAINERS = ('article', 'main', 'div class="post"', 'div class="article-body"', 'div id="content"', 'section class="entry-content"', 'div class="story"', 'div', 'section', 'td', 'div class="main-column"')
MENUS = ('nav', 'ul class="menu"', 'div class="navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'div class="toc links"', 'div role="navigation"')
HEADERS = ('header', 'div class="site-header"', 'div id="masthead"', 'div class="topbar"')
FOOTERS = ('footer', 'div class="footer"', 'div id="bottom"', 'div class="copyright"', 'p class="legal"')
SIDES = ('aside', 'div class="sidebar"', 'div class="related"', 'div id="right-rail"', 'section class="recommended"', 'div class="widget"', 'div class="share social"', 'div class="trending"')
ADVERTS = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="sponsor"', 'section class="promo"', 'aside class="sponsored"', 'ins class="adsbygoogle"', 'p class="ad"', 'div class="ad-banner"')
NOTICES = ('div class="cookie-notice"', 'div id="consent"', 'div class="alert"', 'div class="newsletter"', 'div role="dialog" class="popup"', 'div class="notice"', 'p class="notice"', 'dialog')
COMMENTS = ('div class="comments"', 'section id="comments"', 'div class="comment-list"', 'div id="disqus_thread"', 'ol class="comment-list"', 'section class="reader-comments"', 'div class="discussion"')


def laid_out(texts: list[str], rng: random.Random) -> str:
    """A page with these paragraphs; elements that hold some of them are marked data-keep."""
    word = lambda: rng.choice(rng.choice(texts).split() or ["x"])
    words = lambda a, b: html.escape(" ".join(word() for _ in range(rng.randint(a, b))))
    phrase = lambda: words(4, 30)

    def element(top: str, inner: str, mark: bool = False) -> str:
        return f"<{top}{' data-keep' if mark else ''}>{inner}</{top.split()[0]}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(rng.randint(3, 9)))
        return element(rng.choice(MENUS), rng.choice((f"<ul>{items}</ul>", items)))

    def header() -> str:
        return element(rng.choice(HEADERS), rng.choice((f"<h1>{words(1, 4)}</h1>", f'<a href="/">{words(1, 3)}</a>', f"<div>{words(2, 8)}</div>", f"<p>{phrase()}</p>")) + rng.choice(("", menu())))

    def side() -> str:
        links = "".join(f'<li><a href="/{k}">{words(2, 9)}</a></li>' for k in range(rng.randint(2, 6)))
        return element(rng.choice(SIDES), rng.choice(("", f"<h3>{words(1, 3)}</h3>")) + rng.choice((f"<ul>{links}</ul>", f"<p>{phrase()}</p>", phrase())))

    def choice() -> str:
        return "<select>" + "".join(f"<option>{words(1, 3)}</option>" for _ in range(rng.randint(2, 6))) + "</select>"

    def form() -> str:
        return element(rng.choice(("form", 'form class="search"', 'form action="/subscribe"', 'div class="login-form"', 'div class="contact-form"')), f"<label>{words(1, 4)}</label><input name=q>{rng.choice(("", choice()))}<button>{words(1, 2)}</button>" + rng.choice(("", f"<p>{phrase()}</p>")))

    def advert() -> str:
        return rng.choice(("", "<!-- ad -->")) + element(rng.choice(ADVERTS), rng.choice((phrase(), f"<p>{phrase()}</p>", f'<a href="/x">{words(2, 9)}</a>')))

    def notice() -> str:
        return element(rng.choice(NOTICES), rng.choice((phrase(), f"<p>{phrase()}</p><button>{words(1, 2)}</button>")))

    def comments() -> str:
        one = lambda: rng.choice((f'<div class="comment"><b>{words(1, 2)}</b><p>{phrase()}</p></div>', f"<li><p>{phrase()}</p></li>", f"<p>{phrase()}</p>"))
        return element(rng.choice(COMMENTS), rng.choice(("", f"<h3>{words(1, 3)}</h3>")) + "".join(one() for _ in range(rng.randint(1, 6))))

    def footer() -> str:
        return element(rng.choice(FOOTERS), rng.choice((f"&copy; {phrase()}", f"<p>{phrase()}</p>", phrase() + menu())))

    def paragraph(text: str) -> str:
        text = html.escape(text)
        if rng.random() < 0.2:
            cut = text.split(" ")
            k = rng.randrange(len(cut))
            cut[k] = rng.choice((f"<b data-keep>{cut[k]}</b>", f'<a data-keep href="/w">{cut[k]}</a>', f"<em data-keep>{cut[k]}</em>", f"<span data-keep>{cut[k]}</span>", f'<svg data-keep width="9"><text>{cut[k]}</text></svg>', f"{cut[k]} {choice()}"))
            text = " ".join(cut)
        shape = rng.random()
        if shape < 0.70:
            return f"<p data-keep>{text}</p>"
        if shape < 0.76:
            return f"<p data-keep><b data-keep>{text}<br>"
        if shape < 0.82:
            return f"<ul data-keep><li data-keep>{text}</li><li data-keep>{text[:40]}</li></ul>"
        if shape < 0.87:
            return f"<blockquote data-keep><p data-keep>{text}</p></blockquote>"
        if shape < 0.91:
            return f"<div data-keep>{text}</div>"
        if shape < 0.95:
            return f"<h2 data-keep>{words(2, 7)}</h2><p data-keep>{text}</p>"
        return f"<table data-keep><tr data-keep><td data-keep>{text}</td><td data-keep>{words(1, 5)}</td></tr></table>"

    body = [f"<h1 data-keep>{words(3, 12)}</h1>"] if rng.random() < 0.8 else []
    for text in rng.sample(texts, rng.randint(1, min(8, len(texts)))):
        longer = rng.random() < 0.03
        body.append(paragraph(" ".join([text] * rng.randint(5, 100)) if longer else text[: rng.choice((40, 200, 1000, 4000))]))
        if rng.random() < 0.12:
            body.append(rng.choice((advert, side, form, notice, menu))())
    if rng.random() < 0.2:
        body.append(rng.choice((comments, side, form))())
    top = rng.choice(CONTAINERS)
    article = element(top, "".join(body), True)
    if top == "td":
        article = f"<table data-keep><tr data-keep><td>{menu()}</td>{article}</tr></table>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        article = element(rng.choice(("div", 'div class="wrapper"', 'div id="page"', "section", 'div class="container"')), rng.choice(("", side(), advert())) + article + rng.choice(("", side(), comments())), True)
    before = [f() for f in (header, menu, advert, notice, form) if rng.random() < 0.45]
    after = [f() for f in (side, advert, comments, form, notice, menu) if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    page = "".join(before) + article + "".join(after) + (footer() if rng.random() < 0.8 else "")
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body data-keep>{page}</body></html>"


def weak_labels(page: Page) -> np.ndarray | None:
    """Elements that hold text of an article or main element outside its navigation, forms and the like; None without such an element."""
    n = len(page.tag)
    if not any(t in ("article", "main") for t in page.tag):
        return None
    inside, out = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(1, n):
        t = page.tag[i]
        inside[i] = (inside[page.parent[i]] or t in ("article", "main")) and t not in ("nav", "aside", "footer", "form", "button", "dialog", "select")
    for segment in page.segments:
        for i, text in segment:
            if inside[i] and text.strip():
                out[i] = True
    return upwards(page, out)


def upwards(page: Page, marked: np.ndarray) -> np.ndarray:
    for i in range(len(marked) - 1, 0, -1):
        if marked[i]:
            marked[page.parent[i]] = True
    return marked


def train(sources: list[str], layouts: int = 900, seed: int = 7) -> trees.Trees:
    """Boosted trees from sample pages and from their texts laid out anew."""
    rng = random.Random(seed)
    pages, labels, texts = [], [], []
    for source in sources:
        page = Page(source)
        label = weak_labels(page)
        if label is not None:
            pages.append(page)
            labels.append(label)
            texts += [b for b in page.blocks(label) if len(b.split()) > 3][:20]
    texts = texts if len(texts) >= 8 else ["The quick brown fox jumps over the lazy dog, and then it rests for a while."] * 8 + texts
    for _ in range(layouts):
        page = Page(laid_out(texts, rng))
        pages.append(page)
        labels.append(upwards(page, np.array(["data-keep" in a for a in page.attrs])))
    return trees.fit(features(pages, Forest(pages)), np.concatenate(labels).astype(float))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_pages: int = MAX_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of each page: its main text, blocks joined by empty lines.

    Null html counts as empty and gives an empty text; repeated rows, null ids and null
    urls stay; other columns are not read; an empty table gives no rows. Pages of any
    length are read whole. The model is trained on at most max_pages pages.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # Hashes are ordered first, then their pages fetched: else each task would send max_pages pages to the driver.
    short = rows.filter(F.length("html") <= MAX_TRAIN_CHARS).select(F.xxhash64("id", "html").alias("hash"), "html")
    first = short.select("hash").distinct().orderBy("hash").limit(max_pages)
    sample = short.join(F.broadcast(first), "hash").dropDuplicates(["hash"])
    model = train([r["html"] for r in sample.orderBy("hash").collect()])  # at most max_pages rows of bounded length
    # Broadcasts are pickled by reference to their classes, which executors need not have: plain arrays only.
    shared = pages.sparkSession.sparkContext.broadcast((model.feature, model.limit, model.leaf, model.start))

    def extracted(part: dict[str, list]) -> dict[str, object]:
        parsed = [Page(s or "") for s in part["html"]]
        text = ["\n\n".join(p.blocks(keep)) for p, keep in zip(parsed, kept_by(Trees(*shared.value), parsed))]
        return {"id": part["id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]}

    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, extracted, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
