"""Main text of pages: parsing, decoding, and held-out accuracy on pages and on layouts."""

import html
import itertools
import os
import random
import re

import numpy as np
import pytest

from starloom.llm import html_extract as H
from starloom.llm.common import read

SF = "/root/testdata/sf0.01"


def texts_of(source):
    page = H.Page(source)
    return page.blocks(np.ones(len(page.tag), bool))


def test_parsing():
    assert texts_of("a<p>b<b>c<br>d<p>e &amp; f&nbsp;g</p>") == ["a", "bc d", "e & f g"]
    assert texts_of('<p>x</p><script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no</p> -->y') == ["x", "y"]
    assert texts_of("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert texts_of("<p title='a>b'>q</p> 1 < 2 <x y") == ["q", "1 < 2 <x y"] and texts_of("") == []
    assert texts_of("<p>one <i>two</i>\n three</p></article></div>") == ["one two three"]
    assert texts_of("<script>open") == [] and texts_of("&lt;p&gt;") == ["<p>"]
    deep = H.Page("<div>" * 3000 + "x")
    assert len(deep.tag) == 3001 and H.kept_by(lambda x: np.ones(len(x)), [deep])[0].all()


def test_formulas_drawings_and_raw_elements_in_a_line():
    assert texts_of("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><p>b</p>") == ["If x=2 then", "b"]
    assert texts_of("<p>one <svg><path d='M0'/></svg>two <script>no</script>three</p>") == ["one two three"]
    for tag in ("svg", "math", "select"):
        page = H.Page(f"<article><p>a</p><{tag}><p>b</p><p>c</p></article>")
        assert page.blocks(np.ones(len(page.tag), bool)) == ["a", "b", "c"]
        assert all(page.tag[page.parent[i]] == "article" for i, t in enumerate(page.tag) if t == "p")


def test_formula_in_an_article_is_extracted(spark):
    line = "The quick brown fox jumps over the lazy dog, and then it rests for a while."
    body = f"<p>{line}</p><p>Where <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds, {line}</p><svg><path><p>{line} Again.</p>"
    page = f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title of it</h1>{body}</article><footer>Copyright</footer></body></html>"
    got = H.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got.text == f"Title of it\n\n{line}\n\nWhere E=m holds, {line}\n\n{line} Again."


def test_decoding_is_the_best_choice_without_contradictions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        page = H.Page("<div><section><p>a</p><p>b</p></section><nav><a>c</a></nav></div><p>d</p>")
        odds = rng.normal(0, 2, len(page.tag))
        forest = H.Forest([page])
        keep = H.decode(forest, odds)
        p = 1 / (1 + np.exp(-odds))
        value = lambda k: np.log(np.where(k[1:], p[1:], 1 - p[1:])).sum()
        choices = (np.array((True, *c)) for c in itertools.product((True, False), repeat=len(odds) - 1))
        best = max(value(k) for k in choices if all(k[page.parent[i]] or not k[i] for i in range(1, len(odds))))
        assert all(keep[page.parent[i]] or not keep[i] for i in range(1, len(odds))) and abs(value(keep) - best) < 1e-9


def test_trees():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = H.trees.fit(x[:3000], y[:3000])
    assert ((model(x[3000:]) > 0) == y[3000:]).mean() > 0.98


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pages(spark):
    pages = read(spark, SF, "pages")
    # Trained on a third of the pages; all the others are held out.
    got = {r.page_id: r for r in H.extract(pages, max_pages=80).collect()}
    sources = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(sources)
    for k, source in sources.items():
        inside = re.search(r"(?s)<article>(.*)</article>", source)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[k].text == "\n\n".join(b for b in blocks if b) and got[k].n_chars == len(got[k].text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_other_layouts(spark):
    sources = [r.html for r in read(spark, SF, "pages").limit(120).collect()]
    model, rng = H.train(sources[:80]), random.Random(99)
    texts = [b for s in sources[80:] for b in H.Page(s).blocks(H.weak_labels(H.Page(s)))]
    right = total = 0
    for _ in range(150):
        page = H.Page(H.laid_out(texts, rng))
        label = np.array(["data-keep" in a for a in page.attrs])
        label[0] = True
        got, want = page.blocks(H.kept_by(model, [page])[0]), page.blocks(label)
        right, total = right + len(set(got) & set(want)), total + len(set(got) | set(want))
    assert right / total > 0.95


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<article><p>" + "Some text, here. " * 5000 + "</p></article>"), (3, "u", "no markup"), (3, "u", "no markup")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(df).collect()
    assert len(got) == 5 and {r.page_id: r.text for r in got}[2] == "" and {r.page_id: r.url for r in got}[1] is None
    assert {r.page_id: r.n_chars for r in got}[None] == len(("Some text, here. " * 5000).strip())
    assert H.extract(df.limit(0)).count() == 0
