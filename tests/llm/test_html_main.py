import re
import time

import numpy as np
import pytest
from conftest import SF

from tickloom.llm import html_main as H
from tickloom.llm.common import table
from tickloom.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model(spark):
    return H.fitted(table(spark, SF, "pages"))


def read(model, page):
    found = H.blocks(page)
    return [t for (t, *_), on in zip(found, model.label([found])[0]) if on]


def test_every_page_of_the_table(spark):
    """These pages hold their text in an article element: a plain reading of that element is the yardstick."""
    html = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in QUERIES["op7_main_text"](spark, SF).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", html[r["page_id"]], re.S)[1]
        parts = (" ".join(H.html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|article|b)>|<br>", inside))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_a_page_with_everything(model):
    prose = ["The ship left the harbour before dawn, and nobody on the quay saw it go.",
             "It carried grain, timber and a crew of nine, two of whom had never been to sea.",
             "By noon the wind had turned, so they lay to behind the point and waited."]
    page = f"""<html><head><title>no</title><style>p{{}}</style></head><body>
      <header class="site-header"><div>Daily Post</div></header><nav class="menu"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies.</p></div>
      <article><h1>A ship at&nbsp;dawn</h1><p>{prose[0]}<p>{prose[1]}<script>var x = "<p>no</p>";</script>
      <div class="ad"><p>Buy now!</p></div><p>{prose[2]}</article>
      <section class="comments"><h3>Comments</h3><div>I liked this story very much, thank you for it.</div></section>
      <aside class="sidebar"><h3>Related</h3><li><a href=/z>Another story</a></li></aside>
      <form><label>Mail</label><input><button>Subscribe</button></form><footer>&copy; Daily Post</footer>"""
    assert read(model, page) == ["A ship at dawn", *prose]


def test_blocks():
    got = H.blocks('<div id=a class="b c">one <b>two</b>\n three<p>f&amp;ur<p>five<br>six<!-- no --><a href="x>y">link</a></div>tail</p> < end')
    assert [t for t, *_ in got] == ["one two three", "f&ur", "five sixlink", "tail", "< end"]
    want = np.zeros(H.PATHS)
    for weight, word in zip((0.5, 1, 1, 1), ("<div>", "a", "b", "c")):
        want[H.zlib.crc32(word.encode()) % H.PATHS] += weight
    assert (got[0][1] == want).all() and [n for _, _, n, _ in got] == [4, 5, 5, 0, 0]
    assert got[2][3] == 4
    assert H.blocks(None) == H.blocks("") == H.blocks("<script>never closed") == H.blocks("<!-- never closed") == []


@pytest.mark.parametrize("inside, want", [
    ('one <svg class="icon"/> two', ["one two"]), ('one <svg viewBox="0 0 1 1"><title>no</title><path d=""/><style>a>b{}</style><svg><text>no</text></svg></svg> two', ["one two"]),
    ("one <svg><foreignObject><p>no</p></foreignObject></svg>two", ["one two"]), ("one<svg><g><text>no", ["one"]), ("one <svg width=1/>no</svg> two", ["one two"]),
    ("let <math/> x", ["let x"]), ("let <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></mrow><annotation>no</annotation></math> be", ["let x=1 be"]),
    ("see <object data=f.pdf><param name=a><embed src=b>the <b>file</b></object> here", ["see the file here"]), ("see <object/> here", ["see here"]),
    ("pick <select><option>no</select> one", ["pick", "one"]), ("pick <select><option>no", ["pick"]), ("a <template><div>no</div></template> b", ["a", "b"]),
    ("a <template><div>no", ["a"]), ("a <o:p>b</o:p> c", ["a", "b", "c"]), ("a <math><mi>b", ["a b"])])
def test_text_after_unseen_elements(inside, want):
    page = f"<article><section><p>{inside}</p></section><p>after</p><h2>later</h2><svg><path/></svg><p>last</p></article>"
    assert [t for t, *_ in H.blocks(page)] == [*want, "after", "later", "last"]


@pytest.mark.parametrize("name", sorted("script style textarea title iframe noembed noframes".split()))
def test_raw_text_is_cut_to_its_end(name):
    assert [t for t, *_ in H.blocks(f"<p>a</p><{name}/><p>no</p></{name}><p>b</p>")] == ["a", "b"]
    assert [t for t, *_ in H.blocks(f"<p>a</p><{name}><p>no</p>")] == ["a"]


def test_an_article_with_icons_is_whole(model):
    prose = ["The ship left the harbour before dawn, and nobody on the quay saw it go.",
             "It carried grain, timber and a crew of nine, two of whom had never been to sea.",
             "By noon the wind had turned, so they lay to behind the point and waited."]
    page = f"""<html><body><nav class="menu"><ul><li><a href=/>Home</a></ul></nav><article><h1>A ship at dawn</h1><p><svg class="icon"/>{prose[0]}</p>
      <p>{prose[1]}<svg><path d="M0 0"></p><p>{prose[2]}</p></article><footer>Daily Post</footer></body></html>"""
    assert read(model, page) == ["A ship at dawn", *prose]


def test_gradients_are_those_of_the_loss():
    rnd = np.random.default_rng(1)
    model = H.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = H.padded([rnd.normal(size=(n, H.PATHS + H.WORDS + H.MEASURES)) for n in (4, 2, 3)])
    x, y = x.astype(np.float64), (rnd.random(mask.shape) < 0.5) * 1.0
    def loss():
        p, _ = model.scores(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = model.gradients(x, mask, y)
    for k, w in model.w.items():
        for at in rnd.integers(0, w.size, 5):
            old = w.flat[at]
            w.flat[at] = old + 1e-4
            up = loss()
            w.flat[at] = old - 1e-4
            down = loss()
            w.flat[at] = old
            assert (up - down) / 2e-4 == pytest.approx(np.asarray(g[k]).flat[at], abs=2e-4)


def test_padding_does_not_change_labels(spark, model, monkeypatch):
    pages = [H.blocks(r["html"]) for r in table(spark, SF, "pages").collect()]
    alone = [model.label([p])[0] for p in pages]
    for cells in (1, 300, 1 << 14):
        monkeypatch.setattr(H, "CELLS", cells)
        assert all((a == b).all() for a, b in zip(alone, model.label(pages)))
    for p, on in zip(pages, alone):  # as the network that is trained
        if p:
            assert (on == (model.scores(*H.padded([H.vectors(p)]))[0][:, 0] >= 0.5)).all()


@pytest.mark.parametrize("page, want", [
    ("<p>x</p>" * 40_000, 40_000), ("<a " * 200_000, 1), ("y > <a " + "<a " * 200_000, 1), ("<div>t" * 20_000, 20_000), ("<span>" * 50_000 + "<h1>a</h1></q>" * 20_000, 20_000),
    ("<i ' \" >b" * 30_000, None), ("<svg><g>" * 50_000 + "<p>a", 1), ("<!--" * 100_000, 0), ("<select>" * 50_000 + ">", None), ("a <p" + "<!" * 200_000, None)])
def test_work_is_in_proportion_to_the_page(model, page, want):
    began = time.process_time()
    found = H.blocks(page)
    on = model.label([found, H.blocks("<p>short</p>")])[0]
    assert len(on) == len(found) and (want is None or len(found) == want)
    assert time.process_time() - began < 30


def test_odd_rows(spark, model):
    long = "<article>" + "<p>A line of the story, and then some more of it.</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", long), (4, "u", long), (5, "u", "</div></p><b>")]
    out = H.main_text(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES), model).collect()
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"].count("\n\n") for r in out if r["page_id"] == 4] == [2999, 2999]
    assert all(r["text"] == "" for r in out if r["page_id"] in (1, 2, 5))
    none = spark.createDataFrame([], PAGES)
    assert H.main_text(none, H.fitted(none)).collect() == []
