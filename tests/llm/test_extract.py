import html
import itertools
import re

import numpy as np
import pytest

from leagueflow.llm import dom, extract as X, labelled_pages as P

SF = "/root/testdata/sf0.001"


def article_text(page):
    """Independent reading of the test pages: the article element's headings and paragraphs."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    inner = re.sub(r"<(script|style).*?</\1>", "", m.group(1) if m else "", flags=re.S)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
    return "\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def model(spark):
    return X.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_query_equals_independent_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = X.op4_html_extract(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_layouts(model):
    examples = P.layouts(300, ["word", "other", "of", "the", "long", "page,"], seed=99)
    wrong = sum(a != b for found, labels in examples for a, b in zip(model.viterbi(found), labels))
    assert wrong / sum(len(x) for _, x in examples) < 0.01


def test_parts_of_a_page(model):
    page = """<!doctype html><html><head><title>Site</title></head><body>
    <div class="cookie-banner"><p>We use cookies, accept them.</p></div>
    <header><div>My site</div><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav></header>
    <form role="search"><label>Search</label><button>Go</button></form>
    <main><article><h1>A&nbsp;title &amp; more</h1><p>First  <b>para</b>graph\n of <a href=x>text</a>, with words.<p>Second one<br>goes on.
    <div class="advert"><p>Buy this now, it is cheap.</p></div><!-- <p>no</p> --><script>if (a < b) document.write("<p>x</p>")</script>
    <ul><li>One thing is said.</li><li>Then another one.</li></ul><p>1 &lt; 2 &#8212; end.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thanks.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><p>Some other story that you may like.</p></aside>
    <footer><p>&copy; 2024 My site</p></footer></body></html>"""
    assert X.main_text(page, model) == "A title & more\nFirst paragraph of text, with words.\nSecond one goes on.\nOne thing is said.\nThen another one.\n1 < 2 — end."


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    names = ["in:p", "in:div", "leaf:p", "leaf:div", "comma", "words:1", "words:2"]
    for _ in range(20):
        m = X.ChainModel({n: tuple(rng.normal(size=2)) for n in names}, rng.normal(size=2), rng.normal(size=(2, 2)))
        page = [dom.Block(((str(rng.choice(["p", "div"])),),), str(rng.choice(["a", "a, b", "a b"])), 0) for _ in range(6)]
        s = m.scores(page)
        value = lambda y: m.first[y[0]] + sum(s[i][y[i]] for i in range(6)) + sum(m.step[a, b] for a, b in zip(y, y[1:]))
        assert value(m.viterbi(page)) == pytest.approx(max(value(y) for y in itertools.product((0, 1), repeat=6)))
    assert X.ChainModel().viterbi([]) == []


def test_training_reaches_the_likelihoods_maximum():
    """At the optimum the expected feature counts, by enumeration, equal the observed ones less the ridge."""
    rng = np.random.default_rng(1)
    page = lambda: [dom.Block(((str(rng.choice(["p", "div"])),),), str(rng.choice(["a", "a, b"])), 0) for _ in range(3)]
    data = [(p, rng.integers(0, 2, 3).tolist()) for p in (page() for _ in range(6))]
    ridge = 0.05
    m = X.train(data, steps=3000, rate=0.02, ridge=ridge)
    n = sum(len(p) for p, _ in data)
    want, have = np.zeros((2, 2)), np.zeros((2, 2))
    for p, y in data:
        s = m.scores(p)
        value = lambda z: m.first[z[0]] + sum(s[i][z[i]] for i in range(3)) + sum(m.step[a, b] for a, b in zip(z, z[1:]))
        every = list(itertools.product((0, 1), repeat=3))
        weight = np.exp([value(z) for z in every])
        weight /= weight.sum()
        for a, b in zip(y, y[1:]):
            want[a, b] += 1
        for z, w in zip(every, weight):
            for a, b in zip(z, z[1:]):
                have[a, b] += w
    assert np.allclose((want - have) / n, ridge * m.step, atol=1e-3)


def test_broken_markup():
    text = lambda page: [b.text for b in dom.blocks(page)]
    assert text(None) == text("") == text("<p>") == text("<script>var a = '<p>x</p>'") == []
    assert text("plain < text & more &lt;b&gt;") == ["plain < text & more <b>"]
    assert text('<p title="a > b">x<p>y</div>z') == ["x", "y", "z"]
    assert text("<p>cut <b") == ["cut"]
    assert text("<!-- never ends <p>x</p>") == []
    assert text('<p "unbalanced>x</p>y') == ["x", "y"]
    deep = "<div>" * 3000 + "in" + "</div>" * 3000
    assert text(deep) == ["in"]


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Words here, and more.</p></article>", "x"), (3, "u", "   ", "x"), (3, "u", "   ", "x"), (4, "u", "<article>" + "<p>Words here, and more of it.</p>" * 20000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = X.extract(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {(r.page_id, r.url): r for r in got.collect()}
    assert got.count() == 6 and by[1, "u"].text == "" and by[2, None].n_chars == 0 and by[3, "u"].text == ""
    assert by[None, "u"].text == "Words here, and more."
    assert by[4, "u"].text.count("\n") == 19999
    empty = df.limit(0)
    assert X.extract(empty, X.fit(empty)).count() == 0


def texts(body):
    return [b.text for b in dom.blocks(f"<body><div>{body}</div><p>And so on.</p></body>")]


@pytest.mark.parametrize(
    "body, want",
    [
        ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here</p>", "Energy is E=mc2 here"),
        ("<p>Energy is <math><semantics><mi>E</mi><annotation encoding=tex>E_0<b>x</b></annotation></semantics></math> here</p>", "Energy is E here"),
        ("<p>See <svg><title>no</title><style>.a{}</style><g><text>North</text><text>South</text></g><path d='M0'/></svg> now</p>", "See North South now"),
        ("<p>A <object data=x><object data=y>inner words</object></object> end</p>", "A inner words end"),
        ("<p>A <canvas>drawn words</canvas> and <video src=v>clip words</video> end</p>", "A drawn words and clip words end"),
        ("<p>A <noscript><b>hidden</b></noscript><template><p>hidden</p></template> end</p>", "A end"),
        # unclosed: they lose nothing, or what stands before the end of their parent
        ("<p>Energy is <math><mi>E</mi> here</p>", "Energy is E here"),
        ("<p>See <svg><text>North</p>", "See North"),
        ("<p>A <object data=x>inner</p>", "A inner"),
        ("<p>A <noscript><b>hidden</p>", "A"),
        ("<p>A <select><option>one<option>two</p>", "A"),
    ],
)
def test_what_a_reader_sees_stays(body, want):
    assert texts(body) == [want, "And so on."]


def test_an_unclosed_script_runs_to_the_end():
    assert texts("<p>Before</p><script>if (a < b) { x('</p>') }") == ["Before"]
