"""Tree model: exact inference, held-out pages, broken markup."""

import itertools
import math
import random

import pytest

from shelfrank.llm import html_extract as X
from shelfrank.llm.html_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return X.train(labelled_pages())


def test_messages_give_exact_marginals(model):
    rng = random.Random(1)
    for n in (1, 2, 5, 9):
        tree = X.Tree()
        for i in range(n):
            tree.parent.append(rng.randrange(i) if i else -1)
            tree.edge.append(rng.randrange(6))
            tree.own.append((f"f{i}",))
            tree.text.append(None)
        m = X.Model({f"f{i}": rng.uniform(-2, 2) for i in range(n)}, [[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(6)])
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            s = sum(m.weights[f"f{i}"] * y[i] for i in range(n))
            s += sum(m.tables[tree.edge[i]][y[tree.parent[i]]][y[i]] for i in range(1, n))
            weight[y] = math.exp(s)
        belief = X.messages(m, tree)[0]
        for i in range(n):
            p = sum(w for y, w in weight.items() if y[i]) / sum(weight.values())
            assert abs(1 / (1 + math.exp(-belief[i])) - p) < 1e-9


def test_held_out_pages(model):
    right = wrong = missed = 0
    for page, content in labelled_pages(200, seed=77):
        got = set(X.content(model, page))
        right, wrong, missed = right + len(got & content), wrong + len(got - content), missed + len(content - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_held_out_pages_without_names(model):
    right = wrong = missed = 0
    for html, content in labelled_pages(200, seed=78, plain=1.0):
        got = set(X.content(model, html))
        right, wrong, missed = right + len(got & content), wrong + len(got - content), missed + len(content - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


LINE = "A sentence that has some words in it and goes on for a while, as they do."


@pytest.mark.parametrize("html, blocks", [
    ("<div><div>title</div><div>text</div><div>text</div></div>", ["title", "text", "text"]),
    (f"<div><div>The title</div><div>{LINE}</div><div>{LINE} {LINE}</div></div>", ["The title", LINE, f"{LINE} {LINE}"]),
    (f"<div id='content'><div>{LINE}</div><div>{LINE}</div><div>Last one here.</div></div>", [LINE, LINE, "Last one here."]),
    (f"<article><p>{LINE}</p><p><a href='/x'>See the whole story there.</a></p><p>{LINE}</p></article>", [LINE, "See the whole story there.", LINE]),
    (f"<article><h1>Head</h1><button>Share</button><noscript>Please enable scripts.</noscript><p>{LINE}</p></article>", ["Head", LINE]),
    (f"<article><p hidden>no</p><div style='color: red; display : none'><p>nor this</p></div><p>{LINE}</p></article>", [LINE])])
def test_pages_without_names_and_hidden_elements(model, html, blocks):
    assert X.content(model, f"<html><body>{html}</body></html>") == blocks


def test_what_is_hidden():
    assert X.hidden("<p hidden>") and X.hidden('<p class="a" hidden="">') and X.hidden("<p STYLE='Display:None'>")
    assert not X.hidden('<p class="hidden">') and not X.hidden("<p data-x='display:none'>") and not X.hidden("<hidden>")
    assert blocks("<body style='display:none'><p>a</p><select><option>b</select><button>c<p>d</p></body>") == ["a", "c", "d"]


def test_given_pages_give_their_article(model):
    import re

    import pyarrow.parquet as pq
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = re.search("<article.*</article>", html, re.S)
        assert X.content(model, html) == blocks(article[0])


def page(article, before="", after=""):
    return (f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>menu</a></li>"
            f"<li><a href='/b'>other</a></li></ul></nav>{before}<article>{article}</article>{after}<footer>&copy; x.example &middot; All rights.</footer></body></html>")


def test_contract_cases(model):
    text = lambda h: " ".join(X.content(model, h))
    assert text(page("<h1>A &amp; B</h1><p>One\n two&nbsp;&lt;x&gt; &eacute;&#233;.<br>three<p><b>Four.</b></p>")) == "A & B One two <x> éé. three Four."
    assert text(page("<h1>Title here</h1><p>Body of it.</p>", "<div class='ad'>Buy a lot of it now.</div>",
                     "<aside class='sidebar'><p>Some other stories here.</p></aside><div class='cookie-notice'><p>We use cookies here.</p></div>"
                     "<form><p>Sign up for it.</p><input></form><section id='comments'><h3>Comments</h3><p>I like it a lot.</p></section>")) == "Title here Body of it."
    assert text(page("<p>a < b and <3, AT&T &am &unknown; wor<i>ld</i>s go on here.</p><!-- no --><style>p{}</style>")) == "a < b and <3, AT&T &am &unknown; worlds go on here."


@pytest.mark.parametrize("broken", ["", " ", "<", "<p", "</p>", "<p>x", "<!--", "<script>", "<a href=\"x>" * 50, "<div>" * 3000 + "x", "</div>" * 3000, "<p>" * 3000,
                                    "a" * 300000, "<li><td><tr><option>x", "&#0;&#x110000;&", "<p title='>'>y</p>", "<3" * 1000, "\x00<p>\x00</p>"])
def test_broken_markup(model, broken):
    X.content(model, broken)


def test_operator(spark, model):
    rows = [(1, "http://a/x", page("<h1>Head of it</h1><p>Some text of it.</p>")), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "n", page("<p>Only this one here.</p>")),
            (4, "v", page("".join(f"<p>Paragraph {i} of a long one.</p>" for i in range(20000))))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", X.F.lit("clash")).withColumn("id", X.F.lit(0))
    got = {(r.id, r.url): r.text for r in X.extract(df, model).collect()}
    assert got[1, "http://a/x"] == "Head of it Some text of it." and got[2, None] == "" == got[3, "u"]
    assert got[None, "n"] == "Only this one here."
    assert got[4, "v"] == " ".join(f"Paragraph {i} of a long one." for i in range(20000))
    assert X.extract(df, model).count() == len(rows) and X.extract(df.limit(0), model).count() == 0


def blocks(html):
    return [t for t in X.parse(html).text if t is not None]


def test_formulas_and_fallback_text_are_text():
    assert blocks("<p>So <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math> holds.</p>") == ["So x=y2 holds."]
    assert blocks("<p>One <object data=a>fallback</object> two.</p><canvas>drawn</canvas><p>end</p>") == ["One fallback two.", "drawn", "end"]


def test_unclosed_elements_do_not_swallow_the_page():
    for name in ("svg", "math", "object", "canvas"):
        assert blocks(f"<div><{name} width=1><p>One here.</p><h1>Two</h1></div>") == ["One here.", "Two"], name
    assert blocks("<p>a</p><svg><path d='M0'/><text>no</text></svg><p>b</p>") == ["a", "b"]
    assert blocks("<svg><title>no</title><svg><g/></svg><text>no</text><foreignObject><div>no</div></foreignObject><text>no</text></svg><p>b</p>") == ["b"]
    assert blocks("<svg><foreignObject><svg></svg><div>no</div></foreignObject></svg><p>b</p>") == ["b"]
    assert blocks("<svg><!-- <p> --><text>no</text></svg>b<svg/>c") == ["b", "c"]
    assert blocks("<svg><title>no<p>One.</p>") == ["One."]
    assert blocks("<script>no<p>no</p>") == [] and blocks("<p>a</p><style>no <p>no") == ["a"]


def test_many_unclosed_drawings():
    assert len(blocks("<svg><title><p>x" * 5000)) == 5000
    assert blocks("<svg>" * 20000 + "<p>x") == ["x"]
