"""The block labeller on the table, on layouts it hasn't seen and on odd pages."""

import html
import re

import numpy as np
import pytest

from folioscope.llm import html_blocks as b
from folioscope.llm import html_extract as x
from tests.llm.cases import rows_of, table

SCHEMA = "page_id long, url string, html string, text string, id string, n_chars string"


@pytest.fixture(scope="module")
def model(spark, sf):
    return x.fit(table(spark, sf, "pages"))


def pages(spark, texts):
    return spark.createDataFrame([(i, f"http://example.com/{i}", t, "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def article(page):
    """The blocks of the table's pages, which all have one article tag."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_table(spark, sf):
    docs = table(spark, sf, "pages")
    found = {r.page_id: r for r in x.main_text(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert (found[r.page_id].url, found[r.page_id].text, found[r.page_id].n_chars) == (r.url, article(r.html), len(article(r.html)))


def test_held_out_layouts(spark, sf, model):
    """Layouts of other texts, of another seed: at most 1 of 200 blocks is wrong."""
    texts = [r.html for r in spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/pages.parquet").collect()]
    held = x.training_pages(texts, seed=1234, layouts=400)[-400:]
    found = x.classify(model, [[block for block, _ in page] for page in held])
    wrong = sum(int((np.array([y for _, y in page]) != k).sum()) for page, k in zip(held, found))
    assert wrong <= sum(map(len, held)) / 200


BODY = ["A first paragraph of the story, which is long enough to read as prose.", "Another one follows, with a <a href='/x'>link</a> &amp; an entity.", "The last paragraph ends here."]
PLAIN = ["A first paragraph of the story, which is long enough to read as prose.", "Another one follows, with a link & an entity.", "The last paragraph ends here."]
P = "".join(f"<p>{x}</p>" for x in BODY)
SHELLS = [
    "<html><head><title>t</title><script>x('<p>')</script></head><body><header><div class='logo'>Site</div><nav><a href='/'>Home</a><a>News</a></nav></header><main><h1>Head</h1>{}</main><footer><p>All rights reserved</p></footer></body></html>",
    "<body><div class='wrapper'><div id='menu'><ul><li><a>One</a><li><a>Two</a></ul></div><div class='entry-content'><h1>Head</h1>{}<div class='share'><a>Share</a></div></div><div id='sidebar'><h3>Popular</h3><ul><li><a>Some other story</a></li></ul></div></div>",
    "<body><div class='cookie-banner'><p>We use cookies to improve this site.</p><button>OK</button></div><article><header><h1>Head</h1></header>{}</article><section id='comments'><h3>Comments</h3><div class='comment'><p>I do not agree with this story at all, it is wrong.</p></div></section>",
    "<body><nav><a>Home</a></nav><article class='post'><h1>Head</h1>{}<aside class='ad'><p>Buy this now, it is a good thing to have.</p></aside></article><form class='newsletter'><label>Your mail</label><input></form><div class='footer'>&copy; 2024</div>",
]


@pytest.mark.parametrize("shell", SHELLS)
def test_shells(model, shell):
    blocks = b.leaf_blocks(shell.format(P))
    taken = [block.text for block, y in zip(blocks, x.classify(model, [blocks])[0]) if y]
    assert taken == ["Head", *PLAIN]


def test_odd_pages(spark, model):
    odd = [None, "", " ", "plain text only", "<", "<<p>", "<p", "</p></div>", "<!-- never closed <p>x", "<script>never closed <p>x", "<![CDATA[x]]><p>y", "&#0;&#x110000;&unknown;&am", "<p>\x00 nul</p>", "<article><p>" + "y" * 50_000 + "</p></article>"]
    odd += ["<div>" * 3_000 + "<p>deep</p>", "<article><p>a&nbsp;b\u2003c<br>d\n e</p><ul><li>one<li>two</ul></article>", "<ARTICLE><P>Upper", "<article><p>é 北京 👩‍👩‍👧</p></article>"]
    found = {r.page_id: r for r in x.extract(pages(spark, odd), model).collect()}
    assert len(found) == len(odd) and all(found[i].text == "" for i in (0, 1, 2))
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert found[13].text == "y" * 50_000 and found[15].text == "a b c d e\n\none\n\ntwo" and found[16].text == "Upper" and found[17].text == "é 北京 👩‍👩‍👧"
    assert x.main_text(pages(spark, [])).collect() == []
    same = x.extract(spark.createDataFrame([(None, None, "<article><p>A short story.</p></article>")] * 2, "page_id long, url string, html string"), model)
    assert rows_of(same) == [(None, None, "A short story.", 14)] * 2
    assert x.main_text(pages(spark, [None, ""])).count() == 2


def test_pieces_equal_whole(model, monkeypatch):
    """A page of many blocks is read in pieces, and pages of a batch don't touch one another."""
    shell = SHELLS[1].format(P * 40)
    long, short = b.leaf_blocks(shell), b.leaf_blocks(SHELLS[3].format(P))
    whole = x.classify(model, [long])[0]
    together = x.classify(model, [short, [], long, short])
    assert (together[2] == whole).all() and len(together[1]) == 0 and (together[0] == together[3]).all()
    monkeypatch.setattr(x, "BLOCKS", 16)
    assert (x.classify(model, [long, short])[0] == whole).all() and whole.sum() == 121


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    page = [(blk, i % 2 == 0) for i, blk in enumerate(b.leaf_blocks(SHELLS[0].format(P)))]
    blocks, truth, lengths = [q for q, _ in page], np.array([y for _, y in page], np.float32), np.array([len(page) - 3, 3])
    p = {k: rng.normal(0, 0.3, v.shape) for k, v in x.new_model().items()}

    def loss(p):
        f = x.Features(blocks)
        flat = f.project(p)
        u, mask, step, at = x.padded(flat, lengths)
        h = np.concatenate([x.scan(u[:, :, : 4 * x.CELLS], mask, p["ahead"])[0], x.scan(u[::-1, :, 4 * x.CELLS : -1], mask[::-1], p["back"])[0][::-1]], 2)
        z = h[step, at].astype(np.float64) @ p["out"] + flat[:, -1]
        return float(np.mean(np.log1p(np.exp(-z * (2 * truth - 1)))))

    g = x.learn(p, blocks, truth, lengths)
    for k, at in (("out", (3,)), ("ahead", (2, 5)), ("back", (4, 40)), ("numbers", (1, 17)), ("numbers", (0, 128))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[k][at]) < 2e-3
