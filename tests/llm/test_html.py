import numpy as np

from leafmill.llm.html_blocks import blocks
from leafmill.llm.html_extract import Labeller, extract, fit, labelled, main_texts, padded, shipped, vectors

PAGE = '<html><head><title>T</title><script>var t="</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four&nbsp;five</article><div class="comments"><p>Great article!</p></div><footer>&copy; me</footer></body></html>'


def test_blocks():
    assert [b.text for b in blocks(PAGE)] == ["Home", "Buy now", "A & B", "One two three", "Four five", "Great article!", "© me"]
    assert blocks(None) == [] and blocks("") == [] and [b.text for b in blocks("a < b <i>c")] == ["a < b c"]


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = Labeller(1)
    x, mask = padded([rng.normal(size=(n, model.w["fx"].shape[0])).astype(np.float32) for n in (3, 5)])
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)
    g, _ = model.gradients(x, mask, y)
    for name in ("fx", "bh", "f_b", "out"):
        k = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        at, ends = model.w[name][k], []
        for d in (1e-2, -1e-2):
            model.w[name][k] = at + d
            ends.append(model.gradients(x, mask, y)[1])
        model.w[name][k] = at
        assert abs((ends[0] - ends[1]) / 2e-2 - g[name][k]) < 0.05 * abs(g[name][k]) + 1e-4, name


def test_held_out_pages(spark):
    model = shipped()
    wrong = total = 0
    for v, y in labelled(12345, 150):
        wrong += int(((model.scores(*padded([v]))[:, 0] > 0) != (y > 0)).sum())
        total += len(y)
    assert wrong <= 0.01 * total
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in extract(pages).collect())
    want = "A & B\nOne two three\nFour five"
    assert got == [(1, want), (1, want), (2, ""), (3, "")]
    assert extract(pages.where("false")).count() == 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


BODY = "<h1>Title</h1><p>Body text of the article goes on for some words here.</p>"
WANT = "Title\nBody text of the article goes on for some words here."


def test_pages_unlike_the_makers():
    """Pages written by hand, in shapes that sites have."""
    cases = [
        f"<header><h1>Site name here</h1></header><main>{BODY}</main><footer>me</footer>",
        f'<table><tr><td><a href="/a">Home</a></td><td><a href="/b">Products</a></td><td><a href="/c">Contact</a></td></tr></table><div class="content">{BODY}</div>',
        f'<article>{BODY}</article><div class="teaser"><h3><a href="/x">Another story</a></h3><h3><a href="/y">More of it</a></h3></div>',
        f'<article>{BODY}</article><div class="commentaires"><p>Tres bien cet article, merci beaucoup.</p><p>Moi aussi</p></div>',
        BODY,
        f'<div id="wrap"><div class="sidebar"><h3>Links</h3><ul><li><a href="#">x</a></ul></div><div id="main">{BODY}</div><div id="footer">Copyright me 2020</div></div>',
        f'<nav><a href="/">Home</a> <a href="/n">News</a></nav><div class="cookie-consent"><p>We use cookies.</p></div><section class="post">{BODY}</section><form><label>Name</label><input><button>Go</button></form>',
    ]
    assert main_texts([page(x) for x in cases], shipped()) == [WANT] * len(cases)


def test_no_text_is_lost():
    assert [b.text for b in blocks("\u0130" * 40 + "<script>x</script>after")] == ["\u0130" * 40 + " after"]
    assert [b.text for b in blocks("one <svg><g><svg>x</svg>in</g></svg>two <video>never closed")] == ["one two never closed"]
    assert [b.text for b in blocks('<p title="unclosed>one<p>two <a href=\'x>y</a>')] == ["one", "two y"]
    assert [b.text for b in blocks('<p title="a>b">one</p><!-- c <p>two')] == ["one"]
    long = " ".join(f"w{k}" for k in range(70))
    a, b = (vectors(blocks(f"<p>{long} {x}</p>")) for x in ("one", "two"))
    assert (a != b).any()  # all words of a block count


def test_time_grows_with_the_length():
    import time

    for x in ("<div>" * 40_000 + "x", "<div>a " * 20_000, '<a b="' * 40_000, "<" * 400_000, "<!x" * 200_000, "<a " * 200_000, "<svg>x" * 20_000, "<b>" + "<div></b>" * 20_000, "<div><li>x" * 20_000, "<a b='\"" * 20_000):
        began = time.process_time()
        made = blocks(x)
        assert time.process_time() - began < 5, x[:20]
        if len(made) < 100:
            vectors(made)
    deep = blocks("<div>a " * 5_000)
    assert len(deep) == 5_000 and vectors(deep).shape[0] == 5_000


def test_training_from_scratch():
    small = fit(pages=800, epochs=4)
    wrong = [int(((small.scores(*padded([v]))[:, 0] > 0) != (y > 0)).sum()) for v, y in labelled(999, 40)]
    assert sum(wrong) < 0.1 * sum(len(y) for _, y in labelled(999, 40))


def test_pages_of_the_table(spark):
    """Each page against its article, cut out by its tags."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: "\n".join(b.text for b in blocks(re.search(r"(?s)<article>.*</article>", r["html"])[0])) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == want
