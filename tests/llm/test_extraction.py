"""Pages: blocks, the recurrent network and the text that is left."""

import numpy as np
import pytest

from filingframe.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></ul></nav><!-- <p>not here</p> --><div class="ad">Buy now</div>
<article><h1>A &amp; B</h1><p><b>First line.<br><p>Second   line
 with&nbsp;more.</p>{body}</article><footer>&copy; site</footer></body></html>"""


def pages(spark, n=40):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choice(words, rng.integers(5, 60)))}.</p>" for _ in range(rng.integers(1, 9)))
        rows.append((i, f"u{i}", PAGE.replace("{body}", body), "x"))
    rows += [(100, "e", "", "x"), (101, "n", None, "x"), (102, None, "plain text, no tags", "x"), (None, "b", "<div><p>open <i>ended", "x"), (0, "u0", rows[0][2], "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, content string")


def test_blocks():
    got = extraction.blocks(PAGE.replace("{body}", "<ul><li>i<li>j</ul>tail"))
    assert [(b.path, b.text) for b in got] == [
        (("nav", "ul", "li"), "One"), (("nav", "ul", "li"), "Two"), (("div", ".ad"), "Buy now"), (("article", "h1"), "A & B"), (("article", "p"), "First line."),
        (("article", "p"), "Second line with more."), (("article", "ul", "li"), "i"), (("article", "ul", "li"), "j"), (("article",), "tail"), (("footer",), "© site"),
    ]
    assert got[0].linked == 3 and got[3].linked == 0


@pytest.mark.parametrize("html,want", [
    ("", []), ("a < b &lt;c&gt; &#8364;", ["a < b <c> €"]), ("<p title='x > y'>t</p>", ["t"]), ('<p title="broken>t</p>', ["t"]), ("<script>never closed <p>x", []),
    ("<div>a<span>b</span> c</div>", ["ab c"]), ("<!-- open", []), ("<svg><text>no</text></svg><p>yes", ["yes"]), ("</p></div>x", ["x"]),
    ("<TABLE><TR><TD>1<TD>2</TABLE>", ["1", "2"]), ("x<br>y<hr>z", ["x y", "z"]), ("<p>" * 2000 + "deep", ["deep"]), ("<div>" * 2000 + "deep", ["deep"]),
])
def test_blocks_of_odd_markup(html, want):
    assert [b.text for b in extraction.blocks(html)] == want


@pytest.mark.parametrize("html,want", [
    ("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is mass.</p>", ["Energy E=m is mass."]),
    ("<p>x <math><semantics><mi>a</mi><annotation>\\alpha</annotation></semantics></math> y</p>", ["x a y"]),
    ("<p>a <svg><path d='x'/><p>b</p><p>c</p>", ["a", "b", "c"]),
    ("<div><p>a</p><select><option>no</div><p>b</p>", ["a", "b"]),
    ("<p>one</p><canvas><p>two</p><div>three</div>", ["one", "two", "three"]),
    ("<p>one</p><canvas>no <p>no</p></canvas><p>two</p>", ["one", "two"]),
    ("<p>Hello <object><div>no</div></object> world</p>", ["Hello world"]),
    ("<p>Hello <svg><text>no</text></svg> world</p>", ["Hello world"]),
    ("<video><source src=x>no<ul><li>a</ul>", ["a"]),
    ("<template><p>no</p><template><p>no</p></template><p>no</p></template><p>yes", ["yes"]),
    ("<noscript><svg><p>no</p></noscript><p>yes", ["yes"]), ("</svg></object>x", ["x"]), ("<svg/>x <svg />y", ["x y"]),
    ("<p>a<svg>" * 300 + "z", ["a"] * 300), ("<svg>" * 3000 + "<p>z", ["z"]),
])
def test_what_is_not_shown_ends(html, want):
    """Only what stands inside an element that is not shown is left out; one without an end tag hides no block."""
    assert [b.text for b in extraction.blocks(html)] == want


def grown(rng, depth):
    """A random page and its blocks, as it is written."""
    html, texts, line = [], [], []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            texts.append(text)

    def tree(depth):
        for _ in range(rng.integers(1, 4)):
            kind = rng.integers(0, 7 if depth else 2)
            if kind < 2:
                word = f"w{rng.integers(100)} "
                html.append(word)
                line.append(word)
            elif kind == 2:
                name = ("b", "span", "mi", "math")[rng.integers(4)]
                html.append(f"<{name}>")
                tree(0)
                html.append(f"</{name}>")
            elif kind == 3:
                name = ("svg", "noscript", "object", "template", "canvas")[rng.integers(5)]
                html.append(f"<{name}>hidden <{name}>more</{name}> " + ("<div>hidden</div>" if name != "svg" else "") + f"</{name}>")
                line.append(" ")
            elif kind == 4:
                name = ("script", "style", "textarea")[rng.integers(3)]
                html.append(f"<{name}>hidden </p> <div></{name}>")
                line.append(" ")
            else:
                name = ("div", "section", "blockquote", "article")[rng.integers(4)]
                flush()
                html.append(f"<{name} class='c'>")
                tree(depth - 1)
                flush()
                html.append(f"</{name}>")

    tree(depth)
    flush()
    return "".join(html), texts


@pytest.mark.parametrize("seed", range(40))
def test_blocks_of_grown_pages(seed):
    html, texts = grown(np.random.default_rng(seed), 5)
    assert [b.text for b in extraction.blocks(html)] == texts


def test_all_words_of_a_block_count():
    """Blocks that differ behind their first words have different vectors; a long one stays in the range of a short one."""
    block = lambda text: extraction.Block(("p",), text, 0)
    start = "alpha beta " * 50
    a, b = extraction.vectors([block(start + "login subscribe " * 30), block(start + "gamma delta " * 30)])
    assert not np.allclose(a, b)
    (long,) = extraction.vectors([block("word other " * 50_000)])
    assert np.abs(long).max() < 20


def test_gradient_matches_differences():
    network = extraction.Labeller(hidden=4)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(2)
    x, mask = extraction.padded([rng.normal(size=(5, extraction._INPUT)), rng.normal(size=(3, extraction._INPUT))])
    y = (rng.random(mask.shape) > 0.5).astype(float)
    g = network.gradient(x, mask, y)

    def loss():
        z, _ = network.logits(x, mask)
        return float((mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum())

    for k, values in network.p.items():
        flat = values.ravel()
        for i in rng.integers(0, len(flat), 5):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert g[k].ravel()[i] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_batching_does_not_change_labels():
    network = extraction.Labeller()
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(n, extraction._INPUT)).astype(np.float32) for n in (1, 7, 30, 2, 0, 7)]
    alone = [network.label([p])[0] for p in x]
    for a, b in zip(network.label(x, cells=20), alone, strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_extraction(spark):
    table = pages(spark)
    network = extraction.fit_labeller(table)
    rows = extraction.extract_content(table, network, keys=("page_id", "url")).collect()
    assert len(rows) == table.count()
    html = {r["page_id"]: r["html"] for r in table.collect()}
    for r in rows:
        assert r["n_chars"] == len(r["content"])
        if r["page_id"] is not None and r["page_id"] < 100:
            assert r["content"] == "\n\n".join(b.text for b in extraction.blocks(html[r["page_id"]]) if b.path[0] == "article")
        elif r["page_id"] in (100, 101):
            assert r["content"] == ""


def test_other_layouts(spark):
    """Parts the sample does not have are told apart by what they are called and by what stands around them."""
    network = extraction.fit_labeller(pages(spark))
    body = "".join(f"<p>{'alpha beta gamma delta ' * n}end.</p>" for n in (6, 9, 4))
    page = (
        '<div class="top-menu"><ul><li><a>a</a><li><a>b</a></ul></div><div class="cookie-notice"><p>We use things.</p></div><main><h1>Head</h1>' + body
        + '<aside><h3>Also</h3><p>see this</p></aside></main><form><p>Your name</p></form><section id="comments"><p>I liked that very much indeed.</p></section><footer>f</footer>'
    )
    got = extraction.extract_content(spark.createDataFrame([("u", page)], "url string, html string"), network).first()["content"]
    assert got.split("\n\n") == ["Head", *(f"{'alpha beta gamma delta ' * n}end." for n in (6, 9, 4))]


def test_no_pages(spark):
    none = spark.createDataFrame([], "url string, html string")
    network = extraction.fit_labeller(none)
    assert extraction.extract_content(none, network).count() == 0
