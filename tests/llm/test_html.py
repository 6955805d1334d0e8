import itertools
import math
import random
import time

import pytest

from colonnade.llm import html as H


def test_marginals_against_all_labellings():
    rng = random.Random(1)
    for n in (1, 2, 5, 7):
        parent = [-1] + [rng.randrange(0, i) for i in range(1, n)]
        evidence = [[rng.uniform(0.05, 3) for _ in range(3)] for _ in range(n)]
        ties = [[[rng.uniform(0.05, 1) for _ in range(3)] for _ in range(3)] for _ in range(n)]
        root = [0.2, 0.5, 0.3]
        mass = [[0.0] * 3 for _ in range(n)]
        for y in itertools.product(range(3), repeat=n):
            p = root[y[0]] * math.prod(evidence[i][y[i]] for i in range(n)) * math.prod(ties[i][y[parent[i]]][y[i]] for i in range(1, n))
            for i in range(n):
                mass[i][y[i]] += p
        for got, want in zip(H.sum_product(parent, evidence, ties, root), mass):
            assert got == pytest.approx([w / sum(want) for w in want])


SMALL = [
    "<nav><a href=/a>Home</a></nav><article><p>A sentence of some words, as they come.</p></article>",
    "<div class=ad>Buy now.</div><main><h1>Title</h1><p>A sentence of some words, as they come.</p></main>",
    "<p>Short.</p><div class=content>A sentence of some words, as they come. Another one.</div>",
    "<aside><a href=/x>Link</a></aside><section><p>Words and more words, in a row.</p></section>",
]


@pytest.mark.parametrize("html", SMALL)
def test_main_text_against_all_labellings(html):
    """The whole way from a page to its text, with every labelling of the tree weighed."""
    import numpy as np

    m, t = H.model(), H.parse(html)
    n = len(t.tag)
    evidence = np.exp(np.clip(H.node_features(t) @ m.weights, -8, 8))
    mass, content = 0.0, [0.0] * n
    for y in itertools.product(range(3), repeat=n):
        p = m.root[y[0]] * math.prod(evidence[i][y[i]] for i in range(n)) * math.prod(m.ties[H.kind_of(t.tag[i])][y[t.parent[i]]][y[i]] for i in range(1, n))
        mass += p
        for i in range(n):
            content[i] += p * (y[i] == H.CONTENT)
    want = "\n\n".join(t.text[i] for i in range(n) if t.tag[i] == "block" and content[i] / mass >= 0.5)
    assert H.main_text(html, m) == want


def test_held_out_pages():
    m, rng = H.model(), random.Random(4321)
    right = blocks = whole = 0
    for _ in range(150):
        t = H.parse(H.labelled_page(rng))
        lab, p = H.labels_of(t), m.marginals(t)
        ok = [(lab[i] == H.CONTENT) == (p[i] >= 0.5) for i in range(len(p)) if t.tag[i] == "block"]
        right, blocks, whole = right + sum(ok), blocks + len(ok), whole + all(ok)
    assert right / blocks > 0.98 and whole > 120


PAGES = {
    "article": ('<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A  title\n here</h1><p><b>A title<br><p>First &amp; second,&nbsp;a <i>third</i> of many words in a row.</p><script>var t="</p>";</script><ul><li>One point of it.<li>Another point.</ul></article><footer>&copy; us</footer></body></html>', "A title here\n\nA title\n\nFirst & second, a third of many words in a row.\n\nOne point of it.\n\nAnother point."),
    "main": ('<body><header><h1>Site</h1><a href=/>start</a></header><div class="cookie-notice"><p>We use cookies to serve you better than ever.</p><button>OK</button></div><main class="content"><h2>Heading of it</h2><p>A long enough sentence stands here, with commas, and an end.</p></main><aside class="sidebar"><h3>Popular</h3><ul><li><a href=/x>Some link</a></li></ul></aside><section class="comments"><h3>Comments</h3><p>I liked this very much, thank you for writing it.</p></section><form><label>Mail</label><input><button>Send</button></form></body>', "Heading of it\n\nA long enough sentence stands here, with commas, and an end."),
    "nothing": ("<html><body><nav><a href=/a>Home</a></nav><script>x()</script></body></html>", ""),
}


PAGES |= {
    "no head and body tags": ("<title>t</title><nav><a href=/a>Home</a></nav><article><p>First paragraph with many words, and more.</p></article>", "First paragraph with many words, and more."),
    "an open head": ("<html><head><title>t</title><meta name=x><script>var a='<p>';</script><nav><a href=/a>Home</a></nav><article><p>First paragraph with many words, and more.</p></article>", "First paragraph with many words, and more."),
    "text ends the head": ("<head><title>t</title>Hello<article><p>First paragraph with many words, and more of them here.</p></article>", "First paragraph with many words, and more of them here."),
    "a line break first": ("<nav><a href=/a>Home</a></nav><article><br>Story of the day, with many words in it.</article>", "Story of the day, with many words in it."),
    "formula and fall-backs": ("<body><article><p>The sum <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> of a long sentence, as said.</p><object>Words of an object, many of them, in a row.</object><noscript><p>Words for readers without scripts, many of them.</p></noscript><svg><text>no</text></svg></article>", "The sum x=2 of a long sentence, as said.\n\nWords of an object, many of them, in a row.\n\nWords for readers without scripts, many of them."),
    "raw text": ("<body><article><p>A long sentence, with a &lt;tag&gt; in it, stands here.</p><style>p > a {}</style><script>if (a</b) '</article>'</script><p>Another long sentence, with 1 < 2 in it.</p></article>", "A long sentence, with a <tag> in it, stands here.\n\nAnother long sentence, with 1 < 2 in it."),
    "comments": ("<body><article><!-- <p>no</p> --><p>A long sentence, with some words in it.</p><!--><p>Another sentence, of as many words.</p><!--></article>", "A long sentence, with some words in it.\n\nAnother sentence, of as many words."),
    "attributes": ("""<body><div class='ad' title="a > b">Buy this thing now.</div><article data-x=a/b lang='en'><p id="p>1">A long sentence, with some words in it.</p></article></body>""", "A long sentence, with some words in it."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert H.main_text(html, H.model()) == want


def test_odd_markup_does_not_break_or_take_long():
    m = H.model()
    for html in ("", "plain words", "<", "<p", "</p></div>", "<div>" * 30_000 + "x", "<p>" * 30_000 + "x", "<b>" * 20_000 + "x", "<table><tr><td>a<td>b<tr><td>c</table>", "<!-- x", "<article><p>&bogus; &#0; &#x110000; &#55296;</p></article>", "a\x00b"):
        H.main_text(html, m)
    for unit in ("<", "<!--", "<a ", "</", "&", "<!", '<a b="', "<script>", "<textarea>", "<div>", "<li>", "<b>", "<div></p>", "<b></i>", "<ul><li><div>", "<table><tr><td>", "<button><p>", "<a href=x><p>"):
        began = time.process_time()
        H.main_text(unit * 50_000 + "x", m)
        assert time.process_time() - began < 10, unit  # quadratic work takes minutes
    long = "<article>" + "<p>Some words of a paragraph, and more of them, to the end.</p>" * 3000 + "</article>"
    assert H.main_text(long, m).count("\n\n") == 2999


def test_table(spark):
    rows = [(1, "u", PAGES["article"][0], "t"), (2, None, None, "t"), (3, "v", "", "t"), (1, "u", PAGES["article"][0], "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in H.extract(pages).collect())
    want = PAGES["article"][1]
    assert out == [(1, "u", want, len(want)), (1, "u", want, len(want)), (2, "", "", 0), (3, "v", "", 0)]
    assert H.extract(pages.limit(0)).count() == 0


def test_a_thousand_odd_pages():
    """Any mixture of tags, comments, quotes and text is read without an error, and text outside of hidden elements is not lost by the parser."""
    rng, m = random.Random(12), H.model()
    tags = "html head body title p div article br hr a b i li ul ol td tr table script style svg math noscript template select option textarea iframe form button nav main".split()
    for k in range(1000):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            t = rng.choice(tags)
            parts.append(rng.choice((f"<{t}>", f"</{t}>", f"<{t} class='x y'>", f'<{t} id="nav', f"<{t}/>", f"w{k} ", "<!-- c -->", "<!--", "-->", "<", "</", "&amp;", "&#x41;", "&bogus", '"', "'", ">", "<!doctype html>", "<?x?>", "\x00", "é漢")))
        page = "".join(parts)
        tree = H.parse(page)
        assert all(p < i for i, p in enumerate(tree.parent)) and len(tree.tag) == len(tree.text)
        H.main_text(page, m)
    words = [f"word{i}" for i in range(300)]
    shown = [t for t in tags if t not in H.HIDDEN | H.RAW | H.VOID]
    for _ in range(200):
        page = "".join(rng.choice((f"<{rng.choice(shown)}>", f"</{rng.choice(shown)}>")) * (rng.random() < 0.6) + w + " " for w in words)
        assert " ".join(H.parse(page).text).split() == words
