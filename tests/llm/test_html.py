"""Main text of pages: the parser, the trees, the decoding, and whole pages."""

import itertools
import random
import time

import numpy as np
import pytest

from cohortlens.llm import html_extract as h

PAGES = "page_id long, url string, html string, text string, n_chars string"


def page(i, boiler="", inside="", wrap="article", n=5):
    r = random.Random(i)
    words = "some plain words of a longer text that goes on and on, as texts do".split()
    paragraphs = [" ".join(r.choices(words, k=r.randint(8, 60))).capitalize() + "." for _ in range(n)]
    body = f"<h1>Title {i}</h1>" + paragraphs[0].join(["<p><b>", "<br>"]) + inside + "".join(f"<p>{x} &amp; more\n  here</p>" for x in paragraphs[1:])
    want = [f"Title {i}", paragraphs[0], *(f"{x} & more here" for x in paragraphs[1:])]
    source = f'<!DOCTYPE html><html><head><title>Title {i}</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body><nav><ul>{"".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(6))}</ul></nav>{boiler}<{wrap}>{body}</{wrap.split()[0]}><footer>&copy; somebody</footer></body></html>'
    return source, "\n\n".join(want)


def test_parser():
    got = h.parse("<p>a&nbsp;<b>b</b>c<br>d<p>e &lt;f&gt; &amp x<!-- <p>no --><ul><li>g<li>h</ul><script>if (a<b) '</p>'</script>tail <i")
    assert [t for _, t in got.blocks] == ["a bc d", "e <f> & x", "g", "h", "tail"]
    assert h.parse(None).blocks == [] and h.parse("").blocks == [] and h.parse("<script>x").blocks == []
    deep = h.parse("<div>" * 5000 + "x")
    assert deep.nodes[-1].depth == 5000 and deep.blocks == [(5000, "x")]
    assert [t for _, t in h.parse("2 < 3 and <p title='a > b'>c").blocks] == ["2 < 3 and", "c"]


def test_drawings_formulas_and_media():
    text = lambda source: [t for _, t in h.parse(source).blocks]
    assert text('<p>a<svg width="1" /></p><p>b</p><math/><p>c</p>') == ["a", "b", "c"]
    assert text("<p>a <svg><title>no</title><text>no</text><style>p > q</style></svg> b</p><svg><svg/><svg><text>no</text></svg>no</svg>c") == ["a b", "c"]
    assert text("<div><svg><path d='x'></div><p>a</p>") == ["a"] and text("<svg><path><p>a</p>b") == ["a", "b"] and text("<p><svg><g></p>a") == ["a"]
    assert text("<svg><foreignObject><div>in</div></foreignObject><text>no</text></svg>a") == ["in", "a"]
    assert text("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>") == ["let x=2 be"]
    for tag in ("object", "audio", "video", "canvas"):
        assert text(f"<div>a <{tag} class=x>b</div><p>c</p>") == ["a b", "c"] and text(f"<p>a <{tag}>b</{tag}> c</p>") == ["a b c"]
    # Raw text: to its end tag, or to the end of the page.
    for tag in ("script", "style", "template", "iframe", "textarea", "noframes"):
        assert text(f"a<{tag}><p>no</p></{tag}><p>b") == ["a", "b"]
        assert text(f"a<{tag}><p>no") == ["a"]


def test_broken_tags():
    text = lambda source: [t for _, t in h.parse(source).blocks]
    assert text("<p title='it's'>Hello, don't go</p><p>b it's</p>") == ["Hello, don't go", "b it's"]
    assert text('<a title="5" wide">link text</a>') == ["link text"]
    # A quote that is never closed opens no value; a tag that the page ends in is dropped.
    assert text('<p>a <a href="x>b</a> c</p>') == ["a b c"] and text('a<p title="b" c') == ["a"]
    assert text("<p>a<b=1>c</p><p class = 'x>y' id=z/>d") == ["ac", "d"] and text("1 < 2 <3 </ x>4<!-->5<!---->6") == ["1 < 2 <3 456"]
    assert text("<article><noscript><p>read me</p></noscript>end</article>") == ["read me", "end"] and text("a<noscript>b") == ["a", "b"]
    assert text("<style>x</styles></style>a</script >b") == ["ab"]


@pytest.mark.parametrize("piece", ['<a "', "<div class=x ", "<div>", "<p>a", "<a b=\"", "<!--", "<svg><style>", "<ul><li><b>", "</div>", "<td><p>", "</svg>", "<"])
def test_time_is_linear(piece):
    def seconds(n):
        start = time.process_time()
        h.parse("<p><table><svg></svg>" + piece * (n // len(piece)))
        return time.process_time() - start

    # Quadratic time would take hours for the long page.
    assert seconds(3_000_000) < 12


def test_decoding_is_the_best_consistent_labelling():
    r = np.random.default_rng(5)
    got = h.parse("<div><div><p>a</p><p>b</p></div><ul><li>c</li></ul></div>")
    n = len(got.nodes)
    for _ in range(20):
        p = r.uniform(0.02, 0.98, n)
        value = {"frame": np.full(n, np.log(0.25)), "main": np.log(p), "other": np.log(1 - p)}
        allowed = {"frame": ("frame", "main", "other"), "main": ("main", "other"), "other": ("other",)}
        best = max((s for s in itertools.product(value, repeat=n) if all(s[i] in allowed[s[got.nodes[i].parent]] for i in range(1, n))), key=lambda s: sum(value[x][i] for i, x in enumerate(s)))
        assert h.decode(got, p) == [x == "main" for x in best]


@pytest.fixture(scope="module")
def trees():
    return h.fit([page(i)[0] for i in range(60)])


def test_trees_separate_a_simple_target():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = h.boost(x[:1500], y[:1500], np.ones(1500))
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


@pytest.mark.parametrize("boiler,inside,wrap", [
    ("", "", "article"), ('<div class="ad">Buy this now, all of you.</div>', "", "article"), ('<header class="site-header">The paper</header><aside class="sidebar"><p>Other things, said aside.</p></aside>', "", 'div class="content"'),
    ('<div class="cookie-notice">We use cookies, as everybody does.</div>', '<div class="advert">Buy <b>more</b>.</div>', "main"), ("", '<form class="search"><label>Search</label><input></form>', "article"),
    ('<section class="comments"><div class="comment"><p>I do not agree with this, not at all.</p></div></section>', "", "article")])
def test_whole_pages(trees, boiler, inside, wrap):
    for i in range(100, 112):
        source, want = page(i, boiler, inside, wrap)
        got = h.parse(source)
        assert h.blocks_of(got, h.decode(got, trees.probability(h.describe(h.counts(got))))) == want
        # A page that breaks off.
        cut = h.parse(source[:source.index("<footer")].replace("</article>", ""))
        assert h.blocks_of(cut, h.decode(cut, trees.probability(h.describe(h.counts(cut))))) == want


def test_a_page_goes_on_after_an_empty_drawing(trees):
    for inside in ('<svg class="icon" />', "<math/>", "<svg><path d='M0 0'>", "<svg><text>no</text></svg>"):
        source, want = page(120, "", inside)
        got = h.parse(source)
        assert h.blocks_of(got, h.decode(got, trees.probability(h.describe(h.counts(got))))) == want


def test_the_operator(spark):
    sources = [page(i) for i in range(30)]
    many, want = page(77, n=900)
    rows = [(i, f"u{i}", s) for i, (s, _) in enumerate(sources)] + [(90, "u", None), (91, None, ""), (3, "u3", sources[3][0]), (None, "u", sources[4][0]), (92, "u", many), (93, "u", "x" * 300_000)]
    got = h.main_text(spark.createDataFrame([(*r, "a", "b") for r in rows], PAGES)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == w for i, (_, w) in enumerate(sources)) and text[90] == text[91] == "" and text[None] == sources[4][1] and text[92] == want
    assert h.main_text(spark.createDataFrame([], PAGES)).collect() == []
