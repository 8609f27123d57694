import pytest

from codeloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">Accept?</div><div id="sidebar"><p>Aside</p></div>
<article><h1>Head &amp; line</h1><p>One <b>bold<br>text</b>&nbsp;x<p>Two<script>var t="</p>";</script> more
 here</p><form><input>Send</form><div class=ad>Buy</div><table><tr><td>c1<td>c2</table><!-- no --><div class="comments"><p>First!</p></div></article>
<footer>&copy; us</footer>"""


def test_an_article_without_what_surrounds_it():
    assert html_text.main_text(PAGE) == "Head & line One bold text x Two more here c1 c2"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("a<b>b</b>c", "abc"), ("<p>a</i></b>b</p>", "ab"), ("<p>1 < 2</p>", "1 < 2"),
        ("<div>a<!-- x", "a"), ("<script>x", ""), ("<p a='<' b=\">\">t", "t"), ("<main><p>m</p></main><p>o</p>", "m"), ("<div role=main>m</div>n", "m"), ("<li>a<li>b", "a b"), ("<p>&#233;&eacute;&amp;amp;</p>", "éé&amp;"),
        ("<DIV CLASS='Ad'>x</DIV>y", "y"), ("<p>head</p><p class='heading shadow'>kept</p>", "head kept"), ("<article><p>a</p></article><p>o</p><article><p>b</p></article>", "a b"),
    ],
)
def test_fragments(html, text):
    assert html_text.main_text(html) == text


def test_very_long_and_broken_pages_are_quick():
    for html in ("<" * 200_000, "<p>" * 100_000, "<b " * 100_000, "<a \"" * 60_000, "<div>" * 3_000 + "x" + "</div>" * 3_000, "a" * 1_000_000, "</p>" * 100_000, "&amp" * 100_000):
        html_text.main_text(html)


def site(n, host, shift=0):
    rows = []
    for k in range(n):
        rows.append((shift + k, f"https://{host}/{k}", f"<body><div class=top><p>Welcome to us</p><div class=c><p>All rights kept</p></div></div><div class=body><p>Story {k} of {host}</p><p>Its own end {k * k}</p></div></body>"))
    return rows


def test_low_branches_go_by_host(spark):
    rows = [*site(30, "one.example"), *site(3, "two.example", 100)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.extract(pages).collect())
    assert got == sorted([(k, f"Story {k} of one.example Its own end {k * k}") for k in [*range(30), 0]] + [(100 + k, f"Welcome to us All rights kept Story {k} of two.example Its own end {k * k}") for k in range(3)])


def chain(*styles):
    at = 0
    for style in styles:
        at = html_text.node(at, style)
    return at


def test_importance_by_hand(spark):
    pages = spark.createDataFrame(site(8, "h.example"), "page_id long, url string, html string")
    tree = {r.node: r for r in html_text.style_tree(pages).collect()}
    assert len(tree) == 4 and not any(r.inside for r in tree.values()) and {r.pages for r in tree.values()} == {8}
    assert tree[chain("body", "div.top")].importance == pytest.approx(0.0, abs=1e-9) and tree[chain("body", "div.body")].importance == pytest.approx(0.9)
    assert tree[chain("body")].importance == pytest.approx(0.9 * (8 * 2) / (8 * 2 + 2))


def tree_by_plain_counting(pages):
    """The style tree of one host from its definition."""
    import math

    seen = {}
    for html in pages:
        blocks = html_text.clean_blocks(html)
        seen[frozenset(b.text for b in blocks)] = blocks
    out = {}
    for name in {n for blocks in seen.values() for b in blocks for n in b.nodes}:
        having = [bs for bs in ([b for b in blocks if name in b.nodes] for blocks in seen.values()) if bs]
        m = len(having)
        if m == 1:
            out[name] = 1.0
            continue
        styles, texts = {}, {}
        for bs in having:
            style = tuple(dict.fromkeys(b.nodes[b.nodes.index(name) + 1] if b.nodes[-1] != name else 0 for b in bs))
            styles[style] = styles.get(style, 0) + 1
            for t in {b.text for b in bs}:
                texts[t] = texts.get(t, 0) + 1
        shown = -sum(k / m * math.log(k / m) for k in styles.values()) / math.log(m)
        told = 1 - sum(math.log(k) / math.log(m) for k in texts.values()) / len(texts)
        out[name] = 0.1 * shown + 0.9 * told
    return out


def test_the_tree_equals_plain_counting(spark):
    import random

    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    html = []
    for k in range(60):
        boxes = "".join(f"<div class=box{r.randint(1, 3)}><p>{r.choice(words)}</p>{'<ul><li>one<li>two</ul>' * r.randint(0, 1)}</div>" for _ in range(r.randint(0, 3)))
        html.append(f"<body><div class=top>{r.choice(words)}</div><article><h1>{k // 2}</h1>{boxes}<section>{r.choice(words)} {k}</section></article></body>")
    pages = spark.createDataFrame([(k, "https://t.example/x", h) for k, h in enumerate([*html, *html[:9]])], "page_id long, url string, html string")
    got = {x.node: x.importance for x in html_text.style_tree(pages.repartition(7)).collect()}
    expected = tree_by_plain_counting(html)
    assert set(got) == set(expected) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_a_repeated_box_goes_from_inside_articles(spark):
    page = "<html><body><article><h1>Story {0}</h1><p>It goes {0} ways.</p><div class=share><p>Tell your friends</p><ul><li>here<li>there</ul></div><div class=box><p>Buy now</p></div><p>The end of {0}.</p></article></body></html>"
    pages = spark.createDataFrame([(k, "https://a.example/" + str(k), page.format(k)) for k in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {k: f"Story {k} It goes {k} ways. The end of {k}." for k in range(30)}
    few = {r.page_id: r.text for r in html_text.extract(pages.where("page_id < 3")).collect()}
    assert few[0] == "Story 0 It goes 0 ways. Buy now The end of 0."  # too few pages to judge by; "share" is a word that names noise


def test_near_copies_of_an_article_keep_their_paragraphs(spark):
    page = "<body><article><h1>One headline</h1><p>One paragraph.</p><p>Another {0}.</p></article><div class=ad>{0}</div></body>"
    pages = spark.createDataFrame([(k, "https://n.example/x", page.format(k)) for k in range(200)], "page_id long, url string, html string")
    assert all(r.text == f"One headline One paragraph. Another {r.page_id}." for r in html_text.extract(pages).collect())


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"), ('<article class="post no-comments"><p>a</p></article>', "a"), ('<div id="page-header-wrap"><main><p>a</p></main></div>', "a"),
        ('<main class="search-page social"><p>a</p></main>', "a"), ('<div class="related-work"><p>the whole of it</p></div><p>x</p>', "the whole of it x"), ('<div class="elementor-widget-container"><p>all</p></div>', "all"),
        ('<article><div class="elementor-widget-container"><p>all</p></div></article>', "all"), ('<div data-id="menu"><p>a</p></div>', "a"), ('<form id="aspnetForm"><div><article>a</article></div></form>', "a"), ("<form><p>all of the page</p></form>", "all of the page"),
        ("<div class=story><p>The main story, told at length.</p></div><article>teaser</article>", "The main story, told at length. teaser"),
        ('<div class="comments-area"><p>Long comments on a short article go on and on.</p></div><article>Short.</article>', "Short."), ('<article>Short.<div class="comments"><p>Long comments on a short article.</p></div></article>', "Short."),
        ('<article>Long enough to be an article.<div class="cookie-notice">Accept?</div></article>', "Long enough to be an article."), ('<div class="sidebar"><article>in</article></div><p>out</p>', "in out"),
    ],
)
def test_names_are_hints(html, text):
    assert html_text.main_text(html) == text


def test_copies_of_a_page_are_no_evidence(spark):
    html = "<body><div class=body><p>One story</p></div></body>"
    pages = spark.createDataFrame([(k, "https://c.example/a", html) for k in range(50)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"One story"}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (2, "", ""), (None, "not a url", "<p>x</p>"), (3, "http://h", "<p></p>")]
    pages = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], "page_id long, url string, html string, text string, _host string, node string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, None, ""), (2, "", ""), (2, "", ""), (None, "not a url", "x"), (3, "http://h", "")]))
    assert html_text.extract(pages.limit(0)).collect() == []


def test_articles_of_the_given_pages(spark):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.inside = [], False

        def handle_starttag(self, tag, attributes):
            self.inside |= tag == "article"
            self.out += [" "] * (tag in ("p", "br", "h1"))

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.out += [" "] * (tag in ("p", "h1"))

        def handle_data(self, data):
            self.out += [data] * self.inside

    def article(html):
        p = Article()
        p.feed(html)
        p.close()
        return " ".join("".join(p.out).split())

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == expected


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><p data-props="' + "<b>hidden</b> more " * 200 + '">shown</p></article>', "shown"), ("<p data-x='" + "a > b " * 1000 + "'>shown</p>", "shown"),
        ('<p>a<svg class="icon"/>b</p><p>c</p>', "ab c"), ("<p>a<svg/>b</p><p>c<svg><text>no</text></svg>d</p>", "ab cd"), ("<article>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</article>", "a x=2 b"),
        ("<article><object data=f><p>instead</p></object><canvas>drawn</canvas></article>", "instead drawn"), ("<p>a<script src=x />not</script>b</p>", "ab"),
    ],
)
def test_long_values_and_embedded_elements(html, text):
    assert html_text.main_text(html) == text


def test_unclosed_quotes_are_quick():
    for html in ("<a \">" * 100_000, "<a '>\">" * 100_000, "<a x='\"" * 100_000, "<p>" * 100_000 + "<a \"" + "<p '>" * 100_000, "<svg/>" * 100_000):
        html_text.main_text(html)
