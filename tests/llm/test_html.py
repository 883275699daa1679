import pytest

from sourceloom.llm.html_text import Page, main_text


def text(source, template=frozenset()):
    return Page(source, template).text


@pytest.mark.parametrize(("source", "want"), [
    ("", ""),
    ("plain", "plain"),
    ("<p>a</p><p>b", "a b"),
    ("<p>a<b>b</b>c <i>d</i></p>", "abc d"),
    ("<p>1 &lt; 2 &amp;amp; 3 < 4</p>", "1 < 2 &amp; 3 < 4"),
    ("<nav>n</nav><article><h1>T</h1><p><b>x.<br><p>y</p></article><footer>f</footer>", "T x. y"),
    ('<script>var t="</p>";</script><style>p{}</style>a<!-- c --> b<noscript>n</noscript>', "a b"),
    ('<div class="ad">x</div><div id="reader-comments">y</div><div role="navigation">z</div><div hidden>h</div>k', "k"),
    ('<div class="shadow adapter">kept</div>', "kept"),
    ("<article><header><h1>T</h1></header><aside>s</aside>t</article><header>h</header>", "T t"),
    ("<p>a\n\t b</p>&nbsp;<p>c &am", "a b c &am"),
    ("a<p", "a"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<b><article>x</b> y</article>", "x y"),
    ('<a title="a > b" href=\'x>y\'>t</a><img alt="q>">', "t"),
    ("<p>un<!-- never closed", "un"),
    ("</div></p></article>z</", "z"),
])
def test_page(source, want):
    assert text(source) == want


def test_template_of_a_host(spark):
    pages = []
    for k in range(40):
        shared = "<div>Read our new paper</div>" if k % 2 else ""
        pages.append((k, f"https://A.example.org/{k}", f"<div><span>Site line</span></div>{shared}<div>own {k}</div><article><p>quoted</p>t{k}</article>"))
    pages += [(100, "https://b.example.org/", "<div><span>Site line</span></div>"), (101, None, None), (102, "", "<p>x</p>"), (100, "https://b.example.org/", "<p>" + "y " * 100_000)]
    frame = spark.createDataFrame([(*p, "h", "q") for p in pages], "page_id bigint, url string, html string, host string, hashes string")
    got = sorted((r.page_id, r.text) for r in main_text(frame).collect())
    want = [(k, f"own {k} quoted t{k}") for k in range(40)] + [(100, "Site line"), (100, ("y " * 100_000).strip()), (101, ""), (102, "x")]
    assert got == sorted(want)
    assert main_text(frame.limit(0)).count() == 0


def test_templates_joined_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr("sourceloom.llm.html_text.BROADCAST_HASHES", 0)
    frame = spark.createDataFrame([(k, "x://h/", f"<div>site</div><p>{k}</p>") for k in range(9)], "page_id bigint, url string, html string")
    assert sorted(r.text for r in main_text(frame).collect()) == [str(k) for k in range(9)]


def by_url(spark, rows):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id bigint, url string, html string")
    return [r.text for r in sorted(main_text(frame).collect())]


def test_copies_of_a_page_are_no_template(spark):
    """Five copies with a menu of their own each, and five repeated rows, of pages without article."""
    copies = [(f"https://a.example.org/{k}", f"<nav>{k}</nav><div class=\"body\"><p>One text.</p><p>Its end.</p></div>") for k in range(5)]
    repeated = [("https://b.example.org/", "<div><p>Another text.</p></div>")] * 5
    assert by_url(spark, copies + repeated) == ["One text. Its end."] * 5 + ["Another text."] * 5


def test_what_holds_an_article_is_no_template(spark):
    rows = [(f"https://a.example.org/{k}", f"<div class=\"page\"><div>Site line</div><article>text {k}</article></div>") for k in range(6)]
    assert by_url(spark, rows) == [f"text {k}" for k in range(6)]


@pytest.mark.parametrize(("source", "want"), [
    ('<div class="content has-sidebar"><article>t</article></div>', "t"),
    ('<div id="page" class="with-header"><main><p>t</p></main></div>', "t"),
    ('<div class="has-sidebar"><p>t</p></div>', "t"),
    ('<div id="page-with-sidebar"><p>t</p></div>', "t"),
    ('<article><div class="post-header"><h1>T</h1></div><h2 id="related-work">R</h2><section class="social-history">s</section></article>', "T R s"),
    ('<article><div class="header"><h1>T</h1></div>t<div class="share">s</div></article>', "T t"),
    ('<div class="sidebar wide">s<article>t</article>u</div>', "t"),
    ('<div class="comments"><article class="comment">c</article></div>k', "k"),
    ('<article>t<div class="related"><article>teaser</article></div></article>', "t"),
    ("<nav><article>n</article></nav><div hidden><main>h</main></div>k", "k"),
])
def test_declared_by_whole_names(source, want):
    assert text(source) == want


@pytest.mark.parametrize("few", [True, False])
def test_a_block_on_five_of_many_pages(spark, monkeypatch, few):
    """However many pages the host has; also beside the text in ``main``."""
    if not few:
        monkeypatch.setattr("sourceloom.llm.html_text.HOST_HASHES", 0)
    notice = '<div class="box">Read this</div>'
    rows = [("https://a.example.org/", f"<main>{notice if k < 5 else ''}<p>own {k}</p></main>") for k in range(700)] + [("https://b.example.org/", notice)] * 2
    assert by_url(spark, rows) == [f"own {k}" for k in range(700)] + ["Read this"] * 2
