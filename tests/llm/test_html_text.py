import html
import re
import time

from centavo.llm import html_text
from centavo.llm.html_text import main_text

BODY = "<p>" + "One, two, three words of the article. " * 4 + "</p>"
PLAIN = " ".join(("One, two, three words of the article. " * 4).split())


def test_article_of_every_page(spark, small):
    """An independent reading of the given pages, whose article element is known."""
    rows = html_text.extract(spark.read.parquet(f"{small}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<b>", ""))]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_boilerplate_goes():
    page = (
        "<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>"
        "<div class='cookie-notice'><p>We use cookies, really.</p></div><div id=main><h1>Title &amp; more</h1>"
        f"{BODY}<script>var a = '<p>no</p>';</script><p>The.</p><form><p>Your name, please</p></form>"
        "<ul><li>first<li>second</ul><div class='ad'>Buy, buy, buy</div></div><aside><p>Side, bar</p></aside>"
        "<div class='comments'><p>I, for one, agree entirely with this, yes.</p></div><footer>(c)</footer></body></html>"
    )
    assert main_text(page) == f"Title & more\n{PLAIN}\nThe.\nfirst\nsecond"


def test_link_lists_lose_and_siblings_stay():
    links = "<div>" + "<p><a href=x>Some, long, linked, title of other pages</a></p>" * 20 + "</div>"
    page = f"<body>{links}<div><div>{BODY * 3}</div><div>{BODY * 2}</div></div></body>"
    assert main_text(page) == "\n".join([PLAIN] * 5)


def test_markup_faults():
    assert main_text("<article><p><b>a<br>b<p>c</article>") == "a b\nc"
    assert main_text("<article><p>a < b &lt;i&gt; &nbsp; x</p><!-- open <p>never") == "a < b <i> x"
    assert main_text("<p>cut off <a href='x") == "cut off <a href='x"
    assert main_text("<head><meta charset=x><p>body begins") == "body begins"
    assert main_text("no tags") == "no tags"
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<article>" + "<p>word, " * 20_000).count("\n") == 19_999
    assert main_text("<script>never closed <p>x</p>") == ""


def test_article_in_an_element_with_a_doubtful_name():
    for page in (
        f'<div class="content has-sidebar">{BODY * 3}</div><div class="sidebar"><p>Side, bar</p></div>',
        f'<form id="aspnetForm"><div class="header-bar">x</div><div>{BODY * 3}</div><input name=q></form>',
        f'<div class="article-social"><article>{BODY * 3}</article></div><div class="social-share"><p>Tell, your, friends</p></div>',
        f'<div class="post with-comments">{BODY * 3}<div class="comments"><p>I, for one, agree, yes.</p></div></div>',
        f'<body class="sidebar"><div id="main">{BODY * 3}<div class="related-posts"><p>More, of, the same</p></div></div></body>',
    ):
        assert main_text(page) == "\n".join([PLAIN] * 3), page


def test_long_comments_do_not_stand_for_the_article():
    page = f"<article>{BODY}</article><div class='comments'>{BODY * 9}</div><div class='comment-list'>{BODY * 2}</div>"
    assert main_text(page) == PLAIN


def test_bad_markup_in_linear_time():
    for unit in ('<a "', "<a b ", '<a ">" ', "<a '\">", "<!", "<script", "</script", '<div class="x', "< ", "<b>'\"", "</a '", "<p><", "<!-"):
        for tail in ("", ">", '">', "<p>end, of it</p>"):
            started = time.perf_counter()
            main_text(unit * 60_000 + tail)
            assert time.perf_counter() - started < 4, (unit, tail)


def test_unclosed_quotes():
    assert main_text('<p>one</p><p title="x>two</p><p>three</p>') == "one\ntwo\nthree"


def test_rows(spark):
    given = [(1, "u", None, "a"), (2, None, "", "b"), (3, "u", "<p>x</p>", "c"), (3, "u", "<p>x</p>", "c"), (None, "u", "<p>y é</p>", "d")]
    out = html_text.extract(spark.createDataFrame(given, "page_id bigint, url string, html string, text string"))
    rows = sorted([tuple(r) for r in out.collect()], key=str)
    assert rows == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "x", 1), (3, "u", "x", 1), (None, "u", "y é", 3)], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
