import pytest

from tallyhouse.llm import main_text as mt
from tests.llm.fixtures import key

ARTICLE = "<p>First paragraph with quite a few words in it.</p><p>Second &amp; last,\n one&nbsp;too.</p>"
TEXT = "First paragraph with quite a few words in it.\n\nSecond & last, one too."
PAGES = [
    (f"<html><body><nav><a href=/>Home</a></nav><div class=post-17>{ARTICLE}</div><footer>f</footer></body></html>", TEXT),
    (f"<html><body><div class='sidebar'><p>{'side ' * 90}</p></div><div class=post-18>{ARTICLE}</div><div id=comments><p>{'no ' * 90}</p></div>", TEXT),
    ("<html><body><div class=teaser><p>Much longer than what the article of this page has to say.</p></div><div class=post-3><p>Short.</p></div>", "Short."),
    ("<html><body><main><p>Another layout.</p></main></body></html>", "Another layout."),
    ("<script>var a = '</p>';</script><style>p{}</style><!-- <p>x</p> --><select><option>o</select>", ""),
    (None, ""), ("", ""), ("  \n ", ""), ("plain text", "plain text"),
]


def texts(spark, folder, pages):
    docs = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string, best int")
    return mt.main_texts(docs, folder).collect()


def test_pages_of_a_host_agree(spark, folder):
    pages = [(i, "http://a.test/x", html, "h", 1) for i, (html, _) in enumerate(PAGES)]
    assert {r.page_id: r.text for r in texts(spark, folder, pages)} == {i: t for i, (_, t) in enumerate(PAGES)}


def test_awkward_rows(spark, folder):
    pages = [(None if i % 3 else i, [None, "no scheme", "http://A.test"][i % 3], html, None, None) for i, (html, _) in enumerate(PAGES)]
    pages += pages[:2]
    rows = texts(spark, folder, pages)
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert sorted(map(key, [(r.page_id, r.url) for r in rows])) == sorted(map(key, [p[:2] for p in pages]))


def test_empty_table(spark, folder):
    assert texts(spark, folder, []) == []


@pytest.mark.parametrize("html, text", [
    ("<p>a<p>b<div>c<ul><li>d<li>e</ul></div>f", "a|b|c|d|e|f"),
    ("<p>a <b>b</b><i>c</i><br>d</p>", "a bc d"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b|c"),
    ("<p>a <span class=ad>X <b>Y</b></span>b</p>", "a b"),
    ("<p hidden>a</p><div role=search>b</div><p>c</p>", "c"),
    ("<p title='a > b'>c</p>", "c"),
    ("<p>1 < 2 & 3 > 2 &#233;&eacute;&notit;</p>", "1 < 2 & 3 > 2 éé¬it;"),
    ("</div></p><p>a</p></section>", "a"),
    ("<header>x</header><aside>y</aside><p>z</p><noscript>n</noscript>", "z"),
    ("<P>A</P><SCRIPT>b</ScRiPt ><p>c", "A|c"),
    ("<p", "<p"), ("<", "<"), ("<!-- a", ""), ("<script>a", ""),
    ("<pre>a\n  b</pre>", "a b"),
])
def test_blocks(html, text):
    assert [b.text for b in mt.parse(html).blocks] == [t for t in text.split("|") if t]


@pytest.mark.parametrize("html", ["<" * 30000, "<a " * 20000, "<!--" * 20000, '"<p "' * 10000, "<div>" * 3000 + "x", "&" * 30000, "<p>x" * 20000])
def test_broken_pages_end(html):
    mt.text_below(mt.parse(html), None)


def test_whole_table_against_its_template(spark):
    import html
    import re

    from tallyhouse.llm.queries import op7_main_text
    from tests.conftest import SMALL

    pages = dict(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect())
    for r in op7_main_text(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page, text", [
    ("<body><div class=ad>x</div><article><h1>T</h1><section class=intro><p>{3}</p></section><section class=body><p>{6}</p></section>"
     "<section class=end><p>{1}</p></section></article><p>Imprint of the house</p>", "T|{3}|{6}|{1}"),
    ("<body><article><h1>T</h1><p>{1}</p><div class=body><p>{3}</p><p>{3}</p></div></article>", "T|{1}|{3}|{3}"),
    ("<body><div class=a><h1>T</h1><div class=b><p>{6}</p></div><div class=c><p>{2}</p></div></div><div><a href=/>{9}</a></div>", "T|{6}|{2}"),
    ("<body><p>Imprint</p><main><h1>T</h1><article><p>{6}</p></article></main>", "T|{6}"),
])
def test_what_stands_beside_the_largest_section_stays(spark, folder, page, text):
    page, text = (s.format(*(f"part{i} " * 20 * i + "end" for i in range(10))) for s in (page, text))
    rows = texts(spark, folder, [(i, "http://a.test/", page, "h", 1) for i in range(2)])
    assert [r.text.split("\n\n") for r in rows] == [text.split("|")] * 2


LONG = "<p>" + "words of the article " * 20 + "end</p>"


@pytest.mark.parametrize("page, text", [
    (f"<div class='layout with-sidebar'>{LONG}</div>", LONG),
    (f"<main class=no-sidebar><h1>T</h1>{LONG}</main>", "<p>T</p>" + LONG),
    (f"<article class='post tag-social category-alert'>{LONG}</article>", LONG),
    (f"<div id=search-result-page><div class=ad>x</div>{LONG}</div>", LONG),
    (f"<form id=f><div class=menu>m</div>{LONG}</form><p>Imprint</p>", LONG + "<p>Imprint</p>"),
    (f"<form><div class=banner><h1>T</h1></div>{LONG}</form>", "<p>T</p>" + LONG),
    (f"<div class=modal><div class=overlay>{LONG}</div></div>", LONG),
    (f"<article><p>Short.</p></article><div id=comments><article>{LONG}</article></div>", "<p>Short.</p>"),
    (f"<p>Short.</p><div class=sidebar>{LONG}</div><form>f</form>", "<p>Short.</p>"),
    (f"<div hidden><h1>T</h1>{LONG}</div><header><h1>T</h1></header>", ""),
    (f"<div class=modal><span class=overlay><i>{LONG}</i></span></div>", LONG),
])
def test_no_name_drops_the_text_of_a_page(page, text):
    assert [b.text for b in mt.parse(page).blocks] == [t.removeprefix("<p>") for t in text.split("</p>")[:-1]]


@pytest.mark.parametrize("size", [1, 5, 30, 199, 200, 2000])
@pytest.mark.parametrize("layout", [
    "<form><p>{}</p></form>", "<div class=related><p>{}</p></div>", "<form><input type=hidden><p>{}</p></form><header>Site</header>",
    "<body><div class=comments><div class=ad>{}</div></div>", "<form><input type=search><p>{}</p></form>",
])
def test_length_decides_nothing(layout, size):
    """Whatever the text of a page stands in, it is read alike at every length."""
    text = ("word " * size)[:size].strip() or "w"
    assert mt.text_below(mt.parse(layout.format(text)), None) == text


@pytest.mark.parametrize("size", [1, 10, 60])
@pytest.mark.parametrize("extra", [
    "<form><p>Subscribe to our newsletter and never miss a thing</p><input type=email></form>", "<div class=user-comments><p>I agree with all of it</p></div>",
    "<div class=ad-box>Buy now and save</div>", "<div id=cookie-banner><p>We use cookies on this site</p></div>", "<div class='site-footer x'>Imprint</div>",
    "<ul class=main-nav><li>Home</ul>", "<div class=newsletter-signup>Join</div>", "<div class=page__sidebar>Links</div>",
])
def test_compound_names_are_no_text(extra, size):
    text = "Short " * size + "end."
    page = f"<body><div class=content><p>{text}</p>{extra}</div></body>"
    assert mt.text_below(mt.parse(page), None) == text


@pytest.mark.parametrize("name", ["no-sidebar", "with-comments", "section-header", "post-notice", "navigate", "commentary", "adverb", "menus-of-rome", "x-y"])
def test_names_that_say_nothing(name):
    page = f"<body><article><h1>T</h1><div class={name}><p>One.</p></div><p>Two.</p></article></body>"
    assert mt.text_below(mt.parse(page), None) == "T\n\nOne.\n\nTwo."


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div>x" * 30_000, "<ul><li>x" * 20_000, "<div><a>" * 20_000 + "</b>" * 20_000 + "y",
                                  "<div class=a-b-c-d>x</div>" * 20_000, "<form><p>x" * 5_000])
def test_deep_pages_take_time_and_memory_by_their_length(page):
    import time
    import tracemalloc

    began = time.process_time()
    read = mt.parse(page)
    mt.text_below(read, mt.best_path(read)[0])
    mt.text_below(mt.parse(page), None)
    assert time.process_time() - began < 6  # two readings, and the machine may be slow
    tracemalloc.start()
    mt.parse(page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_very_long_page():
    page = "<body><nav>n</nav><article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(40_000)) + "</article>"
    assert len(page) > 1_000_000
    assert len(mt.text_below(mt.parse(page), None).split("\n\n")) == 40_000
