import html
import re
import time

import pytest

from quarrymill.llm.html_density import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>no</article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div><div id="cookieBanner">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br>goes on.<br><p>Second&nbsp;paragraph with a <a href="x">link</a> in it.</p>
<form>Name <input></form><ul><li>one<li>two</ul><div class="comments"><p>Reader says hello</p></div><p>Third &lt;tag&gt;.</p></article>
<aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_article_without_boilerplate():
    assert main_text(PAGE) == "Title & more\nFirst line goes on.\nSecond paragraph with a link in it.\none\ntwo\nThird <tag>."


def test_densest_subtree_without_semantic_tags():
    body = "".join(f"<p>{'Some longer sentence of the text. ' * 6}{i}</p>" for i in range(5))
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><div>{body}</div></div><div><a href=4>four</a></div></body>"
    assert main_text(page).count("\n") == 4 and "four" not in main_text(page) and "one" not in main_text(page)


def test_wrappers_are_kept_and_comments_are_not():
    article = "<article class='post has-sidebar'><p>Body of the text.</p><div id='comments'><article class='comment'><p>no</p></article><article><p>no</p></article></div></article>"
    assert main_text(f"<body><div class='layout with-sidebar'><div class='sidebar'>side</div>{article}</div></body>") == "Body of the text."
    plain = "<div class='page has-sidebar'>" + "<p>A sentence that belongs to the text of the page.</p>" * 3 + "<div class='sidebar'>side words</div></div>"
    assert main_text(f"<body>{plain}<div class='cookie-notice'>We use cookies</div></body>") == "\n".join(["A sentence that belongs to the text of the page."] * 3)
    assert main_text("<body><main><p>text</p><section class='replies'><p>no</p></section><div hidden>x</div><div role=navigation>y</div></main></body>") == "text"


@pytest.mark.parametrize(
    "page,text",
    [(None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"), ("<p>a < b", "a < b"), ("<p>x<!-- open", "x"), ("<script>x", ""), ("<p>&am &#233; &eacute;", "&am é é"), ("<div " * 50, None), ("<p>a</p></p></div><p>b", "a\nb")],
)
def test_edges(page, text):
    got = main_text(page)
    assert text is None or got == text


def test_deep_and_long():
    assert main_text("<div>" * 5000 + "x" * 100_000 + "</div>" * 5000) == "x" * 100_000


def test_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "extra"), (2, None, None, "e"), (2, None, None, "e"), (None, "u", "<p>é", None)], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.n_chars, r.text) for r in extract(rows).collect()))
    assert [g[:2] for g in got] == [(0, 1), (1, len(main_text(PAGE))), (2, 0), (2, 0)]
    assert extract(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        extract(rows.drop("html"))


@pytest.mark.parametrize(
    "markup",
    [
        "<a" * 500_000, '<a "' * 250_000, '<a "' * 250_000 + ">", "<a x=\"1\" '" * 90_000 + ">", "</x>" * 250_000, "<div>" * 100_000 + "</x>" * 100_000, "<i><article>" + "<div>" * 50_000 + "</i>" * 150_000,
        "<p>" + "<b>" * 120_000 + "<hr>" * 120_000, "<ul>" + "<b>" * 100_000 + "<li>" * 100_000, "<table>" + "<td>" * 100_000, "<!-- " * 200_000, "<!" * 500_000, "&" * 1_000_000, "&#" + "9" * 1_000_000, "<script>" * 100_000,
        "<div " + "class=" * 160_000 + ">x", "<div class" + " " * 1_000_000 + ">x", '<div class="' + "has-a " * 160_000 + '">x',
    ],
)
def test_a_broken_page_takes_time_in_proportion(markup):
    def seconds(page):
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    assert seconds(markup) < max(1.0, 30 * seconds(markup[: len(markup) // 10])) and seconds(markup) < 15


def test_references():
    assert main_text("<p>&#00065;&#x0042;&#" + "9" * 5000 + ";&#xD800;&am<b>p;</b>&am<!-- -->p; x&lt;b&gt;y") == "AB��&amp;&amp; x<b>y"


TEXT = "".join(f"<p>{'Some longer sentence of the text. ' * 9}{i}</p>" for i in range(10))
LINES = [f"{'Some longer sentence of the text. ' * 9}{i}" for i in range(10)]
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Another story {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("outer", ["article", "main", "section", "div", None])
def test_headings_and_paragraphs_beside_the_core_stay(outer):
    inner = f"<h1>Ten chars!</h1><p>A lead of the text.</p><div class='body'>{TEXT}</div><p>The end.</p>"
    inner = f"<{outer} class='post'>{inner}</{outer}>" if outer else f"<div>{inner}</div>"
    page = f"<body><div id='page'><nav>menu</nav><div class='top'>{LINKS}</div>{inner}<div><h3>More</h3>{LINKS}</div><footer>(c)</footer></div></body>"
    assert main_text(page).split("\n") == ["Ten chars!", "A lead of the text.", *LINES, "The end."]


def test_names_are_penalties():
    page = f"<body><article><header><h1>Title</h1></header><p class='related'>Related work.</p><div class='notice-board'>{TEXT}</div><div class='notice'>Read the rules.</div><p class='ad'>Buy.</p><footer>by me</footer></article></body>"
    assert main_text(page).split("\n") == ["Title", "Related work.", *LINES]
    assert main_text(f"<body><div class='hentry has-comments comments-open no-sidebar'>{TEXT}</div><div class='comment-list'><p>{'words of a reader ' * 400}</p></div></body>").split("\n") == LINES
    assert main_text(f"<body><header><h1>Site</h1></header><div class='story'><header><h1>Title</h1></header>{TEXT}</div></body>").split("\n") == ["Title", *LINES]


def test_pages_without_their_semantic_elements(spark):
    """What the article element holds comes out the same when the element is replaced, removed or wrapped."""
    comments = "<div id='comments'><h3>2 comments</h3><div class='comment'><p>I think this is great and has a lot of words.</p></div></div>"
    ways = [
        lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>"),
        lambda h: h.replace("<article>", "").replace("</article>", ""),
        lambda h: h.replace("<article>", "<div id='wrap'><div class='layout has-sidebar'><div class='post'>").replace("</article>", f"</div><div><h3>More</h3>{LINKS}</div></div></div>"),
        lambda h: h.replace("<article>", "<div class='post'>").replace("</h1>", "</h1><div class='text'>", 1).replace("</article>", f"</div>{comments}</div>"),
    ]
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        inside = re.split(r"</?(?:p|h1|h2|ul|li|div)[^>]*>", inside.replace("<br>", " "))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in inside]
        want = "\n".join(b for b in want if b)
        assert [main_text(way(r.html)) == want for way in [str, *ways]] == [True] * 5


def test_attributes_are_whole_names():
    parts = ["<p title='The hidden valley'>one</p>", '<p data-hidden="false">two</p>', "<section data-id='sidebar'><p>three</p></section>", "<p data-x=\"class='ad' hidden\">four</p>", "<p HIDDEN>no</p>", "<p hidden='' >no</p>", "<div class = sidebar>no</div>", "<div Class=\"x  menu\">no</div>"]
    assert main_text(f"<body><article><h1>Title</h1>{TEXT}{''.join(parts)}</article></body>").split("\n") == ["Title", *LINES, "one", "two", "three", "four"]


def test_forms_that_hold_the_article():
    page = "<body><form id='aspnetForm' method=post><input type=hidden><div id='top'>{}</div><div id='main'>{}</div><div class='foot'>{}</div><label for=q>Find</label><input id=q></form></body>"
    search = "<form role=search><label>Search for</label><input><p>Type a word.</p></form>"
    for inner in (f"<article><h1>Title</h1>{TEXT}</article>", f"<div class='story'><h1>Title</h1>{TEXT}</div>"):
        assert main_text(page.format(LINKS, inner, LINKS)).split("\n") == ["Title", *LINES]
        assert main_text(f"<body>{inner.replace(LINES[3] + '</p>', LINES[3] + '</p>' + search)}</body>").split("\n") == ["Title", *LINES]
    assert main_text("<body><article><p>A <label>labelled</label> word.</p><form><label>Name</label><input></form></article></body>") == "A labelled word."


def test_words_in_compound_names_are_no_proof():
    sections = "".join(f"<section {kind}='{name}'><p>Words under {name}.</p></section>" for kind, name in (("id", "side-effects"), ("class", "the-search"), ("class", "social-history"), ("id", "menuPlanning")))
    gone = "".join(f"<div class='{name}'><p>No words.</p></div>" for name in ("side-bar", "search-box", "social-links", "related-posts", "footer-widgets", "site-header2", "nav"))
    assert main_text(f"<body><article><h1>Title</h1>{TEXT}{sections}{gone}</article></body>").split("\n") == ["Title", *LINES, *(f"Words under {n}." for n in ("side-effects", "the-search", "social-history", "menuPlanning"))]


@pytest.mark.parametrize("thread", ["<ol class='thread'>{}</ol>", "<div><h3>What people say</h3>{}</div>", "<ul>{}</ul>"])
def test_reader_threads_go_however_long(thread):
    item = "div" if "h3" in thread else "li"
    said = "".join(f"<{item}><span class='user'>Ann {i}</span> <time>today</time><p>{'I have read this and say so. ' * 20}</p></{item}>" for i in range(6))
    said = thread.format(said)
    post = TEXT[: len(TEXT) // 5]
    for inner in (f"<article><h1>Title</h1>{TEXT}</article>{said}", f"<article><h1>Title</h1>{TEXT}{said}</article>", f"<div class='post'><h1>Title</h1>{TEXT}</div>{said}", f"<div class='post'><h1>Title</h1>{TEXT}{said}</div>"):
        assert main_text(f"<body>{inner}</body>").split("\n") == ["Title", *LINES]
    assert "say so" not in main_text(f"<body><article><h1>Title</h1>{post}</article>{said}</body>")
    # dates alone make no thread
    dated = "".join(f"<li><time>19{i}0</time>: something happened</li>" for i in range(4, 8))
    assert main_text(f"<body><article>{TEXT}<ul>{dated}</ul></article></body>").count("something happened") == 4


def test_teasers_beside_the_article():
    teaser = f"<article class='teaser'><h2>Another</h2><p>{'A lead of another story. ' * 20}</p></article>"
    assert main_text(f"<body><div>{teaser}<article><h1>Title</h1>{TEXT}</article>{teaser}</div></body>").split("\n") == ["Title", *LINES]
