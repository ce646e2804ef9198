from __future__ import annotations

import random
import re
import time
from html import unescape

from pyspark.sql import functions as F

from logwarden.llm import html_text, queries
from logwarden.llm.html_text import Page, extract


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def article_of(html):
    """The marked article of the given pages, by cutting the markup up."""
    inside = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", inside[1])) if inside else []
    texts = (" ".join(unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_query_finds_the_articles_of_the_whole_table(spark, sf_dir):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op10_html(spark, sf_dir).collect()
    assert len(got) == len(html)
    for r in got:
        assert r["text"] == article_of(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home page-12">
<header><a href=/>Logo</a> Site &amp; name</header><nav><ul><li><a href=/a>Menu one<li>Menu two</ul></nav>
<div id=cookie-notice>We use cookies, long and longer text about cookies and consent.</div>
<div class="wrap col-9"><div class="post-body7"><h1>Big &lt;title&gt;</h1><p>First   paragraph, with <b>bold</b>
words.<p>Second<br>line &#8212; caf&eacute;.<ul><li>one<li>two</ul><script>var a="</p>";</script>
<table><tr><td>cell a<td>cell b</table><div class="share-buttons">Share!</div><!-- note --><form><input>Send</form></div>
<aside>Read this too</aside><section class=comments><p>A reader says a very long thing about all of this here.</p></section></div>
<footer>&copy; 2024</footer></body></html>"""
TEXT = ("Big <title>\nFirst paragraph, with bold words.\nSecond line — café.\none\ntwo\ncell a\ncell b")


def test_a_page_with_all_kinds_of_boilerplate():
    assert extract(PAGE) == TEXT
    page = Page(PAGE)
    assert page.path(page.best()) == "#>html>body.home.page>div.col.wrap>div.post-body"


def test_headers_of_pages_go_and_those_of_articles_stay():
    html = ("<body><div class=site-header>Name and claim</div><div class='alert alert-info'>Notice</div><main>"
            "<article><header><h1>Title</h1></header><div class=article-body><p>Text of it.</p></div>"
            "<footer>About the author</footer></article><div id=comments><p>Long reader comment here</p></div></main></body>")
    assert extract(html) == "Title\nText of it."
    plain = "<body><div class=header>Name</div><div class=post><div class=post-header><h1>T</h1></div><p>Body text.</p></div></body>"
    assert extract(plain) == "T\nBody text."


def test_hosts_agree_on_a_path(spark):
    long, short = "words and more words. " * 20, "tiny text"
    normal = f"<body><div class=top1>{short}</div><div class=text2><p>{long}</p></div></body>"
    odd = f"<body><div class=top1>{'a teaser of some length '* 3}</div><div class=text3><p>brief article here and now</p></div></body>"
    rows = [(k, "https://u:p@Host.example:80/x", normal) for k in range(5)] + [(9, "http://host.example/y", odd)]
    rows += [(10, "http://other.example/y", odd), (11, None, odd)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages_of(spark, rows)).collect()}
    assert got[0] == " ".join(long.split()) and got[9] == "brief article here and now"
    assert got[10] == got[11] == " ".join(("a teaser of some length " * 3).split())
    assert [tuple(r) for r in html_text.winners(pages_of(spark, rows)).where("host = 'host.example'").collect()] == [
        ("host.example", "#>body>div.text")]


def test_edge_pages(spark):
    rows = [(1, "http://a/", None), (1, "http://a/", None), (2, None, ""), (None, "no url", "just text &amp more &am"),
            (3, "http://a/", "<p>open <b>tags <i>never closed<div>next"), (4, "http://a/", "<<>> < 3 <a <p>x"),
            (5, "http://a/", "<script>only</script><nav>menu</nav>"), (6, "http://a/", "<div>" * 3000 + "deep"),
            (7, "http://b/", "<p>" + "long words " * 50_000), (8, "http://d/", "<article>one</article></div></p><article>longer two</article>"),
            (9, "http://b/", "<p title='a>b' hidden>no</p><p title=\"x>y\">yes</p>"), (10, "http://c/", "<!-- open <p>x")]
    pages = pages_of(spark, rows).withColumns({n: F.lit(1) for n in ("host", "path", "text", "score")})
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    want = {1: "", 2: "", None: "just text & more &am", 3: "open tags never closed\nnext", 5: "", 6: "deep", 8: "longer two",
            9: "yes", 10: ""}
    assert {k: got[k]["text"] for k in want} == want
    assert got[7]["n_chars"] == 11 * 50_000 - 1
    assert html_text.main_text(pages_of(spark, [])).count() == 0


def test_a_class_does_not_hide_most_of_a_page():
    assert extract(f"<body><div class='comment page'><p>{'all of the text ' * 9}</p></div><p>x</p></body>").startswith("all of")
    assert extract("<body><div class=ad>a long advert, longer than the article</div><article>short</article>") == "short"


def test_text_dealt_over_containers_is_whole(spark):
    a, b, c = "first part of it. " * 60, "second part. " * 20, "third one. " * 10
    whole = "\n".join(" ".join(t.split()) for t in (a, b, c))
    menu = "<div class=left><a href=/1>one link of many</a> <a href=/2>another link</a></div>"
    for page in (f"<div class=page><div class=part>{a}</div><div class=part>{b}</div><div class=part>{c}</div></div>",
                 f"<div class=page><div class=intro>{a}</div><div class=details>{b}</div><p>{c}</p></div>",
                 f"<div class=post><section>{a}</section><section>{b}</section><section>{c}</section></div>",
                 f"<div class=part1>{a}</div>{menu}<div class=part2>{b}</div><div class=part3>{c}</div>"):
        assert extract(f"<body>{page}</body>") == whole, page
    equal = "".join(f"<section>{a}</section>" for _ in range(5))
    one = f"<body><div class=page><section>{a}</section></div></body>"
    rows = [(k, "http://h/x", one) for k in range(9)] + [(9, "http://h/y", f"<body><div class=page>{equal}</div></body>")]
    rows += [(10, "http://h/z", f"<body><div class=page><section>{b}</section><div class=end>{a}</div></div></body>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages_of(spark, rows)).collect()}
    assert got[9] == "\n".join([" ".join(a.split())] * 5) and got[0] == " ".join(a.split())
    assert got[10] == " ".join(b.split()) + "\n" + " ".join(a.split())


def test_attributes_are_read_whole():
    for attributes in ('data-hidden="false"', 'title="the hidden cost"', 'style="overflow:hidden !important"', "style=overflow:hidden",
                       'data-class="menu"', "data-id=footer", 'title="a role=menu b"', 'class=post class=menu'):
        assert extract(f"<body><div {attributes}>all of the text</div><p>and more</p></body>").startswith("all of the text"), attributes
    for attributes in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "role = menu", 'title="x"hidden', "data-x=1 hidden"):
        assert extract(f"<body><div {attributes}>a long text that is not shown</div><p>shown</p></body>") == "shown", attributes
    assert Page("<div data-class=x class='post 9' id=y>t</div>").label[1] == "div.post"


LONG = "words of the article, and more of them. " * 8


def test_a_form_around_the_page_is_no_form():
    text = " ".join(LONG.split())
    fields = "<label>Name</label><input name=a><select><option>one<option>two</select><button>Send</button>"
    for inner in (f"<article><p>{LONG}</p></article>", f"<div class=page><p>{LONG}</p></div>"):
        assert extract(f"<body><form id=aspnetForm>{fields}<nav><a href=/>menu</a></nav>{inner}</form></body>") == text
    assert extract(f"<body><article><p>{LONG}</p><form>Your name {fields} please</form></article></body>") == text


def test_phrases_that_are_left_out_leave_their_paragraph():
    for phrase in ("<button>Copy</button>", "<label>Name</label>", "<select><option>one</select>", "<span hidden>secret</span>",
                   "<a role=navigation>next</a>", "<span class=advert>buy</span>", "<span style='color:red; display: none'>x</span>",
                   "<b aria-hidden=true>x</b>"):
        for tag in ("article", "div class=post"):
            html = f"<body><{tag}><p>One {phrase} two.</p><p>{LONG}</p></{tag.split()[0]}></body>"
            assert extract(html) == "One two.\n" + " ".join(LONG.split()), phrase
    assert extract(f"<body><article><p class=ad>AD</p><p class=comment-ish>{LONG}</p></article></body>") == " ".join(LONG.split())


def test_doubtful_classes_within_an_article():
    text = " ".join(LONG.split())
    links = "<ul><li><a href=/1>one link</a><li><a href=/2>another link</a></ul>"
    for name in ("search-results", "related-work", "text notice-period"):
        assert extract(f"<article><p>{LONG}</p><div class='{name}'><p>Part of it.</p></div></article>") == f"{text}\nPart of it.", name
        assert extract(f"<article><p>{LONG}</p><div class='{name}'>{links}</div></article>") == text, name
    for name in ("comments", "share-buttons", "notice", "alert alert-info", "cookie-notice", "related", "newsletter-box"):
        assert extract(f"<article><p>{LONG}</p><div class='{name}'><p>No part of it.</p></div></article>") == text, name


def test_hidden_styles():
    for style in ("display:none", "DISPLAY : none;", "margin:0;visibility:hidden"):
        assert extract(f"<body><p>{LONG}</p><div style='{style}'>not shown</div></body>") == " ".join(LONG.split())
    assert extract(f"<body><p style='overflow:hidden;display:block'>{LONG}</p></body>") == " ".join(LONG.split())


def test_deep_and_broken_pages_take_linear_time():
    """A megabyte each, in seconds."""
    deep = 60_000
    for html in ("<div><p>word " * deep, "<div><p>word</p>" * deep + "</div>" * deep, "<b>x" * deep + "<p>y</p>" * deep,
                 "<div>" * deep + "</p>x</span>" * deep, "<article><div class=a>x " * (deep // 2), "<form><p>x" * deep,
                 "<ul><li>x" * deep, "<table><tr><td>x" * (deep // 2), "<div class=related>x" * deep):
        begin = time.perf_counter()
        extract(html, "#>html>body>div")
        assert time.perf_counter() - begin < 8, html[:40]


def page_without_marks(k, path, size):
    """A page with boilerplate of all kinds and an article in plain divs; and the article's text."""
    rng = random.Random(k)
    words = lambda n: " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=n))
    parts = [words(size) + "." for _ in range(3)]
    teasers = "".join(f"<p>{words(30)}.</p><a href=/{j}>{words(4)}</a>" for j in range(4))
    body = "".join(f"<p>{p}</p>" for p in parts)
    html = (f"<html><body><div class=top{k}><a href=/>{words(3)}</a> {words(2)}</div><ul class=main-menu><li><a href=/x>{words(2)}</a></ul>"
            f"<div class='{path}'>{body}<span class=sponsored>{words(3)}</span></div>"
            f"<div class=latest>{teasers}</div><div class=footer>{words(20)}</div></body></html>")
    return html, "\n".join(parts)


def test_hosts_votes_decide_where_no_article_is_marked(spark):
    """Long articles win on their pages; on pages with a short one the teasers would, were it not for the host."""
    rows, want, alone = [], {}, 0
    for k in range(60):
        host = f"http://host{k % 3}.example/{k}"
        html, text = page_without_marks(k, ("entry-text", "x9 col", "c-lead")[k % 3], 150 if k % 5 else 14)
        rows.append((k, host, html))
        want[k] = text
        alone += extract(html) != text
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages_of(spark, rows)).collect()}
    assert alone == 12, "the vote should decide something"
    assert got == want
