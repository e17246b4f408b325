import html
import re

import pytest

from tests.llm.conftest import rows_of
from tidewatch.llm.html_text import extract, main_text
from tidewatch.llm.registered import op5_page_text

BODY = "This is the main text of the page, with enough words in it to be a paragraph. "


def page(inner, before="", after=""):
    return (f"<html><head><title>Title</title><style>p{{}}</style></head><body>"
            f"<nav><ul><li><a href='/'>Home</a></li></ul></nav>{before}<article>{inner}</article>"
            f"{after}<footer>&copy; Site</footer></body></html>")


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("   ", ""), ("<nav><a href=x>Menu</a></nav>", ""),
    (page(f"<h1>Head</h1><p>{BODY}</p><p>Short.</p>"), f"Head\n{BODY.strip()}\nShort."),
    (page(f"<p>{BODY}<p>Two &amp; &#233;&nbsp; x<br>y"), f"{BODY.strip()}\nTwo & é x y"),
    (page(f"<p>{BODY}</p><aside>Side</aside><form>Name <input></form><script>x='</p>'</script>"
          "<div class='ad banner'>Buy</div><section id=comments><p>First!</p></section>"),
     BODY.strip()),
    (page(f"<p>{BODY}</p>", before="<div class='cookie-notice'><p>We use cookies</p></div>",
          after="<div class='comments'><p>Nice one</p></div>"), BODY.strip()),
    (f"<body><div id=menu><a href=a>a</a></div><div><p>{BODY}</p><p>Tiny</p></div>",
     f"{BODY.strip()}\nTiny"),
    ("just words without any tag", "just words without any tag"),
    (page("<p>" + "long " * 50_000 + "</p>"), ("long " * 50_000).strip()),
    (page(f"<p><b>{BODY}<i>open <p>Next<table><tr><td>a<td>b<tr><td>c</table>"),
     f"{BODY.strip()} open\nNext\na b\nc"),
])
def test_pages(source, want):
    assert main_text(source) == want


def plain(source):
    """The given tables hold one article a page."""
    body = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split())
                                 for p in parts) if t)


def test_table(spark, folder):
    source = {r["page_id"]: r["html"] for r in
              spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op5_page_text(spark, folder).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r["text"] == plain(source[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, None, "x"), (1, "u", page(f"<p>{BODY}</p>"), "x"), (None, "u", "", "x"),
         (1, "u", page(f"<p>{BODY}</p>"), "x")], "page_id long, url string, html string, text string")
    text = BODY.strip()
    assert rows_of(extract(df)) == sorted(
        [(1, None, "", 0), (None, "u", "", 0)] + [(1, "u", text, len(text))] * 2, key=repr)
    assert extract(df.limit(0)).count() == 0


P = f"<p>{BODY}</p>"
T = BODY.strip()


@pytest.mark.parametrize("source,want", [
    (f"<body><div class='layout has-sidebar'><article>{P}<p>Short.</p></article>"
     "<div class=sidebar><p>Side</p></div></div></body>", f"{T}\nShort."),
    (f"<body><div id='page-header-and-body'><div class=menu><a href=a>a</a></div>{P}{P}</div></body>",
     f"{T}\n{T}"),
    (f"<body><article class='post no-comments'><h1>Head</h1>{P}</article></body>", f"Head\n{T}"),
    (f"<main><div class='layout has-sidebar'>{P}<p>Short.</p></div></main>", f"{T}\nShort."),
    # What stands beside an article is still left out, also where it is longer or has articles.
    (page(P, after=f"<section id=comments><article class=comment>{P[:60]}</article></section>"), T),
    (page("<p>A short article, but an article.</p>", before=f"<div class=cookie-notice>{P}{P}</div>"),
     "A short article, but an article."),
    (f"<body>{P}<div hidden>{P * 5}</div></body>", T),
])
def test_marked_wrappers(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source,want", [
    (f"<div id=content><section>{P * 3}</section><section><h2>More</h2><ul><li>one<li>two</ul>"
     "</section></div>", None),
    (f"<div id=content><section>{P * 3}</section><section><h2>More</h2>{P}<ul><li>one<li>two</ul>"
     "</section></div>", f"{T}\n{T}\n{T}\nMore\n{T}\none\ntwo"),
    (f"<main><h1>Title</h1><article>{P}</article></main>", f"Title\n{T}"),
    (f"<body><div><article>{P}</article><h2>Next</h2><article>{P}<p>End</p></article></div></body>",
     f"{T}\nNext\n{T}\nEnd"),
])
def test_all_of_the_region(source, want):
    assert main_text(source) == (want or f"{T}\n{T}\n{T}\nMore\none\ntwo")


C = "<p>A reader writes at length about the article and about what others have written on it.</p>" * 20


@pytest.mark.parametrize("source,want", [
    (f"<article>{P}<section id='comments'>{C}</section></article>", T),
    (f"<article>{P}<div class='comments'>{C}</div></article>", T),
    (f"<body><div id='story'>{P}</div><div class='comments'>{C}</div></body>", T),
    (f"<body><div id='story'>{P}</div><div class=comments><article class=comment>{C}</article></div></body>", T),
    (f"<body><div class=post>{P}<ol class=commentlist><li>{C}</ol></div></body>", T),
    (f"<article><p>One short sentence.</p><div class='newsletter box'>{P * 3}</div></article>",
     "One short sentence."),
    (f"<body><div class='page'>{P}<div class='comments-area comment-list-2'>{C}</div></div></body>", T),
    (f"<article class='comments-open post'>{P}<div class='ad-slot'>{C}</div></article>", T),
    # Code is full of comments that are its own.
    (f"<article>{P}<pre><span class='comment'># why</span> x = 1</pre></article>", f"{T}\n# why x = 1"),
])
def test_foreign_text_is_never_returned(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("bad", ["<![foo[ x ]]>", "<![endif]-->", "<!>", "<!doctype", "<![", "<!ELEMENT x", "</>",
                                 "<?php x ?>", "&#xFFFFFFFF;", "&#0;", "<a b='", "<![CDATA[ x > ]]>", "<!-->"])
def test_broken_markup_loses_no_text(bad):
    assert T in main_text(f"<body><article>{P}{bad}</article><article>{P}</article></body>")
    main_text(bad)


def test_any_string():
    import random
    draw = random.Random(5)
    parts = ["<", ">", "!", "[", "]", "&", "#", ";", "-", "/", "'", '"', "=", " ", "a", "p", "div", "script", "article",
             "class=", "comments", "x" * 30, "\n", "\0", "é", "--", "?", "CDATA", "svg"]
    for _ in range(10_000):
        main_text("".join(draw.choice(parts) for _ in range(draw.randrange(40))))


def test_a_page_of_20_mb():
    text = main_text(page("".join(f"<p>{BODY}{i}</p>" for i in range(220_000)) + "<![x[ " + "< " * 1000))
    assert text.count("\n") >= 219_999 and len(text) > 17_000_000
