import html
import re
import time
from collections import Counter

import duckdb
import pytest

from quire.llm import html_extract
from quire.llm.html_extract import extract_pages, main_text

PROSE = "This is the first paragraph of the article and it is long enough to be decided by the rules."
MORE = "And this is another one that was written for the test, with all of the words that it needs."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        (f"<nav><a href=x>{PROSE}</a></nav><p>{PROSE}</p><p>Short.</p><p>{MORE}</p><footer>{PROSE}</footer>", f"{PROSE}\nShort.\n{MORE}"),
        (f"<article><h1>Title</h1><p>{PROSE}<p>One &lt;b&gt; &amp; &eacute;&#8364;&nbsp;x</article><div>{MORE}</div>", f"Title\n{PROSE}\nOne <b> & é€ x"),
        (f"<article><p>zz qq</article><nav>{PROSE}</nav>", "zz qq"),
        (f"<article><p>{PROSE}</p><div class='comments'><p>{MORE}</p></div><aside>{MORE}</aside></article>", PROSE),
        (f"<h1>Head</h1><p>{PROSE}</p><div id=sidebar>{MORE}</div><div class='cookie-notice'>{MORE}</div><form>{MORE}</form><div class='ad'>{MORE}</div>", f"Head\n{PROSE}"),
        (f"<script>var t='<p>{MORE}</p>';</script><style>p{{}}</style><!-- <p>{MORE}</p> --><p>{PROSE}</p>", PROSE),
        (f"<p>{PROSE}</p><script>never closed {MORE}", PROSE),
        (f"<p>{PROSE} a < b and c &am", f"{PROSE} a < b and c &am"),
        (f"<p>{PROSE}</p><p", PROSE),
        (f"<p>{PROSE[:40]}\n\t  {PROSE[40:]}<br>{MORE}</p>", f"{PROSE[:40].rstrip()} {PROSE[40:].lstrip()} {MORE}"),
        (f"<p>{PROSE}</p><ul><li><a href=a>Home page of this site</a></li><li><a href=b>All of the news</a></li></ul><p>{MORE}</p>", f"{PROSE}\n{MORE}"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_generated_articles():
    """Whatever stands in the pages' article, and nothing else, block by block."""
    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for page in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside[1])]
        assert main_text(page) == "\n".join(b for b in blocks if b)


def pages_without_containers():
    strip = re.compile(r"</?(?:article|main)\b[^>]*>", re.I)
    return [(h, strip.sub("", h)) for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]


def test_rules_find_the_article_where_no_tag_marks_it():
    lost = false = total = 0
    for page, bare in pages_without_containers():
        want, got = (Counter(t.split("\n")) for t in (main_text(page), main_text(bare)))
        lost, false, total = lost + (want - got).total(), false + (got - want).total(), total + want.total()
    assert lost <= 0.05 * total and false <= 0.01 * total


@pytest.mark.parametrize(("rule", "off"), [("MANY_STOPS", 0.0), ("MANY_STOPS", 2.0), ("FEW_STOPS", 2.0), ("MOST_LINKS", 9.0), ("SHORT", 0)])
def test_each_rule_decides_something(monkeypatch, rule, off):
    names = "<p>zwei drei vier</p>" + "<p>Katze Hund Maus Pferd Kuh Schwein Huhn Ziege Schaf Ente Gans Esel Taube</p>"
    links = "<ul>" + "".join(f"<li><a href=a>{PROSE} {i}</a></li>" for i in range(3)) + "</ul>"
    thin = "<p>" + "Katze Hund Maus der Pferd Kuh Esel Schwein " * 8 + "</p>"
    page = links + names + "<p>a b</p>" + f"<p>{PROSE}</p>" + links + "<p>up to it</p>" + links + thin + links
    before = main_text(page)
    monkeypatch.setattr(html_extract, rule, off)
    assert main_text(page) != before


def test_a_form_around_the_page_is_a_container_and_others_are_not():
    body = f"<h1>Head</h1><p>{PROSE}</p><p>{MORE}</p>"
    assert main_text(f"<body><form action=x><nav><a href=y>{PROSE}</a></nav>{body}</form></body>") == f"Head\n{PROSE}\n{MORE}"
    assert main_text(f"<body><form action=x><article>{body}</article><p>{MORE}</p></form></body>") == f"Head\n{PROSE}\n{MORE}"
    assert main_text(f"{body}<form><p>{MORE}</p></form>") == f"Head\n{PROSE}\n{MORE}"


HOSTILE = {
    "open spans, stray ends": "<span>" * 20_000 + "</b>" * 200_000, "options": "<option>x" * 100_000, "buttons": "<button>x " * 100_000, "quotes": '<a href="x> ' * 90_001, "signs": "<" * 1_000_000,
    "comments": "<!--" * 250_000, "ends": "</p>" * 250_000, "references": "&amp" * 250_000, "attributes": "<div " + "class= " * 150_000 + ">x", "textareas": "<textarea>" * 100_000, "breaks": "<br>" * 250_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    began = time.thread_time()
    main_text(HOSTILE[kind])
    assert time.thread_time() - began < 2


def test_query(spark, clashing):
    rows = [(1, "u", f"<p>{PROSE}</p>"), (1, "u", f"<p>{PROSE}</p>"), (None, None, None), (2, "v", f"<article><p>{'the word of ' * 40_000}</article>")]
    got = extract_pages(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(PROSE)), (1, len(PROSE)), (2, 12 * 40_000 - 1)]
    assert all(len(r.text) == r.n_chars for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
