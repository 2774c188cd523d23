"""Main text of pages where no element says it is the article, where several do, and of broken markup."""

import re
import time

import pytest

from packloom.llm.text_density import main_text

from ..compare import ROOT

LONG = "Long plain sentences of an article follow each other here without any link. " * 4


def test_density_finds_the_article_without_its_element(spark):
    """All pages, with the article element renamed: the same texts as with it."""
    pages = [r.html for r in spark.read.parquet(f"{ROOT}/sf0.01/pages.parquet").collect()]
    for page in pages:
        assert main_text(re.sub(r"<(/?)article\b", r"<\1div", page)) == main_text(page) != ""


def test_several_articles_come_in_page_order():
    menu = "<ul><li><a href=a>one</a><li><a href=b>two</a></ul>"
    a, b = f"<p>{LONG}</p><p>{LONG}</p>", "<p>A short <a href=x>second</a> part.</p>"
    want = " ".join((LONG + LONG + "A short second part.").split())
    assert main_text(f"<body><div>{menu}</div><article>{a}</article><article>{b}</article></body>") == want
    links = "".join(f"<p><a href={i}>other story {i}</a></p>" for i in range(9))
    assert main_text(f"<body><article>{a}</article><article>{b}</article><article>{links}</article></body>") == want
    assert main_text(f"<body><div>{a}</div><div><p>{LONG}</p></div></body>") == " ".join((LONG * 3).split())


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p title="a"b">first text here</p><p>second <a href="x">y</a> third', "first text here second y third"),
        ("<p data-x=don't>alpha beta</p><p>gamma isn't delta</p>", "alpha beta gamma isn't delta"),
        ("<p title='x>y' class=a>in</p>", "in"),
        ("<p>AT&<b>amp;</b>T and AT&amp;T</p>", "AT&amp;T and AT&T"),
        ("<article><header><h1>Title</h1></header><p>text</p><div class='share-price'>12</div><div class='notice-period'>month</div><div class='share-buttons'>x</div></article>", "Title text 12 month"),
        ("<article><p>body</p><div class='reader-comments'>me too</div><section id='related_posts'>more</section></article>", "body"),
    ],
)
def test_quotes_references_and_class_words(page, want):
    assert main_text(page) == want


def test_odd_markup_takes_linear_time():
    start = time.process_time()
    assert main_text("<article>" + "</p></i></b>" * 50_000 + "x") == "x"
    assert main_text("<b>" * 20_000 + "</i>" * 50_000 + "y") == "y"
    assert main_text("<i><p>" * 20_000 + "z") == "z"
    assert time.process_time() - start < 20
