"""Articles whose containers bear words of furniture, and adverts by their names in several languages."""

import pytest

pytest.importorskip("strandmill.llm")
from strandmill.llm import html_text

LONG = "This is a long paragraph of the article that goes on for a while and says a good deal about its subject, with many words. " * 3
TREE = html_text.train_tree(html_text.LABELLED)


def text(page):
    return html_text.main_text(page, TREE)


def test_names_that_say_more():
    page = f'<body><article class="cookie-recipe"><h1>Cookies of oats</h1><div class="cookie-steps"><p>{LONG}</p></div></article></body>'
    assert text(page) == f"Cookies of oats {LONG.strip()}"


@pytest.mark.parametrize("name", ["ad-slot", "advert_inline", "cookie-notice", "comments-list", "comment", "newsletter-signup-box", "pub", "werbung", "anuncio top"])
def test_furniture_in_an_article_goes(name):
    page = f'<body><article><h1>Title</h1><p>{LONG}</p><div class="{name}"><p>Buy our things now</p></div><p>{LONG}</p></article></body>'
    assert text(page) == f"Title {LONG.strip()} {LONG.strip()}"
