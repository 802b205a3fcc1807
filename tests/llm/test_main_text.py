"""Main text: pages in other languages, cards beside the body, comment sections without a name, time in proportion to the page."""

import time

import pytest

from segstats.llm import html_text

EN = (
    "The new library in the centre of the town was opened to the public on Monday, and hundreds of people came to see "
    "it in spite of the rain."
)
RU = (
    "Вчера в городе открылась новая выставка современного искусства, которую посетили сотни жителей и гостей столицы, "
    "несмотря на сильный дождь."
)
ZH = (
    "昨天下午，市中心的新图书馆正式对公众开放，数百名读者冒雨前来参观，许多家长带着孩子一起体验了儿童阅读区，"
    "工作人员介绍了馆藏与借阅规则，现场气氛十分热烈，预计每天可接待两千人次以上的读者。"
)
CARD = (
    "<article><h3><a href=/x>Another story</a></h3><p>A short teaser of the other story that is long enough to count, "
    "with the words of it and so on.</p></article>"
)


def page(body):
    return f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Copyright someone</footer></body></html>"


def response(name):
    return (
        f"<li class='response r{len(name)}'><span class='author'>{name}</span> <time>Monday</time>"
        "<p>I think that this is the best thing that has been in the town for years.</p></li>"
    )


@pytest.mark.parametrize("text", [RU, ZH, EN])
@pytest.mark.parametrize("around", ["div", "article", "main"])
def test_articles_in_any_language(text, around):
    title = text[:20].strip()
    got = html_text.extract(page(f"<{around}><h1>{title}</h1><p>{text}</p><p>{text}</p></{around}>"))
    assert got == f"{title} {text} {text}"


def test_other_languages_keep_their_links_out():
    links = "<div>" + "".join(f"<a href=/{k}>{RU[:40]}</a> " for k in range(9)) + "</div>"
    assert html_text.extract(page(f"<div><p>{RU}</p>{links}<p>{RU}</p></div>")) == f"{RU} {RU}"


@pytest.mark.parametrize("cards", [CARD, CARD * 2, CARD * 5])
def test_cards_beside_the_body_do_not_replace_it(cards):
    body = f"<p>{EN}</p>" * 6
    assert html_text.extract(page(f"<div id='copy'>{body}</div>{cards}")) == " ".join([EN] * 6)


def test_one_short_article_beside_a_long_advert_stays():
    assert html_text.extract(page(f"<div>{EN}</div><article><h1>Short</h1><p>One line.</p></article>")) == "Short One line."


@pytest.mark.parametrize("around", ["section class='reader-responses'", "div", "div class=x1"])
def test_comment_sections_are_known_by_their_build(around):
    comments = f"<{around}><h2>Discussion</h2><ul>{response('Ann')}{response('Robert')}</ul></{around.split()[0]}>"
    body = f"<h1>Title here</h1><p>{EN}</p><p>{EN}</p>"
    assert html_text.extract(page(f"<main>{body}{comments}</main>")) == f"Title here {EN} {EN}"
    assert html_text.extract(page(f"<div>{body}{comments}</div>")) == f"Title here {EN} {EN}"


def test_dated_parts_of_an_article_are_no_comments():
    part = f"<div class='entry'><time>10:00</time><p>{EN}</p></div>"
    assert html_text.extract(page(f"<article><h1>Live log</h1>{part * 4}</article>")).count(EN) == 4
    byline = "<div class='meta'><span class='author'>Ann</span></div>"
    assert html_text.extract(page(f"<article><h1>Title</h1>{byline}<p>{EN}</p></article>")).count(EN) == 1


@pytest.mark.parametrize(
    "unit", ["<script ", "<a ", '<a b="', "<a b='\">\"", "<!", "<!--", "<title>", "</script", "<a \"' ", '<a b=">', "<svg/>", "<"]
)
def test_time_is_in_proportion_to_the_page(unit):
    """A megabyte of openings that no end follows, or that end far away."""
    whole = unit * (1_000_000 // len(unit))
    for text in (whole, f"{whole}>", f"\"{whole}'>"):
        began = time.time()
        html_text.extract(text)
        assert time.time() - began < 10


def test_tags_end_outside_quotes():
    tags = html_text._tags("<a b='>' c=\">\">x<p d=\">y<i e='q'>")
    assert [(t[0], t[1], t[3]) for t in tags] == [(0, 15, "a"), (16, 23, "p"), (24, 33, "i")]
