"""Whole articles: titles, leads and ends stay however the parts are nested, and what isn't article goes."""

import time

from corpusmill.llm.html_text import extract

LONG = "This is paragraph {} of the article, long enough to be text of its own, with some commas, and words, again and again, so that nobody takes it for a notice or a menu; it goes on, as such paragraphs do, to some two hundred and sixty characters, no more than that {}."


def ps(*names):
    return [LONG.format(n, n) for n in names]


def tags(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_nested_parts_of_an_article_stay():
    many = ps(*range(12))
    page = f"<body><nav><a href=/>x</a></nav><article><header><h1>T</h1><p>LEAD</p></header><div class=body><div class=inner>{tags(many)}</div></div><p>END</p></article></body>"
    assert extract(page) == ["T", "LEAD", *many, "END"]
    three = ps("a", "b", "c")
    assert extract(f"<body><div><h1>Title</h1><p>INTRO</p><div><div>{tags(three)}</div></div><p>TAIL</p></div><footer>f</footer></body>") == ["Title", "INTRO", *three, "TAIL"]
    one, five = ps("first"), ps("last")
    page = f"<body><div class=a><div>{tags(one)}</div></div><div class=b><div>{tags(three)}</div></div><div class=c><div>{tags(five)}</div></div></body>"
    assert extract(page) == [*one, *three, *five]


def test_names_inside_an_article_do_not_take_text_away():
    for part in ('section id="social"', 'section id="tracking"', 'section id="notice"', 'div id="navigation"'):
        text, other = ps("kept", "other"), ps("x", "y", "z")
        page = f"<body><article><h1>T</h1>{tags(other)}<{part}>{tags(text)}</{part.split()[0]}></article></body>"
        assert extract(page) == ["T", *other, *text], part
    body = ps("x", "y")
    page = f'<body><article><h1>T</h1>{tags(body)}<div class="social"><a href=a>Share it</a></div><div class="notice"><p>Short notice.</p></div><div class="advert">{tags(ps("buy"))}</div></article></body>'
    assert extract(page) == ["T", *body]


def test_references_are_no_menu():
    body, links = ps("x", "y"), "<ul><li><a href=1>One, a book</a></li><li><a href=2>Two, a paper</a></li><li><a href=3>Three, a page</a></li></ul>"
    assert extract(f"<body><article>{tags(body)}<h2>References</h2>{links}</article></body>") == [*body, "References", "One, a book", "Two, a paper", "Three, a page"]
    assert extract(f"<body><article>{tags(body)}<h2>More from us</h2>{links}</article></body>") == [*body, "More from us"]


def test_one_word_decides_beside_an_article():
    body = ps("x", "y")
    for box in ('div class="reader-comments"', 'section class="user-feedback"', 'div class="cookie-banner-v2"', 'div class="cookiebanner"', 'div class="my-newsletter-2024"'):
        page = f"<body><article>{tags(body)}</article><{box}>{tags(ps('one', 'two'))}</{box.split()[0]}></body>"
        assert extract(page) == body, box
    # what holds the article is judged by its whole name, as on pages without one
    assert extract(f'<body><div class="has-sidebar"><div class="sidebar-layout"><article>{tags(body)}</article></div></div></body>') == body
    assert extract(f'<body><div class="content">{tags(body)}<section class="related-work">{tags(ps("w"))}</section></div></body>') == [*body, *ps("w")]


def test_deep_pages_take_linear_time():
    body = ps("x", "y")
    for n in (4000, 8000):
        page = f"<body><article>{tags(body)}{'<div class=related>' * n}deep{'</div>' * n}</article></body>"
        began = time.process_time()
        assert extract(page) == [*body, "deep"] and time.process_time() - began < n / 4000
