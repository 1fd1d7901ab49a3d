from __future__ import annotations

from termlens.llm import extraction as X

LONG = "This is the story of a man who had been at the sea for all of his life and was not afraid."
PAGE = f"""<!DOCTYPE html><html><head><title>Head</title><style>p {{}}</style><script>var x = "</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><div id="cookie-notice"><p>{LONG}</p></div>
<nav><ul><li><a href="/a">Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- <p>gone</p> -->
<article class="post"><header><h1>Title &amp; more</h1></header><p>By&nbsp;Ann</p><p>{LONG}
   Second&#32;line<br>third <b>bold</b>ly.<p>Short.</p><div class="ad">{LONG}</div><aside>{LONG}</aside>
<ul><li>One</li><li>Two &lt;b&gt; x &copy; 5 &lt 6</li></ul><form><input name="q"><label>Find</label></form><p><a href="/m">A whole line of link</a></p>
<p>{LONG}</p><section class="comments"><p>{LONG}</p></section></article>
<footer>&copy; {LONG}</footer></body></html>"""


def test_article_page():
    assert X.main_text(PAGE).split("\n") == [
        "Title & more", "By Ann", f"{LONG} Second line third boldly.", "Short.", "One", "Two <b> x © 5 < 6", "A whole line of link", LONG,
    ]


def test_page_without_article_uses_density_and_neighbours():
    page = f"""<body><div class=menu><a href=x>Menu</a></div><div><a href=1>One</a> <a href=2>Two</a></div><p>Welcome</p><p>{LONG}</p>
    <p>Between</p><p>{LONG}</p><div>{"zxq vbn " * 20}</div><p>Tail</p><ul><li><a href=3>Three</a></li></ul></body>"""
    assert X.main_text(page).split("\n") == [LONG, "Between", LONG]


def test_broken_and_empty_markup():
    assert [X.main_text(h) for h in (None, "", "   ", "<p></p>", "<script>x", "<!-- open", "<p", "&nbsp;")] == [""] * 8
    assert X.main_text("plain words only") == "plain words only"
    assert X.main_text("<p>Hello <b>there") == "Hello there"
    assert X.main_text("<article><h1>A</h1><p>b<a href='>") == "A\nb"
    assert X.main_text("a < b and 1<2 <3>") == "a < b and 1<2 <3>"
    assert X.main_text("<article><p>" + "word " * 50_000 + "</article>").count(" ") == 49_999
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert X.main_text(deep) == "text"


RUSSIAN = "Этот рассказ о человеке, который всю свою жизнь провёл в море и ничего на свете не боялся."
POLISH = "Opowieść dotyczy człowieka, który całe życie spędził morzu, nigdy niczego się bał, dopóki wrócił domu."
CHINESE = "这是一个关于在海上度过一生而且从来没有害怕过任何事情的人的故事。"


def test_classes_of_wrappers_hide_nothing():
    for name in ("has-sidebar", "header-fixed", "social-share-enabled", "sidebar layout", "page-header-menu"):
        menu = '<ul class="menu"><li><a href="/">Home</a></li></ul>'
        assert X.main_text(f'<div class="{name}">{menu}<article><p>{LONG}</p></article></div>') == LONG
        assert X.main_text(f'<div class="{name}">{menu}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class="comments">{LONG}</div>') == f"Title\n{LONG}\n{LONG}"
    assert X.main_text(f'<div class="widget"><h1>Title</h1><p>{LONG}</p></div><div class="comments">{LONG * 3}</div>') == f"Title\n{LONG}"
    assert X.main_text(f'<form id="page"><p>{LONG}</p><input></form>') == LONG
    assert X.main_text(f'<p>{LONG}</p><p>{LONG}</p><div class="main-sidebar">{LONG}</div>') == f"{LONG}\n{LONG}"
    assert X.main_text(f'<p>{LONG}</p><div class="comments">{LONG * 3}</div>') == LONG


def test_pages_in_other_languages():
    for text in (RUSSIAN, POLISH, CHINESE):
        page = f"<nav><a href=1>A</a></nav><h2>{text[:6]}</h2><p>{text}</p><ul><li><a href=2>B</a></li></ul><p>{text}</p><footer>{text}</footer>"
        assert X.main_text(page).split("\n") == [text[:6].strip(), text, text]
    assert X.main_text(f"<p>{LONG}</p><p>{RUSSIAN}</p><p>{LONG}</p>").split("\n") == [LONG, RUSSIAN, LONG]


def test_short_blocks_beside_hidden_ones():
    page = f"<nav><a href=1>Menu</a></nav><h1>Title</h1><p>{LONG}</p><p>The end.</p><footer>{LONG}</footer>"
    assert X.main_text(page).split("\n") == ["Title", LONG, "The end."]
    page = f"<ul><li><a href=1>Menu</a></li></ul><h1>Title</h1><p>{LONG}</p><p>The end.</p><ul><li><a href=2>Next</a></li></ul>"
    assert X.main_text(page).split("\n") == ["Title", LONG, "The end."]


def test_a_teaser_is_not_the_article():
    page = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><article><p>{LONG}</p></article>"
    assert X.main_text(page).split("\n") == ["Title", LONG, LONG, LONG, LONG]


def test_query_keeps_every_row(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = X.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in got) == [(0, False), (1, True), (1, True), (2, False)]
    assert X.extract(pages.limit(0)).count() == 0


def test_a_broken_page_takes_linear_time():
    import time

    html = "<div>" * 4_000 + "</span>" * 8_000 + "<p>" + "Some words of a text that is long enough. " * 20
    begin = time.process_time()
    found = X.blocks(html)
    assert time.process_time() - begin < 0.5 and len(found) == 1


def test_pages_of_known_structure():
    """Made pages, of which the article is known: it is found whole, and nothing else."""
    import html as H
    import random

    chance = random.Random(12)
    common = "the of and to in is that it for was on with as at by from are this".split()
    rare = [f"term{n}" for n in range(300)]

    def sentence(size):
        words = [chance.choice(common if chance.random() < 0.4 else rare) for _ in range(size)]
        return " ".join(words).capitalize() + "."

    def paragraph():
        text = " ".join(sentence(chance.randrange(8, 20)) for _ in range(chance.randrange(2, 6)))
        return text + chance.choice(["", " Ünïcode & <marks>.", " “Quotes” are kept."])

    for _ in range(60):
        title, parts = sentence(6), [paragraph() for _ in range(chance.randrange(2, 8))]
        menu = "".join(f'<li><a href="/{n}">{chance.choice(rare)}</a></li>' for n in range(chance.randrange(3, 9)))
        body = "".join(f"\n <p>{H.escape(p).replace(' ', chance.choice([' ', chr(10), '  ']), 1)}</p>" for p in parts)
        wrapped = chance.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>']).format(f"<h1>{H.escape(title)}</h1>{body}")
        page = (
            f"<html><head><title>x</title><style>p {{}}</style><script>var a = '<p>no</p>';</script></head><body>"
            f"<nav><ul>{menu}</ul></nav><header class='site-header'><a href='/'>Home</a></header>{wrapped}"
            f"<aside class='sidebar'><p>{paragraph()}</p></aside><form><p>{paragraph()}</p><input name='q'></form>"
            f"<div class='comments'><p>{paragraph()}</p></div><footer><p>Copyright 2020 <a href='/l'>legal</a></p></footer></body></html>"
        )
        assert X.main_text(page) == "\n".join([title, *[" ".join(p.split()) for p in parts]])
