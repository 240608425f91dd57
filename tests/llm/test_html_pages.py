"""Operator 4 on pages written by hand, which its generator does not make."""

from __future__ import annotations

import pytest
from colligo.llm import html_text

TEXT = "This is a paragraph of the article with quite some words in it, as usual."
LAW = "Copyright law is a matter of many words and of many different views, says the article here and so on."


def _article(inner: str, end: str = "<footer>© 2020 Foo</footer>") -> str:
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    return f"<html><head><title>x</title></head><body>{menu}<article><h1>The title</h1>{inner}<p>The last words of it.</p></article>{end}</body></html>"


BLOG = f"""<html><body class="post-template has-sidebar"><header class="site-header"><p class="site-title"><a href=/>My blog</a></p>
<nav class="main-navigation"><ul class="menu"><li><a href=/>Start</a></li></ul></nav></header><div id="content"><article class="post type-post hentry">
<header class="entry-header"><h1 class="entry-title">The title</h1></header><div class="entry-content"><p>{TEXT}</p><h2>More</h2><p>{TEXT}</p></div></article>
<div id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><p>{TEXT}</p></li></ol></div></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent</h2><ul><li><a href=/x>Another post of this</a></li></ul></section></aside>
<footer class="site-footer"><div class="site-info">Proudly made</div></footer></body></html>"""
GERMAN = f"""<html><body><div id="kopfzeile"><a href=/>Zeitung</a></div><ul id="navigationsleiste"><li><a href=/1>Politik</a></li><li><a href=/2>Sport</a></li></ul>
<div class="anzeige">Jetzt kaufen und sparen!</div><div class="artikel"><h1>Die Schlagzeile</h1><p>{TEXT}</p><p>{TEXT}</p></div>
<div class="seitenleiste"><h3>Mehr</h3><p><a href=/3>Ein anderer Artikel</a></p></div><div class="kommentare"><p>Das ist ein Kommentar von mir.</p></div>
<div id="fußzeile">Impressum Datenschutz</div></body></html>"""
FRENCH = f"""<html><body><div class="entête"><a href=/>Journal</a></div><div class="publicité">Achetez maintenant, c’est moins cher.</div>
<div class="contenu"><h1>Le titre</h1><p>{TEXT}</p><p>{TEXT}</p></div><div class="commentaires"><p>Bravo pour cet article.</p></div>
<div class="pied-de-page">Mentions légales - Tous droits réservés</div></body></html>"""
SPANISH = f"""<html><body><nav><a href=/>Inicio</a></nav><main><h1>El título</h1><p>{TEXT}</p><div class="anuncio"><p>Compre ahora, es barato.</p></div><p>{TEXT}</p></main>
<div class="barra-lateral"><p>Lo más leído de hoy.</p></div><div class="pie">Aviso legal</div></body></html>"""

PAGES = {
    "name with a misleading word": (_article(f'<p>{TEXT}</p><p class="ad-free-note">{TEXT}</p>'), f"The title {TEXT} {TEXT} The last words of it."),
    "another misleading word": (_article(f'<p>{TEXT}</p><p class="popular-science">{TEXT}</p>'), f"The title {TEXT} {TEXT} The last words of it."),
    "paragraph that is one link": (_article(f"<p>{TEXT}</p><p><a href=/x>{TEXT}</a></p>"), f"The title {TEXT} {TEXT} The last words of it."),
    "owner's line without a name": (f"<html><body><div><h1>The title</h1><p>{TEXT}</p><p>{TEXT}</p></div><div>Copyright 2020 Foo</div></body></html>", f"The title {TEXT} {TEXT}"),
    "nothing has a name": (f"<html><body><h1>The title</h1><p>{TEXT}</p><p>{TEXT}</p><p>Copyright 2020 Foo</p></body></html>", f"The title {TEXT} {TEXT}"),
    "article on copyright": (_article(f"<p>{LAW}</p>"), f"The title {LAW} The last words of it."),
    "german footer": (_article(f"<p>{TEXT}</p>", '<div class="fusszeile">Foo GmbH, Musterweg 1, 12345 Berlin</div>'), f"The title {TEXT} The last words of it."),
    "blog": (BLOG, f"The title {TEXT} More {TEXT}"),
    "german": (GERMAN, f"Die Schlagzeile {TEXT} {TEXT}"),
    "french": (FRENCH, f"Le titre {TEXT} {TEXT}"),
    "spanish": (SPANISH, f"El título {TEXT} {TEXT}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(name):
    page, want = PAGES[name]
    assert html_text.main_text(page, html_text.trained()) == want


def test_names_of_elements():
    assert html_text._purposes(' class="sideBar"') == ()
    assert html_text._purposes(' class="sidebar-left"') == ("aside",)
    assert html_text._purposes(' class="mainMenu x-ad"') == ("advert", "content", "menu")
    assert html_text._purposes(' class="ad-free-note"') == ("maybe advert",)
    assert html_text._purposes(" id='Fußzeile' class=publicité-bas") == ("frame", "maybe advert")


def test_rows_without_ids_and_repeated_rows(spark):
    page = PAGES["blog"][0]
    rows = [(None, None, page), (1, "u", page), (1, "u", page), (2, "v", None), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(html_text.extract(pages).collect(), key=lambda r: (r["page_id"] or 0, r["url"] or ""))
    want = PAGES["blog"][1]
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got] == [
        (None, None, want, len(want)), (1, "u", want, len(want)), (1, "u", want, len(want)), (2, "v", "", 0), (3, "w", "", 0),
    ]
