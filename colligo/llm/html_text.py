"""The main text of web pages by a linear-chain conditional random field over their leaf blocks.

A page is cut into blocks of text with the elements around them.  Each block has features of those
elements and of its text; the field's weights say how much they speak for the article, and how
likely neighbours are alike.  Weights are learnt on labelled pages (``training_pages`` makes them),
and Viterbi's path says which blocks are the article.
"""

from __future__ import annotations

import html
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
#: Elements without an end, elements whose content is never text, and elements that stand in a line (fixed values).
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = set("script style noscript template svg head title iframe object select textarea canvas audio video".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= set("math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Hidden elements that hold no other elements: if the end tag is missing, the rest of the page is theirs.
_RAW = set("script style title iframe textarea".split())
#: A start of one of these ends an open one of the same kind.
_ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in names of elements that say what they are for, in English, German, French and Spanish, without accents (fixed values).
_PURPOSE = {
    "advert": "ad ads adv advert advertisement adbox adsense banner promo promoted promotion sponsor sponsored werbung anzeige anzeigen reklame publicite pub annonce publicidad anuncio anuncios patrocinado",
    "comment": "comment comments commentlist disqus discussion replies reply respond kommentar kommentare antworten commentaire commentaires reponses comentario comentarios respuestas",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc topbar navi navigationsleiste brotkrumen menue navegacion migas ariane",
    "aside": "aside bio extra more popular recommended related rail recent share sharing sidebar social tags widget widgets seitenleiste randspalte empfehlungen verwandt teilen laterale partager lateral relacionados compartir",
    "notice": "alert consent cookie cookies gdpr modal newsletter notice notification overlay paywall popup privacy subscribe warning hinweis datenschutz einwilligung avertissement consentement aviso consentimiento",
    "form": "contact form login search signin signup suche suchen anmelden anmeldung formular recherche connexion formulaire buscar busqueda formulario",
    "frame": "copyright footer header legal masthead site colophon fusszeile kopfzeile impressum pied entete mentions pie cabecera encabezado",
    "content": "article articlebody body content entry main post story text artikel inhalt beitrag contenu texte articulo contenido texto",
}
#: Words in names that only say where or how an element stands (fixed values).
_NEUTRAL = set("area bar block bottom box card center col column container element fixed full global group head holder inner item large left list lower mobile module outer panel page primary region right row secondary section side slot small sticky sub top unit upper view wide wrap wrapper zone".split())
_BY_WORD = {w: purpose for purpose, words in _PURPOSE.items() for w in words.split()}
_OTHER = {f"for {p}" for p in _PURPOSE if p != "content"} | {f"in {t}" for t in "aside nav footer form button label".split()}
_CORE = {"in article", "in main", "for content"}
#: How a line begins or what it says if it tells whose a page is (fixed values).
_OWNED = re.compile(r"(?:©|\(c\)|copyright\b|impressum\b|mentions légales|aviso legal)", re.IGNORECASE)
_RIGHTS = re.compile(r"all rights reserved|alle rechte vorbehalten|tous droits réservés|(?:todos los )?derechos reservados", re.IGNORECASE)
#: Begins an article's texts in pages made for training; features do not see it.
_MARK = "\ue000"
_KNOWN = set("a article aside blockquote body button caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr label legend li main nav ol p pre section table td th ul".split())


@dataclass
class Block:
    text: str
    features: list[str] = field(default_factory=list)


def _words(name: str) -> list[str]:
    """The words of a name such as ``sideBar``, ``side-bar`` or ``side_bar``, in lower case and without accents."""
    parts = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)
    if not parts.isascii():
        parts = "".join(c for c in unicodedata.normalize("NFKD", parts.replace("ß", "ss")) if not unicodedata.combining(c))
    return _WORDS.findall(parts.lower())


def _purposes(attributes: str) -> tuple[str, ...]:
    """What the names in an element's attributes say it is for: of a few words only, so that what depends on them can be remembered.

    A name that has other words too, as ``ad-free-note`` has, says so with a "maybe".
    """
    if "=" not in attributes:
        return ()
    out = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = _words(name)
            known = {_BY_WORD[w] for w in words if w in _BY_WORD}
            if known and not all(w in _BY_WORD or w in _NEUTRAL or len(w) < 3 for w in words):
                known = {p if p == "content" else f"maybe {p}" for p in known}
            out |= known
    return tuple(sorted(out))


@lru_cache(1 << 14)
def _around(outer: tuple[str, ...], tag: str, purposes: tuple[str, ...]) -> tuple[str, ...]:
    """The features that an element and all around it give a block."""
    new = ([f"in {tag}"] if tag in _KNOWN else []) + [f"for {p}" for p in purposes]
    if tag in ("header", "footer", "form", "aside", "section") and ("in article" in outer or "in main" in outer):
        new.append(f"{tag} in article")
    found = {*outer, *new} - {"plain"}
    # Inside something that holds an article, with nothing around it that speaks for another purpose.
    if found & _CORE and not found & _OTHER:
        found.add("plain")
    return tuple(sorted(found))


def _text_features(text: str, linked: int, own: str, plain: bool) -> list[str]:
    text = text.removeprefix(_MARK)
    words, share = text.count(" ") + 1, min(3, 4 * linked // max(1, len(text)))
    out = ["any", f"words {min(words, 64).bit_length()}", f"links {share}"]
    if text[-1:] in ".!?:;\"'”»…。":
        out.append("sentence")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if _OWNED.match(text):
        out.append("owned short" if words <= 16 else "owned long")
    if _RIGHTS.search(text):
        out.append("rights")
    if words <= 4 and linked:
        out.append("short link")
    if plain and share == 3:
        out.append(f"plain {own} all link")
    return out


def _placed(out: list[Block]) -> list[Block]:
    """Blocks with the features of their places in the page."""
    if out:
        out[0].features.append("first")
        out[-1].features.append("last")
        if "owned short" in out[-1].features:
            out[-1].features.append("owned last")
        if any("plain" in b.features for b in out):
            for b in out:
                if _CORE.isdisjoint(b.features):
                    b.features.append("outside")
    return out


def _first(tags: str, page: str, at: int, none: int) -> int:
    """Where the first of ``tags`` begins from ``at`` on, or ``none``."""
    m = re.compile(rf"(?:{tags})(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII).search(page, at)
    return m.start() if m else none


def _ends(page: str, tag: str) -> dict[int, int]:
    """For each start tag of an element that has an end tag: where the start tag ends, and where the end tag begins."""
    waiting, out = [], {}
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.IGNORECASE | re.ASCII):
        if m[1]:
            if waiting:
                out[waiting.pop()] = m.start()
        elif (start := _TAG.match(page, m.start())) and not start[2].endswith("/"):
            waiting.append(start.end())
    return out


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order.  Unclosed and crossed elements are taken as a browser would, more or less."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    near: tuple[str, ...] = ()
    own = ""  # the innermost block element
    parts: list[str] = []
    links, linked, at, n = 0, 0, 0, len(page)
    ends: dict[str, dict[int, int]] = {}

    def close():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, [*near, f"own {own}", *_text_features(text, linked, own, "plain" in near)]))
        linked = 0

    def add(raw: str):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    while at < n:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        if i > at:
            add(page[at:i])
        if page.startswith("<!--", i):
            e = page.find("-->", i + 4)
            at = n if e < 0 else e + 3
            continue
        m = _TAG.match(page, i)
        if m is None:
            following = page[i + 1 : i + 2]
            if following in ("!", "?", "/") or following.isascii() and following.isalpha():
                e = page.find(">", i)
                at = n if e < 0 else e + 1
            else:
                add("<")
                at = i + 1
            continue
        tag, at = m[1].lower(), m.end()
        if page[i + 1] == "/":
            if tag in _INLINE:
                links = max(0, links - (tag == "a"))
                continue
            close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag in _HIDDEN:
            if not m[2].endswith("/"):
                if tag in _RAW:
                    at = _first(f"</{tag}", page, at, n)
                elif tag == "head":  # a page may leave its end out
                    e = _first("</head|<body", page, at, n)
                    at = e if e < n else at
                else:
                    if tag not in ends:
                        ends[tag] = _ends(page, tag)
                    at = ends[tag].get(at, at)
            close()
            continue
        elif tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            links += tag == "a"
            continue
        else:
            close()
            if tag in _ALONE:
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[k][0] in _ALONE[tag]:
                        del stack[k:]
                        break
            if tag not in _VOID:
                stack.append((tag, _around(stack[-1][1] if stack else (), tag if tag in _KNOWN else "", () if tag in ("html", "body") else _purposes(m[2]))))
        links = 0
        near = stack[-1][1] if stack else ()
        own = stack[-1][0] if stack and stack[-1][0] in _KNOWN else ""
    close()
    return _placed(out)


class Field:
    """The field's weights: for each feature how much it speaks for the article, and for each pair of neighbours."""

    def __init__(self, weight: dict[str, float], step: np.ndarray):
        self.weight, self.step = weight, step

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks; of equals those that say less is the article."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        no, yes, back = 0.0, 0.0, []
        for k, b in enumerate(page):
            score = sum(self.weight.get(f, 0.0) for f in b.features)
            if k == 0:
                yes = score
                continue
            from_no, from_yes = no + s01, yes + s11
            back.append((yes + s10 > no + s00, from_yes > from_no))
            no, yes = max(no + s00, yes + s10), max(from_no, from_yes) + score
        path = [yes > no]
        for to_no, to_yes in reversed(back):
            path.append(to_yes if path[-1] else to_no)
        return path[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, rate: float = 0.2, ridge: float = 0.1) -> Field:
    """Maximises the pages' likelihood, less the squared weights, by gradient steps over all pages at once."""
    names = sorted({f for page, _ in pages for b in page for f in b.features})
    index = {f: i for i, f in enumerate(names)}
    longest = max(len(p) for p, _ in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, there = np.zeros((len(pages), longest)), np.zeros((len(pages), longest), bool)
    for i, (page, labels) in enumerate(pages):
        for k, (b, label) in enumerate(zip(page, labels)):
            x[i, k, [index[f] for f in b.features]] = 1
            y[i, k], there[i, k] = label, True
    w, step = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names)), np.zeros(len(names)), np.zeros((2, 2)), np.zeros((2, 2))]
    pairs = there[:, 1:] & there[:, :-1]
    seen = np.array([[(((1 - y[:, :-1]) if a == 0 else y[:, :-1]) * ((1 - y[:, 1:]) if b == 0 else y[:, 1:]) * pairs).sum() for b in (0, 1)] for a in (0, 1)])
    for r in range(1, rounds + 1):
        e = x @ w.astype(np.float32)
        score = np.stack([np.zeros_like(e), e], 2).astype(float)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(ahead[:, k - 1, :1] + step[0], ahead[:, k - 1, 1:] + step[1]) + score[:, k]
            ahead[:, k] = np.where(there[:, k, None], new, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            to = score[:, k + 1] + behind[:, k + 1]
            new = np.logaddexp(step[:, 0] + to[:, :1], step[:, 1] + to[:, 1:])
            behind[:, k] = np.where(there[:, k + 1, None], new, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead + behind - total[:, None, None])[:, :, 1] * there
        joint = ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        grad_w = np.einsum("pkf,pk->f", x, (y - p) * there) - ridge * w
        grad_s = seen - (np.exp(np.minimum(joint, 0)) * pairs[:, :, None, None]).sum((0, 1)) - ridge * step
        for value, grad, m, v in ((w, grad_w, *moments[:2]), (step, grad_s, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(dict(zip(names, w.tolist())), step)


def training_pages(many: int = 500, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages of many layouts.  An article's texts begin with a private character, which is taken off again."""
    rng, mark = random.Random(seed), _MARK
    letters = "etaoinshrdlu"
    other = " ".join(names for purpose, names in _PURPOSE.items() if purpose != "content").split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))

    def text(low: int, high: int, sentence: float = 0.9) -> str:
        t = words(rng.randint(low, high)).capitalize()
        return t + ("." if rng.random() < sentence else "")

    def link(low: int = 1, high: int = 4) -> str:
        return f'<a href="/{rng.randint(0, 99)}">{words(rng.randint(low, high))}</a>'

    def named(tag: str, names: str, inner: str) -> str:
        name = rng.choice(names.split())
        if rng.random() < 0.12:
            attribute = f' class="{rng.choice([f"{name}-{word()}", f"{word()}-{name}"])}"'
            return f"<{tag}{attribute}>{inner}</{tag}>"
        attribute = rng.choice([f' class="{name}"', f" id='{name}'", f' class="{name} box"', f' class="x-{name}"'])
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))

    def misled(inner: str, tag: str = "p") -> str:
        """An article's block whose name has a word for something else in it."""
        name = rng.choice(other)
        return f'<{tag} class="{rng.choice([f"{name}-{word()}", f"{word()}-{name}", f"{word()}-{name}-{word()}"])}">{inner}</{tag}>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", named("div", "menu nav navbar breadcrumbs navigation navi navigationsleiste menue navegacion migas ariane", f"<ul>{items}</ul>"), f'<header><h2>{words(2)}</h2><nav><ul>{items}</ul></nav></header>', f"<nav>{link()} {link()}</nav>", f"<div>{link()} | {link()} | {link()}</div>", f"<ul>{items}</ul>"])

    def advert() -> str:
        inner = rng.choice([text(3, 30), f"<p>{text(3, 30)}</p>", f"<p>{link(2, 8)}</p>"])
        return rng.choice([named("div", "ad ads advert banner promo sponsored werbung anzeige reklame publicite annonce publicidad anuncio", inner), named("aside", "ad sponsored promo", inner), named("section", "advertisement promo", inner)])

    def side() -> str:
        inner = f"<h3>{words(2)}</h3>" + "".join(rng.choice([f"<p>{text(2, 25)}</p>", f"<ul><li>{link(2, 6)}</li></ul>"]) for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<aside>{inner}</aside>", named("div", "sidebar related widget share popular seitenleiste randspalte empfehlungen laterale partager lateral relacionados", inner), named("section", "related recommended", inner)])

    def notice() -> str:
        return named(rng.choice(["div", "section", "p"]), "cookie consent notice gdpr newsletter popup hinweis datenschutz einwilligung avertissement consentement aviso consentimiento", rng.choice([f"{text(5, 30)} <button>{words(1)}</button>", text(5, 30)]))

    def form() -> str:
        return rng.choice([f"<form><label>{words(2)}</label><input><button>{words(1)}</button></form>", f"<form><p>{text(2, 20)}</p><input type=text><button>{words(1)}</button></form>", named("form", "search login signup suche anmeldung recherche connexion buscar", f"<fieldset><legend>{words(2)}</legend>{text(1, 8)}</fieldset>")])

    def comments() -> str:
        each = "".join(rng.choice([named("div", "comment reply", f"<p>{text(2, 40)}</p>"), f"<li><p>{text(2, 40)}</p></li>", f"<p>{text(2, 40)}</p>"]) for _ in range(rng.randint(1, 5)))
        return rng.choice([named("section", "comments discussion", f"<h3>{words(1)}</h3>{each}"), named("div", "comments disqus replies kommentare commentaires comentarios", each), named("ol", "commentlist comments", each)])

    def footer() -> str:
        inner = rng.choice([f"&copy; {words(2)} &middot; {text(2, 20)}", f"<p>{text(3, 25)}</p><p>{link()} {link()}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>"])
        owned = f"{rng.choice(['Copyright', '©', '&copy;', '(c)', 'Copyright ©'])} {rng.randint(1990, 2030)} {words(rng.randint(1, 4))}{rng.choice(['', '.', '. All rights reserved.', '. Alle Rechte vorbehalten.', ' - Tous droits réservés', '. Todos los derechos reservados.'])}"
        unnamed = rng.choice([f"<div>{owned}</div>", f"<p>{owned}</p>", f"<div><p>{owned}</p></div>", f"<p>{owned}</p><p>{link()} {link()}</p>", f"<hr>{owned}"])
        return rng.choice([f"<footer>{inner}</footer>", f"<footer>{owned}</footer>", named("div", "footer copyright legal fusszeile impressum pied mentions pie", inner), unnamed])

    def body() -> str:
        def block() -> str:
            kind = rng.random()
            if kind < 0.62:
                inner = mark + (f"Copyright {text(20, 80)}" if rng.random() < 0.02 else text(*rng.choice([(1, 3), (3, 20), (10, 80)])))
                turn = rng.random()
                if turn < 0.06:
                    return misled(inner)
                if turn < 0.11:
                    return f'<p><a href="/{rng.randint(0, 99)}">{inner}</a>{rng.choice(["", ".", " "])}</p>'
                return f"<p>{inner[:40]}<b>{inner[40:]}</b></p>" if rng.random() < 0.1 else f"<p>{inner} {link()} {words(3)}.</p>" if rng.random() < 0.12 else f"<p>{inner}{rng.choice(['</p>', '</p>', ''])}"
            if kind < 0.7:
                level = rng.randint(2, 4)
                return f"<h{level}>{mark}{text(1, 8, 0.1)}</h{level}>"
            if kind < 0.78:
                return "<ul>" + "".join(f"<li>{mark}{text(1, 15, 0.5)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
            if kind < 0.83:
                return f"<blockquote>{mark}{text(4, 40)}</blockquote>"
            if kind < 0.87:
                return "<table>" + "".join(f"<tr><td>{mark}{words(1)}</td><td>{mark}{words(2)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            if kind < 0.9:
                return f"<figure><img src=x><figcaption>{mark}{text(2, 12)}</figcaption></figure>"
            if kind < 0.92:
                return f"<pre>{mark}{words(6)}</pre>"
            if kind < 0.94:
                return misled(f"<p>{mark}{text(3, 60)}</p><p>{mark}{text(3, 60)}</p>", rng.choice(["div", "section"]))
            return f"<div>{mark}{text(2, 60)}</div>"

        parts = [f"<h1>{mark}{text(2, 12, 0.3)}</h1>" if rng.random() < 0.85 else "", *(block() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 15])))]
        if rng.random() < 0.15:
            parts[0] = f"<header>{parts[0]}</header>"
        for extra in (advert, side, form, notice):
            if rng.random() < 0.25:
                parts.insert(rng.randint(1, len(parts)), extra())
        return "".join(parts)

    def page() -> str:
        wrap = rng.choice(["<article>{}</article>"] * 5 + ["<main>{}</main>"] * 2 + ["<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="post">{}</div>', '<div class="article-body">{}</div>', '<div class="entry-content">{}</div>', "<div>{}</div>", "<div>{}</div>", "{}"])
        inner = wrap.format(body() + (comments() if rng.random() < 0.08 else ""))
        ahead = [f() for f in (notice, menu, advert) if rng.random() < (0.8 if f is menu else 0.45)]
        after = [f() for f in (side, comments, advert, form, notice) if rng.random() < 0.3]
        rng.shuffle(ahead)
        rng.shuffle(after)
        return "<html><head><title>x</title></head><body>" + "".join(ahead) + inner + "".join(after) + (footer() if rng.random() < 0.85 else "") + "</body></html>"

    out = []
    for _ in range(many):
        found = blocks(page())
        labels = [b.text.startswith(mark) for b in found]
        # Features do not see the mark, for it is a letter of a word.
        out.append((found, labels))
    return [x for x in out if x[0]]


def main_text(page: str, model: Field) -> str:
    """The article's blocks in page order, one space between; '' if there is none."""
    found = blocks(page)
    return " ".join(b.text for b, ok in zip(found, model.decode(found)) if ok)


@cache
def trained() -> Field:
    """The field of the generated pages, learnt once in a process."""
    return train(training_pages())


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``; a null or empty page has an empty text.

    Ids and addresses are passed on as they are: null or repeated ones have their rows as others do.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(p, shared.value) for p in pc.fill_null(piece.column("html"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", "html").mapInArrow(run, out)
