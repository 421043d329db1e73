"""Blocks of text in an HTML page, with what their place in the page says about them.

A page is read once, tag by tag. Scripts, styles and comments never give text. Unclosed elements end with their parent,
and text after a cut-off tag is kept. White space in a block, br included, is one space; character references are
decoded; blocks without text are left out.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SILENT = frozenset("script style noscript template nav footer aside form button select option textarea input iframe svg canvas object dialog menu head title datalist audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of class and id names. A name counts if all its words are of these sets and at least one of the first three; so
#: has-sidebar and share-price say nothing. The second kind counts only where no name speaks of an article.
_ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr share sharing social newsletter subscribe subscription popup modal overlay toolbar pagination pager footer copyright disclaimer login signup".split()
)
#: What is about other articles or by readers; an article in it is one of theirs.
_OTHERS = frozenset("comment comments disqus reply replies respond related recommended".split())
_MAYBE = frozenset("header banner notice notices alert masthead widget widgets legal form search skip teaser".split())
_NEUTRAL = frozenset("area bar block bottom box button buttons container fixed global group icon icons inner item items left link links list main middle mobile outer page post posts primary right row secondary section site slot sticky thread top unit wrap wrapper".split())
_ARTICLE = frozenset("article post entry content main story body text".split())
_NAME = re.compile(r"[a-z]+")
#: Elements that silence all in them; the others of _SILENT, and names, silence what is not inside an article of theirs.
_CLOSED = _SILENT - {"aside", "form", "dialog", "menu"}
#: Elements whose own text is the prose of an article.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption".split())


@dataclass
class Element:
    tag: str
    silent: bool
    article: bool
    prose: bool = False
    closed: bool = False  # silent for an article in it as well


@dataclass
class Block:
    text: str
    silent: bool  # a menu, header, footer, sidebar, notice, advert, form or comment
    article: bool  # inside article or main
    prose: bool = False  # the own text of a paragraph, heading, list item or table cell there


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(text)}


def _words(names: str) -> tuple[set[str], set[str]]:
    """The words of those class or id names that consist of known words, and the words of all names."""
    every = [set(_NAME.findall(n)) for n in names.lower().split()]
    known = [w for w in every if w <= _ALWAYS | _OTHERS | _MAYBE | _NEUTRAL]
    return set().union(*known), set().union(*every)


def _open(tag: str, text: str, parent: Element) -> Element:
    starts = tag in ("article", "main")
    own, closed = tag in _SILENT, parent.closed or tag in _CLOSED
    if "=" in text or "hidden" in text:
        a = _attributes(text)
        role = a.get("role", "").lower()
        names, every = _words(f"{a.get('class', '')} {a.get('id', '')}")
        starts |= role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
        if tag not in ("html", "body"):
            own |= role in _ROLES or bool(names & (_ALWAYS | _OTHERS)) or bool(names & _MAYBE and not every & _ARTICLE)
            closed |= bool(names & _OTHERS) or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
    article = parent.article or starts
    # an article's beginning ends the silence of a box around it
    silent = closed or own or parent.silent and not (starts and not parent.article)
    return Element(tag, silent or (tag == "header" and not article), article, tag in _PROSE or tag not in _BLOCK and parent.prose, closed)


def blocks(page: str | None) -> list[Block]:
    """In page order."""
    page = page or ""
    out: list[Block] = []
    held: list[str] = []
    stack = [Element("", False, False)]
    open_: dict[str, int] = {}

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                e = stack[-1]
                out.append(Block(text, e.silent, e.article, e.prose and e.article and not e.silent))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            where = len(stack) - 1 if open_.get(tag) else 0
            while where and stack[where].tag != tag:
                where -= 1
            if where:
                if any(x.tag in _BLOCK for x in stack[where:]):
                    end()
                elif stack[-1].silent != stack[where - 1].silent:
                    end()
                close(where)
            elif tag in _BLOCK:
                end()
            continue
        if tag == "br":
            held.append(" ")
            continue
        made = _open(tag, m[3], stack[-1])
        if tag in _BLOCK or made.silent != stack[-1].silent:
            end()
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or tag in _BLOCK and stack[-1].tag == "p":
            # these end an open one of their kind, up to the nearest container
            ends = {"p"} if tag not in ("li", "td", "th", "tr", "dt", "dd", "option") else {tag, "p", *(("td", "th") if tag in ("td", "th", "tr") else ()), *(("dt", "dd") if tag in ("dt", "dd") else ())}
            k = len(stack) - 1 if any(open_.get(x) for x in ends) else 0
            while k > 0 and stack[k].tag not in ends and (stack[k].tag not in _BLOCK):
                k -= 1
            if k > 0 and stack[k].tag in ends:
                close(k)
                made = _open(tag, m[3], stack[-1])
        if tag in _VOID or m[3].endswith("/>") and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else len(page)
        stack.append(made)
        open_[tag] = open_.get(tag, 0) + 1
    end()
    return out


def links(page: str | None) -> list[str]:
    """The targets of a and area elements, in page order."""
    out = []
    for m in _TOKEN.finditer(page or ""):
        if m[2] and not m[1] and m[2].lower() in ("a", "area"):
            target = _attributes(m[3]).get("href")
            if target:
                out.append(html.unescape(target).strip())
    return out


def title(page: str | None) -> str:
    m = re.search(r"<title\b[^>]*>(.*?)(?:</title|\Z)", page or "", re.S | re.I)
    return " ".join(html.unescape(m[1]).split()) if m else ""
