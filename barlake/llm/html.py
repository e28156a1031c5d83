"""A page's blocks of text, by zone, from its HTML.

A small tolerant reader: tags, comments and raw elements are found by one pattern, open
elements are kept on a stack, and an end tag closes up to the nearest element of its name. Text
between block-level tags is one block.
"""

from __future__ import annotations

import html
import re

ARTICLE, PLAIN, CHROME, BOX = 0, 1, 2, 3

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("br button option optgroup".split())
DROPPED = frozenset("nav aside form dialog menu button select head footer header".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert "
                  "alertdialog menu menubar".split())
# Whole class tokens and ids by which pages call what is not the article: one of these names, with
# others or places before it and kinds of boxes or numbers after it. Wrappers named after what
# they hold or lack (with-sidebar, comments-open) and slugs (related-work) are no such tokens.
NAMES = (
    "nav|navbar|navigation|menu|topbar|header|masthead|footer|sidebar|aside|ads?|adverts?|"
    "advertisement|advertising|banner|promo|sponsor|sponsored|cookies?|consent|gdpr|notice|alert|"
    "popup|modal|newsletter|subscribe|subscription|share|sharing|social|comments?|commentlist|"
    "replies|reply|respond|disqus|breadcrumbs?|related|recommended|widget|login|signup|"
    "pagination|pager|skip-link")
PARTS = re.compile(
    rf"(?:(?:{NAMES}|main|site|top|bottom|left|right|primary|secondary|global|mobile|user)[_-])*"
    rf"(?:{NAMES})(?:[_-](?:bar|box|list|links?|buttons?|icons|area|block|form|slot|unit|posts|"
    r"articles|items|\d+))*", re.I)
COMMENT = re.compile(r"comments?(?:[_-](?:body|\d+))?", re.I)
SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 section".split())  # ids here are link targets


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and in_article)
    if not attributes or name in ("body", "html"):
        return False
    content = _content(name, attributes)
    names = COMMENT if content else PARTS
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if (key == "class" or key == "id" and not (in_article and name in SLUGGED)) and any(
                map(names.fullmatch, value.split())):
            return True
        if content:
            continue
        if key == "role" and value.lower() in ROLES or key == "hidden":
            return True
        if key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _content(name: str, attributes: str) -> bool:
    return name in CONTENT or bool(attributes) and (
        "articlebody" in attributes.lower() or bool(re.search(r"role\s*=\s*[\"']?main", attributes)))


def blocks(page: str | None, boxes: bool = False) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order. Character references are decoded, white
    space is one space, empty blocks are left out. An element that holds the article is never
    dropped, whatever its name; inside the article dropped parts stay dropped. With ``boxes``, a block of
    the article that stands in a ``div`` of its own, not in a paragraph or the like, is a BOX."""
    page = page or ""
    out: list[tuple[int, str, tuple[int, ...]]] = []  # with the dropped elements around it
    stack: list[str] = []
    inside: list[int] = []  # stack heights at which articles were opened
    dropped: list[tuple[int, int]] = []  # stack height and number of open dropped elements
    n_dropped = 0
    holding: set[int] = set()  # numbers of those that turned out to hold an article
    text: list[str] = []
    at = 0

    def boxed() -> bool:
        within = stack[inside[-1] + 1:]
        return next((name for name in reversed(within) if name in BLOCK), "") == "div"

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                zone = PLAIN if not inside else BOX if boxes and boxed() else ARTICLE
                out.append((zone, words, tuple(k for _, k in dropped)))
            text.clear()

    def close_to(height: int) -> None:
        del stack[height:]
        while dropped and dropped[-1][0] >= height:
            dropped.pop()
        while inside and inside[-1] >= height:
            inside.pop()

    while True:
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m[1] or m[4]:
            if name in stack:
                close_to(len(stack) - 1 - stack[::-1].index(name))
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ENDS_P and "p" in stack:
            close_to(len(stack) - 1 - stack[::-1].index("p"))
        elif name == "li" and "li" in stack:
            nearest = len(stack) - 1 - stack[::-1].index("li")
            if not {"ul", "ol", "menu"} & set(stack[nearest:]):
                close_to(nearest)
        if _dropped(name, attributes, bool(inside)):
            dropped.append((len(stack), n_dropped))
            n_dropped += 1
        elif _content(name, attributes) and not (inside and dropped):
            holding.update(k for _, k in dropped)
            dropped.clear()
            inside.append(len(stack))
        stack.append(name)
    flush()
    return [(CHROME if set(around) - holding else zone, words) for zone, words, around in out]
