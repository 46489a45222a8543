"""A page's visible text as blocks in page order, each with the zone its markup puts it in."""

from __future__ import annotations

import html
import re

# Boilerplate by markup; inside the article; neither; inside it, but named like boilerplate.
DROP, MAIN, OPEN, NAMED = 0, 1, 2, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|title|xmp)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<soft>template|iframe|svg|canvas|object)(?=[\s/>])[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
# Elements whose content is no text; without an end tag only their tag is dropped.
_SOFT_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("template", "iframe", "svg", "canvas", "object")}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav header footer aside form button select dialog menu head fieldset label".split())
_CLOSED_BY_NEXT = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar widget menu nav "
    "navbar navigation breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "trending comment comments disqus respond replies pagination pager toolbar copyright".split()
)
_MARKED_ARTICLE = frozenset("ad ads advert advertisement sponsored promo related teaser comment comments reply".split())
_LOOSE = "~"  # in place of the name of an inline element without an end tag
# As a whole class inside an article these say what an element is; other marks,
# and these as a piece of a longer class, may be about the article itself.
_MARKED_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor sidebar widget navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent gdpr popup modal overlay newsletter subscribe share sharing related "
    "recommendations comment comments disqus respond pagination pager".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())


def _hidden(name: str, rest: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether markup makes the element boilerplate, only names it like some, and whether its role is main.

    ``inside`` an article or a main element names count less.
    """
    if name in _BOILERPLATE:
        return True, False, False
    if not rest or name in ("html", "body"):
        return False, False, False
    whole, role = set(), ""
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            role = value
        elif key == "hidden" or key == "aria-hidden":
            if key == "hidden" or value == "true":
                return True, False, False
        else:
            whole.update(value.split())
    pieces = {piece for word in whole for piece in re.split(r"[^a-z0-9]+", word)}
    if role in _ROLES:
        return True, False, False
    if name in ("article", "main") or role == "main":
        return bool(pieces & _MARKED_ARTICLE), False, role == "main"
    if inside:
        return bool(whole & _MARKED_INSIDE), bool(pieces & _MARKED), False
    return bool(pieces & _MARKED), False, False


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block: references decoded, white space one blank, none empty.

    Scripts, styles, comments and tags are no text.  A block ends where an
    element that is not inline starts or ends, and where an inline one that is
    boilerplate does; that one ends with its own end tag, or with its block if it
    has none.  Without an article element (or main, if there is none) no block
    is ``MAIN`` or ``NAMED``.
    """
    # Name, boilerplate, named like it, in article, in main: of it or an outer one.
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    found: list[tuple[bool, bool, bool, bool, str]] = []
    pending: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        if text:
            found.append((*(stack[-1][1:] if stack else (False, False, False, False)), text))

    with_end: dict[str, set[int]] = {}

    def ended(name: str) -> set[int]:
        """Where the elements of a name start that have an end tag of their own."""
        if name not in with_end:
            with_end[name], open_at = set(), []
            for tag in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", page, re.I):
                if not tag[1]:
                    open_at.append(tag.start())
                elif open_at:
                    with_end[name].add(open_at.pop())
        return with_end[name]

    at, unclosed = 0, set()  # names without an end tag from here on
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            pending.append(page[at : token.start()])
        at = token.end()
        if soft := token["soft"]:
            soft = soft.lower()
            if soft not in unclosed and not (soft == "svg" and token[0].endswith("/>")):
                if end := _SOFT_END[soft].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(soft)
            continue
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        inline = name in _INLINE
        depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if token["close"] or inline else None
        if token["close"]:
            # An inline element ends one on the stack only within its own block.
            if inline and depth is None:
                continue
            if not inline or stack[depth][1] or stack[depth][2]:
                flush()
            if depth is not None:
                del stack[depth:]
            continue
        outer = stack[-1] if stack else ("", False, False, False, False)
        boilerplate, named, is_main = _hidden(name, token["rest"], outer[3] or outer[4])
        empty = name in _VOID or token["rest"].endswith("/")
        if inline and not boilerplate and not named:
            # Within one of its name it is kept count of, so that each end tag finds its own.
            if depth is not None and not empty:
                stack.append((name, *outer[1:]))
            continue
        flush()
        if empty:
            continue
        if inline and token.start() not in ended(name):
            name = _LOOSE
        elif not inline:
            while stack and stack[-1][0] == _LOOSE:
                stack.pop()
            block = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), None)
            if block is not None and stack[block][0] in _CLOSED_BY_NEXT:
                closers = _CLOSED_BY_NEXT[stack[block][0]]
                if closers is None or name in closers:
                    del stack[block:]
            outer = stack[-1] if stack else ("", False, False, False, False)
        article = outer[3] or (name == "article" and not boilerplate)
        main = outer[4] or name == "main" or is_main
        stack.append((name, outer[1] or boilerplate, outer[2] or named, article, main))
    pending.append(page[at:])
    flush()
    inside = next((i for i in (2, 3) if any(f[i] and not f[0] for f in found)), 0)

    def zone(hidden: bool, named: bool, article: bool, main: bool) -> int:
        if hidden or (inside and not (article if inside == 2 else main)):
            return DROP
        return OPEN if not inside else NAMED if named else MAIN

    return [(zone(*f[:4]), f[4]) for f in found]
