"""Text blocks of a page and the part of the page that each one is in."""

from __future__ import annotations

import html
import re

#: Parts of a page: left out by the page's own marks, unmarked, in a main element, in an article.
ASIDE, PLAIN, MAIN, ARTICLE = range(4)

# Element names by what they do to text, and names that sites give to parts around the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th option img".split())
LEFT_OUT = frozenset(
    "nav header footer aside form script style noscript template iframe object embed svg math canvas audio video button select option textarea "
    "dialog menu head title noembed noframes map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription sidebar sidebars rail widget widgets menu menus nav navbar navigation navigator "
    "breadcrumb breadcrumbs crumbs footer foot masthead topbar toolbar comment comments commentlist disqus reply replies respond related recommended "
    "recommendations share sharing social popup modal overlay login signin signup register search pagination pager skip tags tagcloud toc copyright legal".split()
)
UNMEANT = frozenset("div section span p ul ol li b i a center table tbody tr td".split())
HEADINGS = frozenset("header hgroup masthead".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "tfoot", "thead", "tr", "dd", "dt", "li"} | {"li", "dd", "dt"}
SCOPE = frozenset("html table td th caption template object marquee".split())
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_MARK = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|[!?/][^>]*(?:>|\Z))""", re.S
)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>[^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _left_out(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is one that holds no article text."""
    if name in LEFT_OUT:
        return not (name == "header" and in_article)
    if "=" not in rest and "hidden" not in rest.lower():
        return False
    at = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").lower().replace(" ", ""):
        return True
    if at.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "main") or name == "article" and "comment" not in f"{at.get('class')} {at.get('id')}".lower():
        return False
    named = _CASE.sub("-", f"{at.get('class', '')} {at.get('id', '')}").lower()
    parts = set(_PART.split(named))
    return bool(parts & NAMES) or (not in_article and bool(parts & HEADINGS))


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order, each with its part. Character references are decoded, white space is one space.

    Elements are opened and closed as browsers do where that moves text between parts: a paragraph ends at the next
    block, an item at the next item, and an end mark closes all that is open inside its element. A mark that is cut off at
    the end of the page, and what follows an unclosed comment, is no text.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # name, part
    part, at, n, seen = PLAIN, 0, len(page), False

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, part))

    def close(to: int) -> None:
        nonlocal part
        flush()
        del stack[to:]
        part = stack[-1][1] if stack else PLAIN

    def find(names: tuple[str, ...], stops: frozenset[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stops:
                break
        return -1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            held.append(html.unescape(text) if "&" in text else text)
        if lt == n:
            break
        mark = _MARK.match(page, lt) or _LOOSE.match(page, lt)
        if mark is None:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":
                break  # cut off
            held.append("<")
            at = lt + 1
            continue
        at = mark.end()
        name = (mark["name"] or "").lower()
        if not name:
            continue
        if mark["end"]:
            if name == "p" or name in BLOCKS:
                i = find((name,), SCOPE)
                if i >= 0 and name not in ("body", "html"):
                    close(i)
                else:
                    flush()
            else:
                i = find((name,), SCOPE if name in SCOPE else BLOCKS | SCOPE)
                if i >= 0:
                    if any(stack[j][1] != part for j in range(i)) or name in LEFT_OUT:
                        close(i)
                    else:
                        del stack[i:]
                        new = stack[-1][1] if stack else PLAIN
                        if new != part:
                            flush()
                            part = new
                if name in SPACED:
                    held.append(" ")
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            close(len(stack) - 1)
        if name in CLOSES_P and (i := find(("p",), SCOPE | {"button"})) >= 0:
            close(i)
        if name in ITEMS and (i := find(ITEMS[name], frozenset({"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "template"}))) >= 0:
            if name in ("td", "th"):
                del stack[i:]
                held.append(" ")
            else:
                close(i)
        if name in BLOCKS:
            flush()
        elif name in SPACED:
            held.append(" ")
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                close_mark = page.find(">", at)
                at = close_mark + 1 if close_mark >= 0 else n
            continue
        if name in VOID or mark["rest"].endswith("/") and name in ("svg", "math", "path"):
            continue
        inner = part
        if _left_out(name, mark["rest"], part >= MAIN):
            inner = ASIDE
        elif name == "article" or name == "main" or 'role="main"' in mark["rest"].lower():
            # The page's first article isn't hidden by an unclosed part of no meaning around it.
            shown = part != ASIDE or not seen and all(p != ASIDE or x in UNMEANT for x, p in stack)
            inner = max(part, ARTICLE if name == "article" else MAIN) if shown else part
            seen = seen or shown
        if inner != part:
            flush()
        stack.append((name, inner))
        part = inner
    flush()
    return out
