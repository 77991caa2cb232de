"""Text, links and artifacts of captured pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.functions import text as tx

# Elements that browsers do not show, and selectors of elements whose text is not conversation.
UNSEEN_ELEMENTS = ["script", "style", "title"]
# The element around a text itself.
SKIPPED_PARENTS = [
    "button", "svg", '[role="button"]', ".icon", '[class*="icon"]', '[data-testid*="button"]', '[aria-label*="button"]',
]
# That element or any around it.
SKIPPED_REGIONS = [
    "button", '[role="button"]', '[data-testid*="action"]', '[class*="action-"]', '[class*="toolbar"]', "nav", "header",
    '[class*="controls"]',
]
# Selectors that mark an artifact.
ARTIFACT_SELECTORS = [
    '[data-testid*="artifact"]', ".artifact-container", '[class*="artifact"]', ".code-block", ".preview-container",
]
# Elements without content.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements inside a line; all others part the words around them.
INLINE_ELEMENTS = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup u var wbr".split())
# What may end a link in a text without belonging to it.
LINK_END = ".,;!?)"
#: A whole tag; a value in quotes may hold ``>``.  Nothing in it is tried twice, and without an end of the tag the page ends there.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SELECTOR = re.compile(r"""([a-z]*)(?:\.([\w-]+)|\[([\w-]+)(\*?)=["']?([^"'\]]*)["']?\])?""")
_BUTTON = re.compile(r"(?i)(Write|Strategize|Create|Learn|From\s+Drive|Publish|Share|Copy|Edit|Delete)")
_LINK = re.compile(r"https?://\S+")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in UNSEEN_ELEMENTS}


class Selectors:
    """Selectors of one part, read once: a name, ``.class``, ``[attribute="value"]`` or ``[attribute*="part"]``."""

    def __init__(self, selectors: list[str]):
        self.parsed = []
        for selector in selectors:
            name, own_class, attribute, part, value = _SELECTOR.fullmatch(selector).groups()
            self.parsed.append((selector, name, own_class, attribute, bool(part), value))
        self.names = {name for _, name, own_class, attribute, *_ in self.parsed if name and not own_class and not attribute}
        self.others = [p for p in self.parsed if p[2] or p[3]]

    def matching(self, element: Element) -> list[int]:
        """Positions of the selectors that match."""
        return [k for k, p in enumerate(self.parsed) if _matches(element, *p[1:])]

    def any_of(self, element: Element) -> bool:
        if element.name in self.names:
            return True
        return bool(element.source) and any(_matches(element, *p[1:]) for p in self.others)


def _matches(element: Element, name: str, own_class: str, attribute: str, part: bool, value: str) -> bool:
    if name and name != element.name:
        return False
    if own_class:
        return own_class in element.attributes.get("class", "").split()
    if attribute:
        held = element.attributes.get(attribute)
        return held is not None and (value in held if part else held == value)
    return True


class Element:
    """An open element: its name and attributes, which are read when they are asked for."""

    __slots__ = ("name", "source", "found")

    def __init__(self, name: str, source: str) -> None:
        self.name = name
        self.source = source
        self.found: dict[str, str] | None = None

    @property
    def attributes(self) -> dict[str, str]:
        if self.found is None:
            self.found = {}
            for key, *values in _ATTRIBUTE.findall(self.source):
                self.found.setdefault(key.lower(), unescape("".join(values)))
        return self.found

    def style(self, name: str) -> str:
        if "style" not in self.source.lower():
            return ""
        styles = dict(p.split(":", 1) for p in self.attributes.get("style", "").lower().split(";") if ":" in p)
        return {k.strip(): v.strip() for k, v in styles.items()}.get(name, "")


def elements(html: str) -> Iterator[tuple[str, Element | str]]:
    """``open`` and ``close`` with the element, ``text`` with a text node; an end tag closes what is open inside it.

    One pass: every character is looked at a bounded number of times.  Open elements are counted by name, so an end tag without a
    start costs nothing.  A comment, a tag or an unseen element without an end takes the rest of the page.
    """
    stack: list[Element] = []
    open_of: dict[str, int] = {}
    text: list[str] = []
    at = 0
    while True:
        start = html.find("<", at)
        if start < 0:
            text.append(html[at:])
            break
        if start > at:
            text.append(html[at:start])
        tag = _TAG.match(html, start)
        if tag is None:
            after = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3
            elif after and (after in "!?" or (after == "/" and not html[start + 2 : start + 3].isalpha())):
                end = html.find(">", start)
                at = end + 1
            elif after == "/" or ("a" <= after.lower() <= "z"):
                end = -1
            else:
                text.append("<")
                at = start + 1
                continue
            if end < 0:
                break
            continue
        at = tag.end()
        closing, name, source = tag.groups()
        name = name.lower()
        if text:
            yield "text", "".join(text)
            text = []
        if closing:
            while open_of.get(name):
                element = stack.pop()
                open_of[element.name] -= 1
                yield "close", element
                if element.name == name:
                    break
            continue
        element = Element(name, source.strip())
        yield "open", element
        if name in VOID_ELEMENTS or source.endswith("/"):
            yield "close", element
            continue
        stack.append(element)
        open_of[name] = open_of.get(name, 0) + 1
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            inside = html[at : end.start()] if end else html[at:]
            if inside:
                yield "text", inside
            if end is None:
                break
            at = end.start()
    if "".join(text):
        yield "text", "".join(text)
    for element in reversed(stack):
        yield "close", element


_PARENTS, _REGIONS = Selectors(SKIPPED_PARENTS), Selectors(SKIPPED_REGIONS)


class Page:
    """What one run over the markup finds: ``shown`` text, ``links`` and ``artifacts``, as far as they are asked for."""

    def __init__(self, html: str, url: str | None = None, selectors: Selectors | None = None, text: bool = False, links: bool = False):
        self.url = url or ""
        self.shown: list[str] = []
        self.visible: list[str] = []
        self.hrefs: list[str] = []
        self.based = False
        self.hits: list[tuple[int, int, str, str]] = []
        self.texts: list[str] = []
        opened: list[tuple[int, int]] = []
        # Of each open element: whether it skips its own texts, whether it skips all texts inside, is invisible, is not displayed.
        state: list[tuple[bool, bool, bool, bool]] = [(False, False, False, False)]
        for place, (kind, what) in enumerate(elements(html)):
            if kind == "open":
                if text or links:
                    state.append(self._state(what, state[-1], text))
                if links:
                    self._link(what)
                if selectors:
                    opened.append((place, len(self.texts)))
            elif kind == "close":
                if text or links:
                    state.pop()
                if links and what.name not in INLINE_ELEMENTS:
                    self.visible.append(" ")
                if selectors:
                    self._artifact(what, selectors, *opened.pop())
            else:
                if selectors:
                    self.texts.append(what)
                own, region, unseen, gone = state[-1]
                if links and not (unseen or gone):
                    self.visible.append(what)
                if text and not (own or region or unseen) and not _BUTTON.fullmatch(what.strip()):
                    self.shown.append(unescape(what))

    def _state(self, element: Element, around: tuple, text: bool) -> tuple[bool, bool, bool, bool]:
        _, region, unseen, gone = around
        none = element.name in UNSEEN_ELEMENTS or (bool(element.source) and element.style("display") == "none")
        visibility = element.style("visibility") if element.source else ""
        unseen = visibility == "hidden" if visibility else unseen
        if not text:
            return False, False, unseen, gone or none
        return _PARENTS.any_of(element) or none, region or _REGIONS.any_of(element), unseen, gone or none

    def _link(self, element: Element) -> None:
        if element.name not in INLINE_ELEMENTS:
            self.visible.append(" ")
        if element.name not in ("a", "base") or "href" not in element.attributes:
            return
        href = element.attributes["href"].strip().translate({9: None, 10: None, 13: None})
        if element.name == "a":
            self.hrefs.append(href)
        elif not self.based:
            self.url, self.based = absolute(self.url, href), True

    def _artifact(self, element: Element, selectors: Selectors, begin: int, first: int) -> None:
        matching = selectors.matching(element)
        if matching:
            content = unescape("".join(self.texts[first:])).strip()
            language = element.attributes.get("data-language") or "unknown"
            self.hits += [(k, begin, content, language) for k in matching]

    @property
    def links(self) -> list[str]:
        """Distinct http addresses: targets first, which a ``base`` of the page may move, then those in the visible text."""
        targets = [u for u in (absolute(self.url, h) for h in self.hrefs) if u.startswith("http")]
        said = [u.rstrip(LINK_END) for u in _LINK.findall(unescape("".join(self.visible)))]
        return list(dict.fromkeys([*targets, *said]))

    @property
    def artifacts(self) -> list[tuple[int, str, str]]:
        return [(k, content, language) for k, _, content, language in sorted(self.hits)]


def absolute(page_url: str, href: str) -> str:
    """A link target as the browser resolves it against the page address."""
    try:
        return urljoin(page_url, href)
    except ValueError:
        return href


def shown_text(html: str) -> str:
    """Text nodes that are visible conversation text, one after the other."""
    return "".join(Page(html, text=True).shown)


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``page_text``.  Nesting is followed by one pass per page; Arrow batches carry only the markup."""

    @F.pandas_udf("string")
    def shown(markup: pd.Series) -> pd.Series:
        return markup.map(shown_text, na_action="ignore")

    return pages.withColumn("page_text", tx.norm_text(shown(F.col(html))))


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Distinct http links of a page in order: targets of ``a`` elements first, then links in the visible text."""

    @F.pandas_udf("array<string>")
    def found(markup: pd.Series, address: pd.Series) -> pd.Series:
        return pd.Series([Page(m, u, links=True).links if m else [] for m, u in zip(markup, address)], dtype=object)

    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(found(F.col(html), F.col(url))).alias("pos", "link"))


def page_artifacts(pages: DataFrame, html: str = "html", selectors: list[str] | None = None) -> DataFrame:
    """Elements that match a selector and hold more than ten characters, once per selector; nested elements are whole."""
    wanted = selectors or ARTIFACT_SELECTORS

    @F.pandas_udf("array<struct<selector:string,content:string,language:string>>")
    def found(markup: pd.Series) -> pd.Series:
        parsed = Selectors(wanted)
        return pd.Series([_named(Page(m, selectors=parsed), wanted) if m else [] for m in markup], dtype=object)

    kept = [c for c in pages.columns if c != html]
    return _artifact_rows(pages.select(*kept, F.posexplode(found(F.col(html))).alias("pos", "hit")), kept)


def _named(page: Page, wanted: list[str]) -> list[dict]:
    return [{"selector": wanted[k], "content": content, "language": language} for k, content, language in page.artifacts]


def _artifact_rows(rows: DataFrame, kept: list[str | Column]) -> DataFrame:
    return rows.select(
        *kept,
        "pos",
        F.lit("artifact").alias("type"),
        tx.strip(F.col("hit.content")).alias("content"),
        F.col("hit.language").alias("language"),
        F.col("hit.selector").alias("selector"),
    ).where(F.length("content") > 10)


def page_contents(pages: DataFrame, html: str = "html", url: str = "url", selectors: list[str] | None = None) -> DataFrame:
    """Adds ``page_text``, ``links`` and ``artifacts`` (selector, content, language) of a page, all from one run over its markup."""
    wanted = selectors or ARTIFACT_SELECTORS
    kind = "struct<shown:string,links:array<string>,artifacts:array<struct<selector:string,content:string,language:string>>>"

    @F.pandas_udf(kind)
    def read(markup: pd.Series, address: pd.Series) -> pd.DataFrame:
        parsed, rows = Selectors(wanted), []
        for m, u in zip(markup, address):
            page = Page(m or "", u, parsed, text=True, links=True)
            rows.append((None if m is None else "".join(page.shown), page.links, _named(page, wanted)))
        return pd.DataFrame(rows, columns=["shown", "links", "artifacts"])

    found = pages.withColumn("_page", read(F.col(html), F.col(url)))
    own = [c for c in pages.columns if c != html]
    long = F.filter(F.transform("_page.artifacts", lambda a: a.withField("content", tx.strip(a["content"]))), lambda a: F.length(a["content"]) > 10)
    return found.select(*own, tx.norm_text(F.col("_page.shown")).alias("page_text"), F.col("_page.links").alias("links"), long.alias("artifacts"))
