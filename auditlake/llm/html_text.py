"""Main text of web pages by tree scoring.

The tags of a page make a tree of containers and blocks. A paragraph earns points
for its length and its commas and passes them to its parent, half to the
grandparent, and less to those above; a container's points are discounted by the
share of its text that is in links. The best container is kept with what is not
boilerplate or links in the same wrapper; boilerplate containers inside are left
out. Around a container that is named as content, or right in the body, the
siblings kept are those that score well, prose, and what lies between these.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.workers import map_arrow

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f\v]+")

# Roles of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object noembed noframes xmp".split())
DROPPED = set("head nav header footer aside form button select option fieldset menu dialog canvas audio video input".split()) | RAW
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br caption".split()
)
SCORED = set("p pre td blockquote li dd h2 h3 h4".split())
CLOSED_BY = {
    "p": BLOCKS - {"br"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
# Own choice: words of a class, id or role that name what is not the article, and what is.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|"
    r"comment\w*|respond|disqus|sidebar|side|aside|widget|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|toolbar|footer|foot|header|"
    r"masthead|share\w*|social|related|recommend\w*|login|signup|search|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
WANTED = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body|text)(?:$|[\s_-])", re.I)
SIBLING_SHARE = 0.2  # of the best score that a sibling needs to be kept outside the wrapper
LINKED = 0.3  # share of the text in links from which a sibling is no prose
SHORT = 25  # characters below which a paragraph earns nothing


@dataclass
class Element:
    name: str
    parent: "Element | None"
    unwanted: bool = False
    wanted: bool = False
    parts: list["Element | str"] = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    in_article: bool = False

    def __post_init__(self):
        self.in_article = self.parent is not None and (self.parent.in_article or self.parent.name == "article")


def tree(page: str) -> Element:
    """The elements of a page; broken markup is closed as it goes, comments and raw elements are left out."""
    root = at = Element("#root", None)
    opened: Counter[str] = Counter()
    last = 0

    def leave(element: Element) -> Element:
        """Closes everything up to an element; what holds it is current again."""
        above = at
        while above is not element:
            opened[above.name] -= 1
            above = above.parent
        opened[element.name] -= 1
        return element.parent

    size = len(page)
    while last < size:
        token = TOKEN.search(page, last)
        if token is None:
            at.parts.append(html.unescape(page[last:]))
            break
        if token.start() > last:
            at.parts.append(html.unescape(page[last : token.start()]))
        last = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA["):
                at.parts.append(token[0][9:].removesuffix("]]>"))
            continue
        if token["end"]:
            if opened[name]:
                above = at
                while above.name != name:
                    above = above.parent
                at = leave(above)
            elif name == "p":
                at.parts.append(Element("br", at))
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|$)[^>]*(?:>|\\Z)", re.I).search(page, last)
            if name not in ("svg", "math") or close:
                last = close.end() if close else size
            continue
        while at is not root and name in CLOSED_BY.get(at.name, ()):
            at = leave(at)
        if opened["p"] and name in BLOCKS and name != "br":  # an open paragraph further up ends too
            above = at
            while above is not root and above.name not in BLOCKS - {"p"}:
                if above.name == "p":
                    at = leave(above)
                    break
                above = above.parent
        named = " ".join(a or b or c for key, a, b, c in ATTRIBUTE.findall(token["attributes"]) if key.lower() in ("class", "id", "role", "aria-label"))
        element = Element(name, at, bool(named and UNWANTED.search(named)), bool(named and WANTED.search(named)))
        at.parts.append(element)
        if name not in VOID and not token["attributes"].rstrip().endswith("/"):
            at = element
            opened[name] += 1
    return root


def _pieces(root: Element, dropped) -> Iterator[tuple[str, Element, str]]:
    """("open" | "text" | "close", element, text) in page order, without dropped elements; no recursion."""
    stack = [(root, iter(root.parts))]
    yield "open", root, ""
    while stack:
        element, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            yield "close", element, ""
        elif isinstance(part, str):
            yield "text", element, part
        elif not dropped(part):
            yield "open", part, ""
            stack.append((part, iter(part.parts)))


def _dropped(element: Element) -> bool:
    """Boilerplate by element or by name; the header of an article is its title and stays, whatever its name."""
    if element.name == "header" and element.in_article:
        return False
    return element.name in DROPPED or (element.unwanted and not element.wanted and element.name not in ("body", "html", "article", "main"))


def blocks(root: Element, dropped=_dropped) -> list[str]:
    """The texts between block boundaries below an element, white space made one blank."""
    found, held = [], []

    def close():
        text = SPACES.sub(" ", "".join(held)).strip(" \t\n\r\f\v")
        held.clear()
        if text:
            found.append(text)

    for kind, element, text in _pieces(root, dropped):
        if kind == "text":
            held.append(text)
        elif element.name in BLOCKS:
            close()
    close()
    return found


def _scored(root: Element) -> Element | None:
    """Scores in every element; returns the best container."""
    texts: dict[int, list[str]] = {}
    links = 0
    touched: dict[int, Element] = {}
    holders = [root]  # open blocks, the root below them
    for kind, element, text in _pieces(root, _dropped):
        if kind == "open":
            links += element.name == "a"
            if element.name in BLOCKS:
                holders.append(element)
        elif kind == "text":
            element.chars += (n := len(text.strip()))
            element.linked += n if links else 0
            texts.setdefault(id(holders[-1]), []).append(text)
        else:
            links -= element.name == "a"
            if element.name in BLOCKS:
                holders.pop()
            if element.parent is not None:
                element.parent.chars += element.chars
                element.parent.linked += element.linked
            own = SPACES.sub(" ", "".join(texts.pop(id(element), []))).strip()
            if len(own) >= SHORT and (element.name in SCORED or element.name in BLOCKS):
                points = 1 + own.count(",") + min(len(own) / 100, 30.0)
                # Text right in a container is a paragraph of its own; a paragraph's points go to what holds it.
                above = element.parent if element.name in SCORED and element.parent is not None else element
                share = 1.0
                while above is not None and share > 1e-6:
                    above.score += points * share
                    touched[id(above)] = above
                    share = share / 2 if share == 1.0 else share / 3
                    above = above.parent
    best, best_score = None, 0.0
    for element in touched.values():
        element.score *= 1 - (element.linked / element.chars if element.chars else 0.0)
        if element.wanted or element.name in ("article", "main"):
            element.score *= 1.25
        if element.score > best_score:
            best, best_score = element, element.score
    return best


def _top(element: Element) -> bool:
    return element.parent is None or element.name in ("body", "html")


def _with_siblings(child: Element, inner: Element, least: float) -> Element:
    """The parent of an element with what is kept in it; ``inner`` stands for the element itself."""
    groups: list[list[Element | str]] = []  # blocks, and runs of what is in line
    inline = False
    for part in child.parent.parts:
        if isinstance(part, Element) and _dropped(part):
            continue
        block = part is child or (isinstance(part, Element) and part.name in BLOCKS)
        if inline and not block:
            groups[-1].append(part)
        else:
            groups.append([part])
        inline = not block

    chosen, prose = [], []
    for group in groups:
        elements = [p for p in group if isinstance(p, Element)]
        chars = sum(p.chars for p in elements) + sum(len(p.strip()) for p in group if isinstance(p, str))
        prose.append(chars > 0 and sum(p.linked for p in elements) < LINKED * chars)
        named = any(p.name in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol", "table") for p in elements)
        chosen.append(group[0] is child or any(p.score >= least for p in elements) or (named and prose[-1]))
    if not _top(child.parent) and not child.wanted:  # one wrapper
        first, last = 0, len(groups)
    else:
        first, last = chosen.index(True), len(chosen) - chosen[::-1].index(True)
    parts: list[Element | str] = []
    for k, group in enumerate(groups):
        bare = isinstance(group[0], Element) and group[0].name in BLOCKS and not group[0].chars  # a line break or the like
        if chosen[k] or bare or (first <= k < last and prose[k]):
            parts += [inner if p is child else p for p in group]
    return Element(child.parent.name, child.parent.parent, parts=parts)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, joined by one blank; empty if there is none."""
    if not page:
        return ""
    root = tree(page)
    best = _scored(root)
    if best is None:  # nothing of a paragraph's length: what an article, main or body holds
        for name in ("article", "main", "body"):
            for kind, element, _ in _pieces(root, _dropped):
                if kind == "open" and element.name == name and (found := blocks(element)):
                    return " ".join(found)
        return " ".join(blocks(root))
    above = best
    while above is not None and above.name not in ("article", "main"):
        above = above.parent
    if above is not None:
        best = above
    if best.parent is None or best.name in ("article", "main", "body"):
        kept = [best]
        if best.parent is not None and best.name == "article":
            kept = [p for p in best.parent.parts if isinstance(p, Element) and not _dropped(p) and (p is best or p.name == "article")]
    else:
        kept, at = [best], best
        while True:
            kept, at = [_with_siblings(at, kept[0], max(1.0, SIBLING_SHARE * best.score))], at.parent
            above = at
            while not _top(above) and not above.parent.wanted:
                above = above.parent
            if _top(at) or _top(above) or _top(above.parent):
                break
    return " ".join(text for element in kept for text in blocks(element))


def extract(pages: DataFrame, html_column: str = "html", id: str = "page_id", keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, text) per row: the main text of the whole page.

    Null, empty and textless pages give an empty text. Rows are independent:
    repeats and null ids stay, an empty table gives no row, no kept column clashes.
    """
    names = [id, *(keep or [])]
    places = [f"_{k}" for k in range(len(names))]
    rows = pages.select(*(F.col(n).alias(p) for n, p in zip(names, places)), F.col(html_column).alias("_html"))
    kinds = [f"{p} {rows.schema[p].dataType.simpleString()}" for p in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], texts], names=[*places, "_text"])

    return map_arrow(rows, run, ", ".join([*kinds, "_text string"])).toDF(*names, "text")
