"""HTML extraction by minimum-cut labelling: blocks are content or boilerplate at the least total cost."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices, text_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "template", "title", "textarea", "svg", "iframe", "object", "noscript"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the names after the bar.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"html", "head", "body"}
FURNITURE = {"nav", "footer", "aside", "button", "select", "label", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Some pages lie in one form as a whole, so a form counts like a word.
FORMS = {"form", "fieldset"}
#: Words of class and id names that mark furniture of a page.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert newsletter subscribe signup paywall popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer sidebar aside related recommended recommendations widget share sharing social comment comments commentlist respond reply replies disqus login search skip toolbar masthead sitemap copyright disclaimer".split()
)
HEADER_MARKS = {"header", "topbar", "masthead"}
#: Names that begin or end with these tell a state of an element that has such furniture somewhere (has-sidebar, comments-open).
BEFORE = {"has", "have", "with", "without", "no", "is", "hide", "hides", "show", "shows"}
AFTER = {"open", "closed", "enabled", "disabled", "on", "off", "active", "left", "right", "none"}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Smoothness: cost of a label change between blocks next to each other, and between those with one parent.
NEXT, SIBLING = 4, 6
#: Cost of a block inside furniture by its tag or role, and at most by all ancestors together; cost of a form or a word.
CERTAIN, LIKELY = 120, 60
#: Shares of the page's text (that the classifier likes): an element with the first or less costs all, with the second or more,
#: as a wrapper of the page, nothing.
PART, WRAPPER = 1 / 2, 2 / 3


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    score: int  # over 0: cost of calling it boilerplate; under 0: of calling it content
    article: bool = False  # inside an article or main element
    mark: int = 0  # the innermost ancestor that a tag, role or name marks as furniture; 0 if there is none


def _marks(attrs: dict[str, str]) -> set[str]:
    names = [[p.lower() for p in NAME_PART.findall(x)] for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    return {p for x in names if x and not (len(x) > 1 and (x[0] in BEFORE or x[-1] in AFTER)) for p in x}


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def parse(page: str) -> list[Block]:
    """Blocks of text in page order, each with its parent element and its classifier score."""
    blocks: list[Block] = []
    # Marked elements: the next one around it, and whether it is certain.
    marked: list[tuple[int, bool]] = [(0, False)]
    # Open elements: name, number, innermost marked element, inside an article or main element, inside a page header.
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    # How many elements of a name are open, and where in the stack the block elements are.
    opened: Counter[str] = Counter()
    holders = [0]
    parts: list[str] = []
    state = {"links": 0, "chars": 0, "in_link": 0, "p": 0}
    number, at, size = 0, 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        links, chars = state["links"], state["chars"]
        state["links"] = state["chars"] = 0
        if text:
            holder = stack[holders[-1]]
            blocks.append(Block(text, holder[1], holder[0], classify(text, holder, links / max(1, chars)), holder[3], holder[2]))

    def close(depth: int) -> None:
        state["in_link"] -= sum(x[0] == "a" for x in stack[depth:])
        state["p"] -= sum(x[0] == "p" for x in stack[depth:])
        opened.subtract(x[0] for x in stack[depth:])
        while holders[-1] >= depth:
            holders.pop()
        del stack[depth:]

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            parts.append(text)
            n = len(text.strip())
            state["chars"] += n
            if state["in_link"]:
                state["links"] += n
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name) if opened[name] else 0
            if name in BLOCKS:
                flush()
            if depth:
                close(depth)
            continue
        if name in RAW:
            if name != "svg" or not m["attrs"].rstrip().endswith("/"):  # of these, a slash ends an svg only
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            if name in ENDS_P and state["p"]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"))
            if name in ENDS:
                ends, until = ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in ends:
                        close(k)
                        break
        attrs = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(m["attrs"])} if m["attrs"].strip(" /\n\t") else {}
        _, _, mark, article, header = stack[-1]
        marks = _marks(attrs)
        whole = name in ("html", "body", "main", "article")
        role = attrs.get("role", "").lower()
        certain = name in FURNITURE or role in ROLES or _hidden(attrs)
        likely = name in FORMS or role == "form" or (bool(marks & MARKS) if not whole else name == "article" and bool(marks & {"comment", "reply", "ad", "advert", "sponsored", "promo", "related"}))
        if certain or likely:
            marked.append((mark, certain))
            mark = len(marked) - 1
        header |= not article and (name == "header" or bool(marks & HEADER_MARKS) and not whole)
        article |= name in ("article", "main") or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        number += 1
        if name in BLOCKS:
            holders.append(len(stack))
        stack.append((name, number, mark, article, header))
        opened[name] += 1
        state["in_link"] += name == "a"
        state["p"] += name == "p"
    flush()
    costs = mark_costs(blocks, marked)
    for b in blocks:
        b.score += (30 if b.article and costs[b.mark] < LIKELY // 2 else 0) - costs[b.mark]
    if any(b.article and b.score > 0 and costs[b.mark] < LIKELY // 2 for b in blocks):  # the page names its article: what lies outside is less likely content
        for b in blocks:
            b.score -= 0 if b.article else 25
    return blocks


def mark_costs(blocks: list[Block], marked: list[tuple[int, bool]]) -> list[int]:
    """By marked element, what it and those around it cost a block: less the more of the page's text it holds, and bounded."""
    sure = [False] * len(marked)
    for k in range(1, len(marked)):
        sure[k] = marked[k][1] or sure[marked[k][0]]
    below = [0] * len(marked)
    for b in blocks:
        if b.score > 0 and not sure[b.mark]:
            below[b.mark] += len(b.text)
    for k in range(len(marked) - 1, 0, -1):  # an element comes after those around it
        below[marked[k][0]] += below[k]
    costs = [0] * len(marked)
    for k in range(1, len(marked)):
        share = below[k] / max(1, below[0])
        own = CERTAIN if marked[k][1] else round(LIKELY * min(1, max(0, WRAPPER - share) / (WRAPPER - PART)))
        costs[k] = min(CERTAIN, costs[marked[k][0]] + own)
    return costs


def classify(text: str, holder: tuple[str, int, int, bool, bool], links: float) -> int:
    """Log odds of content, in tenths, apart from marked ancestors and the article."""
    name, _, _, _, header = holder
    words = len(text.split())
    score = 6 + (10 if name in ("p", "blockquote", "pre") else 8 if name in ("h1", "h2", "h3") else 0)
    score += 20 if words >= 30 else 12 if words >= 12 else 0 if words >= 5 else -5
    score += 5 if text[-1] in ".!?…:;\"'”»" else 0
    if links > 0.5:
        score -= 25
    if header:
        score -= 60
    if re.search(r"©|\(c\) ?[12]\d\d\d|all rights reserved", text, re.I) and words < 40:
        score -= 30
    return score


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each block whether it is on the content side of the minimum cut, found by maximum flow.

    Level by level: a search from the content terminal, then blocking paths that keep no recursion.
    """
    n = len(scores)
    if all(s > 0 for s in scores) or all(s <= 0 for s in scores):
        return [s > 0 for s in scores]
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, s in enumerate(scores):
        if s > 0:
            link(source, i, s, 0)
        elif s < 0:
            link(i, sink, -s, 0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str) -> str:
    """The content blocks of a page, joined by line feeds."""
    blocks = parse(page)
    edges, before = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT))
        if b.parent in before:
            edges.append((before[b.parent], i, SIBLING))
        before[b.parent] = i
    kept = minimum_cut([b.score for b in blocks], edges)
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text (empty if there is none).

    A null page counts as empty. Pages are read whole where they are; nothing is shuffled. Repeated rows each get a
    result, an empty table gives an empty one, and only the three named columns are read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            texts = pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string")
