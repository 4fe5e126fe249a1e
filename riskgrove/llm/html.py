"""Main text of web pages by tree scoring.

A page becomes a light tree of its elements. Runs of text between block boundaries are blocks.
Paragraphs pass points for length and commas to their ancestors, less with each step up; a
container's points are discounted by its link density. The article or main around the best
container is kept; on pages without one, the container and its siblings that are no link lists.

Elements that look like something else are marked while reading, and left out once the whole page
is known: a mark does not count on an element that wraps the article itself.
"""

from __future__ import annotations

import heapq
import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskgrove.llm.common import plain_strings, quoted, text_of

#: Elements whose content is never text, those without content, and those that end a block.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head select textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: An opening tag ends an open element of these names, up to the container named last.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Elements, roles and words in class or id that mark what is not the article.
OUTSIDE = frozenset("nav footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|comments?|commentlist|disqus|replies|respond|sidebars?|side-?bar|widgets?|menu|nav|"
    r"navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|pagination|pager|share|sharing|social|"
    r"related|recommend\w*|teaser|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Marks by how much it takes to lift them: layouts are often named after what stands beside the
#: article, comments and the like hardly ever; elements and roles say what they are.
SOFT, FIRM, FIXED = 1, 2, 3
WRAPPERS = frozenset("form button dialog".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond|footer|cookies?|consent|gdpr|related|recommend\w*)(?:$|[\s_-])"
    r"|^sidebars?$",
    re.IGNORECASE,
)
#: Words in class or id that say how a page is laid out, not what an element is.
LAYOUT = ("has-", "with-", "no-", "without-")
#: Classes and ids of a page's header.
HEADERS = frozenset("header site-header page-header main-header global-header top-header".split())
LIKELY = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "article", "main"))
TOP = frozenset(("", "html", "body"))
HEAD = frozenset(("head", "title"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))

_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")

#: Levels that the points of a block reach upwards, so deep pages take time in proportion.
REACH = 24


class Ends:
    """Where tags end, in time linear in the page.

    A tag ends at the first > outside of quotes, or with the page; a tag with a quote that is never
    closed has no end and is text. What was found behind a closing quote is remembered, and so is
    the stretch in front of the next stop.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = {q: source.rfind(q) for q in "\"'"}
        self.known: dict[int, int] = {}
        self.clear = (0, -1)  # from here up to the next stop there is none

    def _stop(self, at: int) -> int:
        low, stop = self.clear
        if not low <= at <= stop:
            found = _STOP.search(self.source, at)
            stop = found.start() if found else len(self.source)
            self.clear = (at, stop)
        return stop

    def of(self, at: int) -> int:
        """The place behind the tag whose attributes begin here, -1 if it has no end."""
        passed = []
        while True:
            if at in self.known:
                end = self.known[at]
                break
            passed.append(at)
            stop = self._stop(at)
            if stop >= len(self.source):
                end = stop
                break
            mark = self.source[stop]
            if mark == ">":
                end = stop + 1
                break
            if stop >= self.last[mark]:
                end = -1
                break
            at = self.source.find(mark, stop + 1) + 1
        self.known.update(dict.fromkeys(passed, end))
        return end


class Node:
    """An element. ``cut`` ones hold no text, ``out`` ones none of the article. ``near`` is the
    nearest marked element from here up, ``inline`` the same within a run of inline elements,
    ``block`` the nearest element that is not inline, ``likely`` the outermost article or main."""

    __slots__ = (
        "tag", "parent", "cut", "mark", "near", "inline", "block", "likely", "out", "kept", "points", "chars", "linked"
    )

    def __init__(self, tag: str, parent: Node | None, cut: bool, mark: int):
        self.tag, self.parent, self.cut, self.mark, self.out = tag, parent, cut, mark, False
        self.near = self if mark else parent.near if parent is not None else None
        self.inline, self.block, self.kept = None, self, False
        if tag in INLINE:
            self.inline, self.block = self if mark else parent.inline, parent.block
        self.likely = parent.likely if parent is not None else None
        if tag in LIKELY and self.likely is None:
            self.likely = self
        self.points, self.chars, self.linked = 0.0, 0, 0


class Page:
    """The tree of one page: nodes in page order and blocks (node, text, characters in links)."""

    def __init__(self, source: str):
        self.root = Node("", None, False, 0)
        self.nodes = [self.root]
        self.blocks: list[tuple[Node, str, int]] = []
        self._open = [self.root]
        self._depths: dict[str, list[int]] = {}  # of the open elements of each tag
        self._blocks: list[int] = [0]  # of the open elements that are not inline
        self._pieces: list[tuple[str, bool, Node | None]] = []
        self._links = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, end, ends = 0, len(source), Ends(source)
        while at < end:
            start = source.find("<", at)
            if start < 0:
                self._text(source[at:])
                break
            skipped, tag = _SKIPPED.match(source, start), _NAME.match(source, start)
            stop = skipped.end() if skipped else ends.of(tag.end()) if tag else -1
            if stop < 0:  # no markup
                self._text(source[at : start + 1])
                at = start + 1
                continue
            self._text(source[at:start])
            at = stop
            if skipped:
                continue
            name = tag[2].lower()
            if tag[1]:
                self._close(name)
                continue
            attributes = source[tag.end() : stop]
            self._start(name, attributes[:-1] if attributes.endswith(">") else attributes)
            if name in RAW:  # its content holds no markup
                found = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                at = found.end() if found else end
                self._close(name)
        self._flush()

    def _text(self, piece: str) -> None:
        node = self._open[-1]
        if piece and not node.cut:
            self._pieces.append((html.unescape(piece) if "&" in piece else piece, self._links > 0, node.inline))

    def _flush(self) -> None:
        if not self._pieces:
            return
        runs: dict[Node | None, list[tuple[str, bool]]] = {}
        for piece, inside, marked in self._pieces:
            runs.setdefault(marked, []).append((piece, inside))
        for marked, pieces in runs.items():
            text = _SPACE.sub(" ", "".join(p for p, _ in pieces)).strip()
            if text:
                linked = sum(len(p.strip()) for p, inside in pieces if inside)
                node = marked or self._open[-1].block
                self.blocks.append((node, text, min(linked, len(text))))
        self._pieces = []

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "wbr":
            if name == "br" and not self._open[-1].cut:
                self._pieces.append((" ", False, self._open[-1].inline))
            return
        if name not in INLINE:
            self._flush()
        if name in CLOSES_P:
            self._pop({"p"}, {"td", "th", "table", "button", "object"})
        if name in ENDS:
            self._pop(*ENDS[name])
        if name in VOID:
            return
        parent = self._open[-1]
        cut, mark = parent.cut or name in SILENT, 0
        if not cut:
            named = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
            cut = name not in WHOLE and self._hidden(named)
            mark = 0 if cut else self._mark(name, named)
        node = Node(name, parent, cut, mark)
        self.nodes.append(node)
        self._depths.setdefault(name, []).append(len(self._open))
        if name not in INLINE:
            self._blocks.append(len(self._open))
        self._open.append(node)
        self._links += name == "a"

    @staticmethod
    def _hidden(named: dict[str, str]) -> bool:
        if "hidden" in named or named.get("aria-hidden", "").lower() == "true":
            return True
        return bool(re.search(r"display\s*:\s*none", named.get("style", "")))

    def _mark(self, name: str, named: dict[str, str]) -> int:
        """How firmly an element looks like something else than the article; 0 for not at all."""
        if name in OUTSIDE:
            return SOFT if name in WRAPPERS else FIXED
        inside = self._open[-1].likely
        if name == "header":  # of the page; the header of an article holds its title
            return 0 if inside else FIXED
        if not named or name in WHOLE:
            return 0
        if named.get("role", "").lower() in ROLES:
            return FIXED
        words = [w for key in ("class", "id") for w in named.get(key, "").split()]
        if not inside and any(w.lower() in HEADERS for w in words):
            return FIRM
        marks = [w for w in words if not w.lower().startswith(LAYOUT) and UNLIKELY.search(w)]
        return FIRM if any(NAMED.search(w) for w in marks) else SOFT if marks else 0

    def article_blocks(self) -> list[tuple[Node, str, int]]:
        """The blocks outside of marked elements.

        Marks that wrap the article are lifted, outermost first: on an element that holds the only
        article or main, on a soft one that holds most of the points, and, if nothing else has
        points, on the one named by class that holds the most of them.
        """
        marks = [n for n in self.nodes if n.mark]
        if not marks:
            return self.blocks
        none = self.root
        own, holds, below = {none: 0.0}, {none: 0}, {none: []}
        for node in marks:
            own[node], holds[node], below[node] = 0.0, 0, []
        up = {m: m.parent.near or none for m in marks}
        for node, text, linked in self.blocks:
            own[node.near or none] += _points(node, text, linked)
        for node in {node.likely for node, _, _ in self.blocks if node.likely}:
            holds[node.near or none] += 1
        free, likely = own[none], holds[none]
        weight = dict(own)
        for node in reversed(marks):
            below[up[node]].append(node)
            holds[up[node]] += holds[node]
            if node.mark == SOFT or holds[node]:
                weight[up[node]] += weight[node]
        total = weight[none]
        edge = below[none]

        def wraps(m: Node) -> bool:
            if not weight[m]:
                return False
            if holds[m] == 1 and (m.mark == SOFT) + (not likely) + (weight[m] > free) >= 2:
                return True
            if m.mark == SOFT and weight[m] * 2 > total and (m.likely or not likely):
                return True
            return m.mark != FIXED and not free

        # What does not wrap now never will, as free and likely only grow: each mark is seen once.
        lifted, count = set(), itertools.count()
        heap = [(-weight[m], next(count), m) for m in edge]
        heapq.heapify(heap)
        while heap:
            found = heapq.heappop(heap)[2]
            if not wraps(found):
                continue
            lifted.add(found)
            for m in below[found]:
                heapq.heappush(heap, (-weight[m], next(count), m))
            free += own[found]
            likely += holds[found] - sum(holds[m] for m in below[found])
        for node in self.nodes:
            node.out = node.mark > 0 and node not in lifted or node.parent is not None and node.parent.out
        return [b for b in self.blocks if not b[0].out]

    def _deepest(self, names: set[str]) -> int:
        return max((self._depths[n][-1] for n in names if self._depths.get(n)), default=0)

    def _pop(self, names: set[str], limit: set[str]) -> None:
        depth = self._deepest(names)
        if depth and depth >= self._deepest(limit):
            self._cut(depth)

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        depth = self._deepest({name})
        if depth and (name not in INLINE or depth > self._blocks[-1]):
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        for node in reversed(self._open[depth:]):
            self._links -= node.tag == "a"
            self._depths[node.tag].pop()
            if node.tag not in INLINE:
                self._blocks.pop()
        del self._open[depth:]


def main_text(source: str) -> str:
    """The blocks of the best container and its like siblings, joined by blank lines.

    It takes time in proportion to the page; points reach ``REACH`` levels up.
    """
    page = Page(source)
    blocks = page.article_blocks()
    if not blocks:
        return ""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        points = _points(node, text, linked)
        if not points:
            continue
        up: Node | None = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        step = 1
        while up is not None and step <= REACH:
            up.points += points / step
            up, step = up.parent, step + 1
    for node in reversed(page.nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    best, most = page.root, -1.0
    for node in page.nodes:
        if node.chars and not node.out and node.tag not in PARAGRAPHS and node.tag not in HEADINGS:
            score = _score(node)
            if score > most:
                best, most = node, score
    whole = best.likely
    best = whole or best  # a part of an article stands for all of it
    while not whole and best.parent is not None and best.parent.tag not in TOP and best.parent.chars == best.chars:
        best = best.parent  # a wrapper of nothing else
    best.kept = True
    if best.parent is not None and best.tag not in TOP:
        least = max(10.0, most * 0.2)
        for node in page.nodes:
            if node.parent is best.parent and node is not best and node.chars and not node.mark and node.tag not in HEAD:
                density = node.linked / node.chars
                # beside an article only what is as good; else all parts but lists of links
                like = _score(node) >= least if whole else density < 0.25
                if node.tag == "p" or node.tag in HEADINGS:
                    like = like or density < 0.25 and (node.chars > 80 or node.tag in HEADINGS) or not node.linked
                node.kept = node.kept or like
    for node in page.nodes:
        node.kept = node.kept or node.parent is not None and node.parent.kept
    return "\n\n".join(text for node, text, _ in blocks if node.kept)


def _points(node: Node, text: str, linked: int) -> float:
    """Points of a block; headings have none."""
    if node.tag in HEADINGS:
        return 0.0
    points = min(len(text) / 100, 3.0) + text.count(",") + (1.0 if len(text) >= 25 else 0.1)
    return points * (1 - linked / len(text))


def _score(node: Node) -> float:
    bonus = 1.5 if node.tag in LIKELY else 1.0
    return node.points * bonus * (1 - node.linked / node.chars)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(s) for s in plain_strings(batch.column("html")).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row"), texts], names=["row", "text"])


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the columns in ``carry``, by default all) and ``text`` for every page.

    ``text`` is the main text: character references decoded, white space inside a block turned
    into one space, blocks in page order joined by two line feeds; nothing else is dropped or
    cut. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    reader comments are left out by element, role, class or id. A null or empty page, or one
    without any text, gives the empty text; a page without markup is one block. Equal pages have
    equal texts; an empty table gives an empty table.
    """
    row = F.struct(*[quoted(c).alias(c) for c in carry or pages.columns]).alias("row")
    rows = pages.select(row, text_of(html_col).alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType(), False)])
    return rows.mapInArrow(_text_batches, schema)
