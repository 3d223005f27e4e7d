"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import map_arrow, table

# Elements whose text is never shown as text of the page.
SILENT = frozenset(
    "script style noscript template iframe object svg canvas audio video map head".split()
)
# Elements that may stand in a head; any other ends a head that was left open.
IN_HEAD = frozenset(
    "base basefont bgsound link meta title style script noscript template head html".split()
)
# Of the silent ones and others, elements whose content is no markup.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder".split()
)
CONTROLS = frozenset("form button select option textarea input fieldset dialog menu".split())
FRAMES = frozenset("nav footer aside".split())
BODIES = frozenset("article main".split())
# Words in class, id and role of an element that speak for boilerplate or for content.
CLUTTER = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead comment comments reply "
    "replies discussion disqus ad ads advert adverts advertisement advertising sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice alert notification popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended breadcrumb breadcrumbs pagination pager widget toolbar search contentinfo "
    "complementary dialog copyright legal disclaimer".split()
)
BODY_WORDS = frozenset("article content main story entry post body articlebody".split())

# A header named like these heads an article; first words of names that only tell a state.
HEADER_WORD = "header"
STATES = frozenset("has with without no not is js".split())

# Costs are log-odds. On a page without any article, text that nothing speaks against is content.
BARE = 2.5
# Evidence from the page's structure outweighs all smoothing at a block.
STRUCTURE, FEATURE = 8.0, 1.0
# Smoothness between neighbouring blocks, and between a block and the last one in the same element
# or in an element beside it.
ADJACENT, SAME_PARENT = 0.6, 0.9

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)",
    re.DOTALL,
)
_MARKS = re.compile(
    r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE
)
_WORDS = re.compile(r"[a-z]+")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
_DISPLAY_NONE = re.compile(r"style\s*=\s*[\"']?[^\"']*display\s*:\s*none", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """A run of text without a block boundary inside."""

    __slots__ = ("parent", "outer", "region", "parts", "linked", "evidence")

    def __init__(self, parent: int, region: int):
        # The block element it is in, the element around that, the innermost element.
        self.parent, self.outer, self.region, self.evidence = parent, 0, region, 0.0
        self.parts: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role speak for clutter, and for a body of text.

    A name is judged as a whole: ``post-comments`` are comments, ``entry-footer`` is a footer.
    ``entry-header`` belongs to its entry, and names such as ``has-sidebar`` tell a state of
    something else. A name that only mentions clutter before its last word (``menu-open``) loses
    against another name that speaks for a body.
    """
    strong = weak = body = False
    for value in _MARKS.findall(attributes):
        for name in _CAMEL.sub("-", value.strip("\"'")).lower().split():
            words = _WORDS.findall(name)
            if not words or words[0] in STATES:
                continue
            bodies, clutter = BODY_WORDS.intersection(words), CLUTTER.intersection(words)
            if clutter and not (bodies and clutter == {HEADER_WORD}):
                strong, weak = strong or words[-1] in CLUTTER, True
            elif bodies:
                body = True
    return strong or (weak and not body), body


def _hidden(attributes: str) -> bool:
    bare = _QUOTED.sub(" ", attributes)
    return bool(_HIDDEN.search(bare) or _DISPLAY_NONE.search(attributes))


class Regions:
    """The elements of a page as a tree, parents before children, and what speaks for each."""

    def __init__(self):
        self.parent, self.name = [0], [""]
        self.clutter, self.body = [False], [False]

    def add(self, parent: int, name: str, attributes: str) -> int:
        clutter, body = _marks(attributes) if "=" in attributes else (False, False)
        self.parent.append(parent)
        self.name.append(name)
        self.clutter.append(
            name in FRAMES or name in CONTROLS or (clutter and name not in ("body", "html"))
        )
        self.body.append(body or name in BODIES)
        return len(self.name) - 1

    def evidence(self, sizes: list[int]) -> list[float]:
        """Per element: positive inside bodies of text, negative inside clutter, else 0.

        ``sizes`` is the length of each element's own text. Clutter stays clutter whatever it
        contains, but for the page's principal body: an element round that one is no more than
        its frame, as a form round a whole page is.
        """
        n = len(self.name)
        whole = list(sizes)
        for k in range(n - 1, 0, -1):
            whole[self.parent[k]] += whole[k]

        def rank(k: int) -> tuple:
            tier = {"main": 2, "article": 1}.get(self.name[k], 0)
            return tier, whole[k], -k

        bodies = [k for k in range(1, n) if self.body[k] and not self.clutter[k] and whole[k]]
        around = set()
        k = max(bodies, key=rank, default=0)
        while k:
            around.add(k)
            k = self.parent[k]
        found = [0.0] * n
        for k in range(1, n):
            outer = found[self.parent[k]]
            found[k] = outer
            header = self.name[k] == "header" and outer <= 0
            if (self.clutter[k] or header) and k not in around:
                found[k] = -STRUCTURE
            elif self.body[k] and outer >= 0:
                found[k] = STRUCTURE
        return found


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with what their surroundings say about them.

    Every end tag is looked up by its name and every element is opened and closed once, so the
    time grows with the length of the page however deep or broken its markup is.
    """
    found: list[Block] = []
    regions = Regions()
    # Open elements: name, number, number of the block element around, silent, link, and the
    # place of that block element in the stack.
    stack: list[tuple[str, int, int, bool, bool, int]] = [("", 0, 0, False, False, 0)]
    opened: Counter[str] = Counter()
    at, current = 0, None
    raw_end = None

    def add(piece: str) -> None:
        nonlocal current
        if stack[-1][3] or not piece:
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(stack[-1][2], stack[-1][1])
            found.append(current)
        current.parts.append(piece)
        if stack[-1][4]:
            current.linked += len(piece.strip())

    def close(until: int) -> None:
        nonlocal current
        for entry in stack[until:]:
            opened[entry[0]] -= 1
            if entry[0] not in INLINE:
                current = None
        del stack[until:]

    while at < len(page):
        if raw_end is not None:
            end = re.compile(rf"</{re.escape(raw_end)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            add(page[at : end.start() if end else len(page)])
            at, raw_end = (end.start() if end else len(page)), None
            continue
        token = _TOKEN.search(page, at)
        add(page[at : token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
            elif name not in INLINE:
                current = None
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name in VOID:
            if name == "br":
                add("\n")
            elif name == "hr":
                current = None
            continue
        if name not in INLINE:
            current = None
            # A new block ends an open paragraph or list item, and formatting left open in it.
            depth = stack[-1][5]
            open_name = stack[depth][0]
            if open_name == "p" or open_name == name in ("li", "td", "th", "tr", "dd", "dt"):
                close(depth)
        _, above, around, silent, link, place = stack[-1]
        if not token[3].endswith("/") or name in INLINE or name not in ("svg", "math"):
            number = regions.add(above, name, token[3])
            silent = silent or name in SILENT or _hidden(token[3])
            if name not in INLINE:
                around, place = number, len(stack)
            stack.append((name, number, around, silent, link or name == "a", place))
            opened[name] += 1
        if name in RAW:
            raw_end = name
    sizes = [0] * len(regions.name)
    for block in found:
        sizes[block.region] += sum(map(len, block.parts))
    evidence = regions.evidence(sizes)
    bodies = any(evidence[b.region] > 0 and "".join(b.parts).strip() for b in found)
    for block in found:
        block.evidence = evidence[block.region] or (0.0 if bodies else BARE)
        block.outer = regions.parent[block.parent]
    return found


def classify(block: Block, text: str) -> float:
    """Log-odds that a block is content."""
    words = text.count(" ") + 1
    dense = min(1.0, block.linked / max(1, len(text)))
    prose = sum(text.count(mark) for mark in ".,;:!?")
    feature = math.log(1 + words) - 2.0 + 0.5 * math.log(1 + prose) - 4.0 * dense
    return block.evidence + FEATURE * feature


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cut: True on the source's side.

    A node with a positive gain is tied to the source by that capacity, with a negative one to
    the sink. Nodes whose tie outweighs all their edges are settled first, which moves their
    edges to the terminals of the others; the rest goes through Dinic's maximum flow. Of equal
    cuts the one with fewest nodes on the source's side is returned.
    """
    n = len(gains)
    gains = list(gains)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        u = queue.popleft()
        if label[u] is None and abs(gains[u]) > sum(around[u].values()):
            label[u] = gains[u] > 0
            for v, w in around[u].items():
                gains[v] += w if label[u] else -w
                del around[v][u]
                queue.append(v)
            around[u] = {}
    free = [u for u in range(n) if label[u] is None]
    if free:
        index = {u: k for k, u in enumerate(free)}
        for k, side in enumerate(_dinic([gains[u] for u in free],
                                        [{index[v]: w for v, w in around[u].items()}
                                         for u in free])):
            label[free[k]] = side
    return [bool(x) for x in label]


def _dinic(gains: list[float], around: list[dict[int, float]]) -> list[bool]:
    n = len(gains)
    source, sink = n, n + 1
    residual: list[dict[int, float]] = [dict(a) for a in around] + [{}, {}]
    for u, gain in enumerate(gains):
        if gain > 0:
            residual[source][u], residual[u][source] = gain, 0.0
        elif gain < 0:
            residual[u][sink], residual[sink][u] = -gain, 0.0
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in residual[u].items():
                if c > tiny and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [level[u] >= 0 for u in range(n)]
        pending = [list(r) for r in residual]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(residual[a][b] for a, b in steps)
                for a, b in steps:
                    residual[a][b] -= flow
                    residual[b][a] = residual[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(steps) if residual[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            while pending[u]:
                v = pending[u][-1]
                if residual[u][v] > tiny and level[v] == level[u] + 1:
                    path.append(v)
                    break
                pending[u].pop()
            else:
                path.pop()
                if path:
                    pending[path[-1]].pop()


def labelled(page: str) -> list[tuple[str, float, bool]]:
    """Text, log-odds of its own and label of every block of a page, in order."""
    shown = [(b, t) for b in blocks(page) if (t := b.text())]
    gains = [classify(b, t) for b, t in shown]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    beside: dict[int, int] = {}
    for k, (block, _) in enumerate(shown):
        if k:
            edges.append((k - 1, k, ADJACENT))
        for near, place in ((last, block.parent), (beside, block.outer)):
            if place in near:
                edges.append((near[place], k, SAME_PARENT))
            near[place] = k
    kept = minimum_cut(gains, edges)
    return [(t, g, keep) for (_, t), g, keep in zip(shown, gains, kept, strict=True)]


def main_text(page: str | None) -> str:
    """Content blocks of a page in order, one per line; empty for a null or empty page."""
    return "\n".join(text for text, _, keep in labelled(page or "") if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null, empty and textless pages give an empty text. Repeated rows come back as often as they
    came; null ids and urls stay null; no rows give no rows. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))
