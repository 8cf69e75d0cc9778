"""HTML main text by minimum-cut labelling.

A page is cut into text blocks. A linear classifier of each block (length, links, punctuation, elements and
class names around it) gives its costs as content and as boilerplate: the terminal capacities. Blocks that
follow each other and blocks that are near in the element tree are tied by smoothness edges. The minimum cut
is the cheapest labelling; the content blocks are the text. No feature decides alone: each adds a bounded number
of log odds (WEIGHTS), so that blocks of doubtful kind get the label of the blocks around them from the cut. Blocks
whose own preference outweighs all their edges are settled first, which leaves the cut as it is and the graph
for max-flow small.

One map, page by page; memory is bounded by a page, the time is linear in its length, and nothing is shuffled.

A null or empty page has the empty text; broken markup is read as browsers do (an open tag ends with its
parent); repeated rows are read each for itself; an empty table gives an empty result; further columns than
the key, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

CHUNK = 1 << 22  # bytes of pages that are read before rows go back to Spark
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element names of HTML and usual names of page regions.
DROPPED = frozenset("script style template iframe select textarea button head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
CLOSES = {tag: [x for x, by in CLOSED_BY.items() if tag in by] for tag in BLOCK | {"option"}}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"])}
OUTSIDE = frozenset("nav footer aside header form menu dialog search fieldset noscript svg object canvas audio video".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations comment comments respond reply replies disqus legal copyright pager pagination toolbar skip form search alert disclaimer teaser teasers complementary contentinfo".split()
)
ALWAYS_OUTSIDE = frozenset("comment comments reply replies respond disqus ad ads advert advertisement sponsored teaser related promo".split())
OUTSIDE_STARTS = ("comment", "advert", "cookie", "sidebar", "footer", "breadcrumb", "newsletter", "sponsor", "promo", "navbar", "subscri", "pagination")
ALWAYS_STARTS = ("comment", "advert", "sponsor", "promo")
NOT_THIS = frozenset("no has with without".split())
INSIDE_NAMES = frozenset("article content main post entry story body text hentry prose".split())
PHRASE = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b|all rights reserved|advertisement\b|sponsored\b|we use cookies|this (?:web)?site uses cookies|subscribe\b|sign up\b|log ?in\b|share (?:this|on)\b|leave a (?:reply|comment)|read more\b|related (?:articles|posts))", re.I)

ADJACENT, NEAR, BORDER = 1.2, 0.8, 0.25  # edges of consecutive blocks, of neighbours in the tree, and what is left of either between regions
#: Log odds of content for each kind of evidence. Of the regions around a block the nearest counts.
WEIGHTS = {"any": -1.2, "length": 2.5, "links": -3.5, "sentence": 0.8, "phrase": -3.0, "heading": 0.8, "paragraph": 0.5, "item": -0.3, "never": -4.0, "outside": -3.2, "main": 1.5, "named": 0.8}
CLOSING = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in DROPPED}
CLOSING["head"] = re.compile("</head|<body", re.I | re.A)


class Element:
    __slots__ = ("tag", "parent", "depth", "outside", "inside", "always", "holds_main", "only_header", "region")

    def __init__(self, tag: str, parent: "Element | None", attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.holds_main, self.region = False, None
        self.outside, self.inside, self.always = tag in OUTSIDE, tag in ("article", "main"), False
        self.only_header = tag == "header"
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, value, bare in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if bare or name.lower() == "style":
                    self.always |= bool(bare) or "display:none" in value.replace(" ", "").lower()
                    continue
                words = [x.lower() for x in PARTS.findall(value)]
                names = {x for i, x in enumerate(words) if not (i and words[i - 1] in NOT_THIS)}
                out = {x for x in names if x in OUTSIDE_NAMES or x.startswith(OUTSIDE_STARTS)}
                self.always |= any(x in ALWAYS_OUTSIDE or x.startswith(ALWAYS_STARTS) for x in out)
                self.only_header = (out or {"header"}) == {"header"} and (not self.outside or self.only_header) and (bool(out) or self.only_header)
                self.outside |= bool(out)
                self.inside |= bool(names & INSIDE_NAMES)
        if tag in ("html", "body"):
            self.outside = self.always = False
        elif tag in ("article", "main"):
            self.outside = self.always


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    top = Element("", None, "")
    here, parts, linked, in_link = top, [], 0, False
    at, n, last_end = 0, len(page), page.rfind(">")
    open_tags: dict[str, int] = {}
    unclosed: set[str] = set()  # of these no end follows

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, here, linked))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(e: Element) -> None:
        """Leave e and all elements in it."""
        nonlocal here
        while here is not e:
            open_tags[here.tag] -= 1
            here = here.parent
        open_tags[e.tag] -= 1
        here = e.parent

    while at < n:
        found = TAG.search(page, at) if at <= last_end or "<!--" in page[at:] else None
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:  # end tag
            if tag == "a":
                in_link = False
            if open_tags.get(tag):
                e = here
                while e.tag != tag:
                    e = e.parent
                flush()
                close(e)
                in_link = False
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        attributes = found[3]
        if tag in DROPPED:
            end = None if tag in unclosed else CLOSING[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
                at = n if tag in ("script", "style") else at
            elif tag == "head":  # ends where the body begins, too
                at = end.start()
            else:
                end = page.find(">", end.start())
                at = n if end < 0 else end + 1
            continue
        if tag == "a":
            in_link = True
        new = None
        if tag in BLOCK or tag in OUTSIDE or attributes and ("class" in attributes or "id=" in attributes or "hidden" in attributes):
            new = Element(tag, here, attributes)
            if tag not in BLOCK and not new.outside and not new.always:
                continue  # an inline element that says nothing about its text
        if new is None:
            continue
        flush()
        e = here if any(open_tags.get(x) for x in CLOSES.get(tag, ())) else top
        while e is not top and e.tag not in SCOPE.get(tag, ()):
            if tag in CLOSED_BY.get(e.tag, ()) and (e.tag == "p" or tag not in ("td", "th") or e.tag != "tr"):
                close(e)
                if e.tag not in ("td", "th", "p", "li", "dd", "dt"):
                    break
            if e.tag in ("div", "section", "article", "main", "table", "ul", "ol", "body", "span"):
                break
            e = e.parent
        new.parent, new.depth = here, here.depth + 1
        here = new
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in ("article", "main"):
            e = here.parent
            while e is not None and not e.holds_main:
                e.holds_main = True
                e = e.parent
        if tag != "a":
            in_link = False
    flush()
    return out


def region(element: Element) -> tuple[str, bool]:
    """The kind of region that an element lies in, and whether an article or main element is at or above it.

    Each element is looked at once: what its parent has is kept there.
    """
    path = []
    e = element
    while e is not None and e.region is None:
        path.append(e)
        e = e.parent
    kind, main = e.region if e is not None else ("", False)
    for e in reversed(path):
        above = main
        main = main or e.tag in ("article", "main")
        if e.always:
            kind = "never"
        elif e.outside and not e.holds_main and not (e.only_header and above):
            kind = kind if kind == "never" else "outside"
        elif kind not in ("never", "outside"):
            kind = "main" if main else "named" if e.inside else kind
        e.region = (kind, main)
    return element.region


def preference(block: Block) -> float:
    """Log odds that a block is content, from its text and from the elements around it."""
    text, w = block.text, WEIGHTS
    n, tag = len(text), block.element.tag
    score = w["any"] + min(n / 60, w["length"]) + w["links"] * min(1.0, block.linked / n)
    if text[-1] in ".!?…。:\"”":
        score += w["sentence"]
    if n < 200 and PHRASE.match(text):
        score += w["phrase"]
    if tag in ("h1", "h2", "h3", "h4"):
        score += w["heading"]
    elif tag in ("p", "blockquote", "pre"):
        score += w["paragraph"]
    elif tag in ("li", "td", "th", "dd", "dt", "option"):
        score += w["item"]
    return score + w.get(region(block.element)[0], 0.0)


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness: consecutive blocks, weaker with the steps between, and the next block of the same parent; much weaker across a region's border."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    tie = lambda i, j: 1.0 if region(blocks[i].element)[0] == region(blocks[j].element)[0] else BORDER
    for i, block in enumerate(blocks):
        if i:
            steps = distance(blocks[i - 1].element, block.element)
            out[i - 1, i] = ADJACENT * 0.7 ** max(0, steps - 2) * tie(i - 1, i)
        home = id(block.element.parent or block.element)
        j = last.get(home)
        if j is not None:
            out[j, i] = out.get((j, i), 0.0) + NEAR * tie(j, i)
        last[home] = i
    return out


def min_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut.

    gain: cost of the sink's label minus cost of the source's (positive: tied to the source).
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + w
    gain, label = list(gain), [None] * n
    total = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:  # a node that outweighs all its edges keeps its own label in some minimum cut
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= total[i]:
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    total[j] -= w
                    gain[j] += w if label[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = max_flow_side(rest, gain, near, label)
        for i in rest:
            label[i] = i in side
    return label


def max_flow_side(rest: list[int], gain: list[float], near: list[dict[int, float]], label: list) -> set[int]:
    """Dinic's algorithm on the open nodes; returns those that the source still reaches."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in rest:
        own = cap.setdefault(i, {})
        for j, w in near[i].items():
            if label[j] is None:
                own[j] = w
        if gain[i] > 0:
            cap[source][i], own[source] = gain[i], 0.0
        elif gain[i] < 0:
            own[sink], cap[sink][i] = -gain[i], 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        turns = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-12)
                del path[full + 1 :]
                continue
            for v in turns[u]:
                if cap[u][v] > 1e-12 and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1


def labelled(blocks: list[Block]) -> list[tuple[float, bool]]:
    """Preference and label of each block."""
    gains = [preference(b) for b in blocks]
    # costs are -log p of each label; the difference of a block's two costs is its log odds
    return list(zip(gains, min_cut(gains, edges_of(blocks))))


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by line feeds."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, (_, keep) in zip(blocks, labelled(blocks)) if keep) if blocks else ""


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in S.small_batches(batches, "html", CHUNK):
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract_rows, "page_id long, url string, text string, n_chars long")
