"""Web pages as element tables: each element is an interval of its page, so that "inside" and "below" are range tests.

`elements` folds once over a page's tags with a stack (elements that end without an end tag end where HTML says) and
gives each kept element the number of its start (`pre`) and of the last start inside it (`last`): x lies in y if
y.pre < x.pre <= y.last. Removed elements leave neither rows nor text. What is done with the elements is expressions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.session import spread

# Names of elements, by what they do.
REMOVED = ("script", "style", "noscript", "svg", "canvas", "iframe", "template", "nav", "header", "footer", "form")
BLOCKS = ("h1", "h2", "h3", "p", "li", "blockquote", "td", "th")
ROOTS = ("article", "main", "[role=main]", "body")
KEPT = frozenset((*BLOCKS, "article", "main", "body", "title", "a", "meta", "link"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp")
IN_HEAD = frozenset(("title", "meta", "link", "style", "script", "base", "noscript", "template"))
END_P = frozenset(
    ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
     "hgroup", "hr", "li", "dd", "dt", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul")
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPE = frozenset(("html", "body", "table", "td", "th", "caption", "button", "object", "marquee", "template", "applet"))
#: What a start ends: (the open elements that end, those that keep them from ending).
ENDS = {
    "li": (("li",), frozenset(("ul", "ol", "menu", "table", "td", "th", "body"))), "dt": (("dt", "dd"), frozenset(("dl", "table", "td", "th", "body"))), "dd": (("dt", "dd"), frozenset(("dl", "table", "td", "th", "body"))),
    "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))), "tr": (("tr", "td", "th"), frozenset(("table",))),
    "thead": (("thead", "tbody", "tfoot", "tr"), frozenset(("table",))), "tbody": (("thead", "tbody", "tfoot", "tr"), frozenset(("table",))), "tfoot": (("thead", "tbody", "tfoot", "tr"), frozenset(("table",))),
    "option": (("option",), frozenset(("select",))),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
FIELDS = ("href", "role", "name", "property", "content", "rel")
NODE = pa.struct([("tag", pa.string()), ("pre", pa.int32()), ("last", pa.int32()), ("text", pa.string()), *((f, pa.string()) for f in FIELDS)])
NODE_DDL = "struct<tag: string, pre: int, last: int, text: string, " + ", ".join(f"{f}: string" for f in FIELDS) + ">"


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


class Fold:
    """One pass over a page: `nodes` are dicts of NODE, in the order of their starts."""

    def __init__(self, page: str, removed: frozenset[str]):
        self.removed, self.nodes, self.parts, self.count = removed, [], [], 0
        self.stack: list[tuple[str, dict | None, int]] = []  # name, node, number
        self.gone = 0  # how many open elements are removed
        self.has_body, self.in_head = False, True
        at, raw = 0, None
        while at < len(page):
            m = re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I).search(page, at) if raw else TOKEN.search(page, at)
            self.text(page[at : m.start() if m else len(page)], raw in (None, "title", "textarea"))
            if not m:
                break
            at = m.end()
            if raw:
                self.close(raw)
                raw = None
            elif m[0][1] not in "!?":
                name = m[2].lower()
                if m[1]:
                    self.end(name)
                else:
                    self.start(name, m[3])
                    raw = name if name in RAW else None
        while self.stack:
            self.pop()

    def text(self, piece: str, decode: bool) -> None:
        if not piece:
            return
        if self.in_head and not self.stack and piece.strip():
            self.body()
        if not self.gone and (self.stack or not self.in_head):
            self.parts.append(html.unescape(piece) if decode and "&" in piece else piece)

    def body(self, raw: str = "") -> None:
        self.in_head = False
        if not self.has_body:
            self.has_body = True
            self.push("body", attributes(raw))

    def start(self, name: str, raw: str) -> None:
        if name in ("html", "head"):
            return
        if name == "body":
            self.body(raw)
            return
        if self.in_head and not self.stack and name not in IN_HEAD:
            self.body()
        if name in END_P:
            self.close("p", SCOPE)
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop()
        for other in ENDS.get(name, ((), None))[0]:
            self.close(other, ENDS[name][1])
        self.push(name, attributes(raw))
        if name in VOID:
            self.pop()

    def end(self, name: str) -> None:
        if name in HEADINGS:
            name = next((x for x, _, _ in reversed(self.stack) if x in HEADINGS or x in SCOPE), name)
        if name not in ("html", "head", "body"):
            self.close(name, frozenset(("table", "td", "th", "body")) - {name} if name in ("p", "li", "a", "b", "i", "em", "strong", "span") else frozenset(("body",)))

    def close(self, name: str, within: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of this name, unless one of `within` lies between."""
        for k in range(len(self.stack) - 1, -1, -1):
            own = self.stack[k][0]
            if own == name:
                while len(self.stack) > k:
                    self.pop()
                return
            if own in within:
                return

    def push(self, name: str, given: dict[str, str]) -> None:
        self.count += 1
        node = None
        if name in self.removed or "hidden" in given or given.get("aria-hidden") == "true":
            self.gone += 1
            self.stack.append((name, None, -1))
            return
        if not self.gone and (name in KEPT or given.get("role") == "main"):
            node = {"tag": name, "pre": self.count, "from": len(self.parts), **{f: given.get(f) for f in FIELDS}}
            self.nodes.append(node)
        self.stack.append((name, node, 0))

    def pop(self) -> None:
        _, node, kind = self.stack.pop()
        if kind < 0:
            self.gone -= 1
        if node:
            node["last"], node["text"] = self.count, "".join(self.parts[node.pop("from") :])


def absolute(href: str | None, base: str) -> str | None:
    """href seen from base; null if it is no address."""
    if href is None:
        return None
    try:
        parts = urlsplit(urljoin(base, re.sub(r"[\t\n\r]", "", href).strip()))
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
            return None
        if parts.scheme not in ("http", "https"):
            return urlunsplit(parts)
        host = parts.netloc.rsplit("@", 1)
        host[-1] = re.sub(":80$" if parts.scheme == "http" else ":443$", "", host[-1].lower())
        safe = "!$%&'()*+,-./:;=?@[]_~|"
        return urlunsplit((parts.scheme, "@".join(host), quote(parts.path, safe=safe) or "/", quote(parts.query, safe=safe), quote(parts.fragment, safe=safe)))
    except ValueError:
        return None


def folded(removed: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                pages = []
                for page, url in zip(rows.column("html").to_pylist(), rows.column("url").to_pylist()):
                    nodes = Fold(page or "", removed).nodes
                    for node in nodes:
                        if node["href"] is not None:
                            node["href"] = absolute(node["href"], url or "")
                    pages.append(nodes)
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("url"), pa.array(pages, pa.list_(NODE))], names=["key", "url", "nodes"])

    return run


def elements(pages: DataFrame, key: str = "page_id", page: str = "html", url: str = "url", removed: tuple[str, ...] = REMOVED) -> DataFrame:
    """(key, url, nodes): of each page the elements that tell of its text, in order, without removed and hidden parts.

    A null page has no elements. Addresses are made absolute; one that is none is null.
    """
    rows = spread(pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(folded(frozenset(removed)), f"key {kind}, url string, nodes array<{NODE_DDL}>")


# --- expressions over nodes -------------------------------------------------------------------


def first_of(nodes: Column, test) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


def playing(selector: str):
    """A test on nodes for `tag` or `[role=name]`."""
    if selector.startswith("[role="):
        return lambda x: x["role"] == selector[6:-1]
    return lambda x: x["tag"] == selector


def inside(nodes: Column, root: Column) -> Column:
    """The nodes below a node."""
    return F.filter(nodes, lambda x: (x["pre"] > root["pre"]) & (x["pre"] <= root["last"]))


def main_root(nodes: Column) -> Column:
    """The first article, else main, else what plays the main role, else the body."""
    return F.coalesce(*(first_of(nodes, playing(r)) for r in ROOTS))


def tidy(text: Column) -> Column:
    """Line ends unified, blanks in a row one, no more than three line ends in a row."""
    text = F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" ")), "[  ]{2,}", " ")
    return T.trim(F.regexp_replace(text, "\n{4,}", "\n\n\n"))


def block_text(node: Column) -> Column:
    """A heading with its marks, a list item with a dash, other blocks as they are; null under three characters."""
    text = tidy(node["text"])
    level = F.regexp_extract(node["tag"], "^h([1-3])$", 1).try_cast("int")
    marked = F.when(level.isNotNull(), F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), text)).when(node["tag"] == "li", F.concat(F.lit("- "), text)).otherwise(text)
    return F.when(F.length(text) >= 3, marked)


def main_parts(found: DataFrame, most_headings: int = 24, most_links: int = 30) -> DataFrame:
    """key, url, title, description, canonical, headings, links (text, url) and text of `elements`."""
    nodes = F.col("nodes")
    of = lambda *tags: lambda x: x["tag"].isin(*tags)
    meta = lambda field, value: tidy(first_of(nodes, lambda x: (x["tag"] == "meta") & (x[field] == value))["content"])
    out = found.withColumn("root", main_root(nodes)).withColumn("below", F.coalesce(inside(nodes, F.col("root")), F.array().cast(f"array<{NODE_DDL}>")))
    filled = lambda x: F.when(x != "", x)
    below = F.col("below")
    pairs = F.transform(F.filter(below, of("a")), lambda x: F.concat(tidy(x["text"]), F.lit("\t"), x["href"]))
    pairs = T.unique_ci(F.filter(pairs, lambda x: x.isNotNull() & ~x.startswith("\t")), most_links)
    blocks = F.filter(F.transform(F.filter(below, of(*BLOCKS)), block_text), lambda x: x.isNotNull())
    return out.select(
        "key", "url",
        F.coalesce(filled(tidy(F.coalesce(filled(first_of(nodes, of("title"))["text"]), first_of(nodes, of("h1"))["text"], F.lit("Untitled page")))), F.lit("")).alias("title"),
        F.coalesce(filled(meta("name", "description")), filled(meta("property", "og:description"))).alias("description"),
        first_of(nodes, lambda x: (x["tag"] == "link") & (x["rel"] == "canonical"))["href"].alias("canonical"),
        T.unique_ci(F.transform(F.filter(below, of("h1", "h2", "h3")), lambda x: tidy(x["text"])), most_headings).alias("headings"),
        F.transform(pairs, lambda x: F.struct(F.substring_index(x, "\t", 1).alias("text"), F.substring_index(x, "\t", -1).alias("url"))).alias("links"),
        tidy(F.array_join(blocks, "\n")).alias("text"),
    )
