"""HTML: sanitise to an allowlist, extract text with byte slices, redact and annotate.

Parsed by Python's html.parser inside Arrow-batched UDFs. It builds no HTML5 tree:
elements that are not closed are closed where their parent is, and misnested end tags that
match no open element are dropped; well-formed input comes out as an HTML5 parser has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import values as V

VOID = frozenset("br hr img".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style head title noscript template textarea iframe object math svg".split())
DROPPED = frozenset("script style title noscript template iframe object math svg".split())


class Node:
    """An element (tag, attributes, children) or a text (tag None)."""

    __slots__ = ("attributes", "children", "tag", "text")

    def __init__(self, tag: str | None, text: str = "", attributes: list[tuple[str, str]] | None = None):
        self.tag, self.text, self.attributes, self.children = tag, text, attributes or [], []


def filter_style(style: str) -> str:
    out = []
    for declaration in style.split(";"):
        name, colon, value = declaration.partition(":")
        name, value = name.strip().lower(), value.strip()
        low = value.lower()
        if colon and name in V.STYLES and "url(" not in low and "expression(" not in low:
            out.append(f"{name}: {value}")
    return "; ".join(out)


def _attributes(tag: str, given: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
    out = []
    for name, value in given:
        value = value or ""
        if name == "style":
            value = filter_style(value)
            if value:
                out.append((name, value))
        elif tag in V.CELLS and name in ("colspan", "rowspan"):
            out.append((name, value))
        elif tag == "img" and name == "src" and value.startswith("data:image/") and len(value.encode()) <= V.MAX_DATA_IMAGE:
            out.append((name, value))
    return out


class _Cleaner(HTMLParser):
    """Builds the tree of allowed elements; text in other elements stays, but not in DROPPED ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open, self.hidden = [self.root], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.hidden += 1
        elif tag in V.TAGS and not self.hidden:
            node = Node(tag, attributes=_attributes(tag, attrs))
            if tag in ("li", "p", "tr", "td", "th", "dt", "dd") and self.open[-1].tag == tag:
                self.open.pop()
            self.open[-1].children.append(node)
            if tag not in VOID:
                self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            last = self.open[-1].children
            if last and last[-1].tag is None:
                last[-1].text += data
            else:
                last.append(Node(None, data))


def parse(html: str) -> Node:
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    return cleaner.root


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def serialise(root: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = list(reversed(root.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag is None:
            out.append(_escaped(node.text))
        else:
            out.append(f"<{node.tag}{''.join(f' {n}="{_quoted(v)}"' for n, v in node.attributes)}>")
            if node.tag not in VOID:
                stack.append(f"</{node.tag}>")
                stack += reversed(node.children)
    return "".join(out)


def sanitise(html: str) -> str:
    return serialise(parse(html))


def replace_images(root: Node) -> None:
    """Images without a source become a word."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [Node(None, V.IMAGE_WORD) if c.tag == "img" and not any(n == "src" for n, _ in c.attributes) else c for c in node.children]
        stack += node.children


def plaintext(root: Node) -> tuple[str, list[tuple[Node, Node, int, int]]]:
    """Text with line ends at blocks and tabs behind cells; slices (parent, text node, byte start, byte end)."""
    out: list[str] = []
    slices: list[tuple[Node, Node, int, int]] = []
    at, last = 0, ""

    def put(s: str) -> None:
        nonlocal at, last
        out.append(s)
        at += len(s.encode())
        last = s[-1]

    stack: list[tuple[Node, Node | None, bool]] = [(c, root, False) for c in reversed(root.children)]
    while stack:
        node, parent, closing = stack.pop()
        if node.tag is None:
            if node.text:
                start = at
                put(node.text)
                slices.append((parent, node, start, at))
            continue
        block = node.tag in V.BLOCKS
        if not closing:
            if block and last not in ("", "\n"):
                put("\n")
            stack.append((node, parent, True))
            stack += [(c, node, False) for c in reversed(node.children)]
        else:
            if block and last not in ("", "\n"):
                put("\n")
            if node.tag in V.CELLS and last not in ("", "\n", "\t"):
                put("\t")
    return "".join(out), slices


def cuts(bounds: list[tuple[int, int]], findings: list[dict]) -> list[list[tuple[int, int, int, bool]]]:
    """For each slice (start, end), the parts of findings in it: local start, local end, finding, whether it is the first part.

    Both lists are sorted; one walk over both. Findings that overlap an earlier one are left out.
    """
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in bounds]
    at, done = 0, 0
    for k, f in enumerate(findings):
        if f["start"] < done or f["start"] > f["end"]:
            continue
        while at < len(bounds) and bounds[at][1] <= f["start"]:
            at += 1
        i, first = at, True
        while i < len(bounds) and bounds[i][0] < f["end"]:
            a, b = bounds[i]
            if b > f["start"]:
                out[i].append((max(f["start"], a) - a, min(f["end"], b) - a, k, first))
                first = False
            i += 1
        done = f["end"]
    return out


def _rebuilt(node: Node, own: list[tuple[int, int, int, bool]], findings: list[dict], annotate: bool) -> list[Node]:
    data, at, out = node.text.encode(), 0, []
    for a, b, k, first in own:
        if a > at:
            out.append(Node(None, data[at:a].decode()))
        f = findings[k]
        if annotate:
            marks = [("data-sz-finding", ""), ("data-entity-type", f["entity_type"]), ("data-confidence", f"{f['confidence']:.2f}")]
            marks += [("data-original", f["original"]), ("data-replacement", f["token"])] if first else [("data-sz-cont", ""), ("data-replacement", "")]
            span = Node("span", attributes=marks)
            span.children.append(Node(None, data[a:b].decode()))
            out.append(span)
        elif first:
            out.append(Node(None, f["token"]))
        at = b
    if at < len(data):
        out.append(Node(None, data[at:].decode()))
    return out


def _rendered(html: str, findings: list[dict], annotate: bool) -> str:
    root = parse(html)
    replace_images(root)
    _, slices = plaintext(root)
    found = cuts([(a, b) for _, _, a, b in slices], findings)
    swaps = {id(node): _rebuilt(node, own, findings, annotate) for (_, node, _, _), own in zip(slices, found) if own}
    for parent in {id(p): p for p, _, _, _ in slices}.values():
        parent.children = [n for c in parent.children for n in swaps.get(id(c), [c])]
    return serialise(root)


def redact(html: str, findings: list[dict]) -> tuple[str, str]:
    """Annotated and redacted HTML of findings in the page's plain text."""
    ordered = sorted(findings, key=lambda f: f["start"])
    return _rendered(html, ordered, True), _rendered(html, ordered, False)


def _text_of(html: str) -> str:
    root = parse(html)
    replace_images(root)
    return plaintext(root)[0]


def with_text(df: DataFrame, html: str = "html") -> DataFrame:
    """df with sanitised and plaintext."""

    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            clean = [None if h is None else sanitise(h) for h in pages]
            yield pd.DataFrame({"sanitised": clean, "plaintext": [None if h is None else _text_of(h) for h in pages]})

    both.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    parts = F.pandas_udf(both, "sanitised string, plaintext string")(F.col(html))
    return df.withColumn("__parts", parts).select("*", "__parts.sanitised", "__parts.plaintext").drop("__parts")


def redacted(html: Column, findings: Column) -> Column:
    """Struct of annotated_html and redacted_html; findings are those of the plain text, with tokens."""

    def both(pages: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if h is None else redact(h, list(f) if f is not None else []) for h, f in zip(pages, found)]
        return pd.DataFrame(rows, columns=["annotated_html", "redacted_html"])

    both.__annotations__ = {"pages": pd.Series, "found": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(both, "annotated_html string, redacted_html string")(html, findings)
