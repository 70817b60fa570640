"""A small HTML tree builder over the standard library's tokenizer.

Malformed markup is the rule: paragraphs and items close implicitly, unclosed
formatting is reopened in later blocks, misnested formatting is split, and
content that a table can't hold moves in front of it."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
SCOPE = frozenset("html table td th caption button object marquee template".split())


class Node:
    """An element (tag, attrs, children) or a text (tag None)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node, before: Node | None = None) -> Node:
        child.parent = self
        if before is not None:
            self.children.insert(self.children.index(before), child)
        else:
            self.children.append(child)
        return child

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def ancestors(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None)


class TreeBuilder(HTMLParser):
    """Feed markup, read ``root``: the html element with its head and body."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = self.root.append(Node("head"))
        self.body: Node | None = None
        self.open: list[Node] = [self.root, self.head]
        self.formatting: list[Node] = []

    def _body(self) -> Node:
        if self.body is None:
            self.body = self.root.append(Node("body"))
            self.open = [self.root, self.body]
        return self.body

    def _in_scope(self, tag: str, stop: frozenset[str] = SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag in stop:
                return False
        return False

    def _close(self, tag: str) -> None:
        while self.open[-1].tag != tag:
            self.open.pop()
        self.open.pop()

    def _place(self, node: Node) -> Node:
        """Put a node where the insertion point is; strangers in a table go in front of it."""
        at = self.open[-1]
        if at.tag in ("table", "tbody", "thead", "tfoot", "tr") and node.tag not in TABLE_PARTS | {"form", "script", "style"}:
            if node.tag is None and not node.text.strip():
                return at.append(node)
            table = next(n for n in reversed(self.open) if n.tag == "table")
            return table.parent.append(node, before=table) if table.parent else at.append(node)
        return at.append(node)

    def _reopen_formatting(self) -> None:
        for i, node in enumerate(self.formatting):
            if node not in self.open:
                copy = Node(node.tag, dict(node.attrs))
                self._place(copy)
                self.open.append(copy)
                self.formatting[i] = copy

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes: dict[str, str] = {}
        for k, v in attrs:
            attributes.setdefault(k, v or "")
        if tag in ("html", "body"):
            target = self.root if tag == "html" else self._body()
            for k, v in attributes.items():
                target.attrs.setdefault(k, v)
            return
        if tag == "head":
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                node = self.head.append(Node(tag, attributes))
                if tag not in VOID:
                    self.open.append(node)
                return
            self._body()
        self._imply_ends(tag)
        if tag not in CLOSES_P and tag not in TABLE_PARTS and tag not in RAW:
            if tag == "a" and any(n.tag == "a" for n in self.formatting):
                self.handle_endtag("a")
            self._reopen_formatting()
        node = Node(tag, attributes)
        self._table_frame(tag)
        self._place(node)
        if tag in VOID:
            return
        self.open.append(node)
        if tag in FORMATTING:
            same = [n for n in self.formatting if n.tag == tag and n.attrs == node.attrs]
            if len(same) >= 3:
                self.formatting.remove(same[0])
            self.formatting.append(node)

    def _imply_ends(self, tag: str) -> None:
        if tag in CLOSES_P and self._in_scope("p"):
            self._close("p")
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag == "li" and self._in_scope("li", SCOPE | {"ul", "ol"}):
            self._close("li")
        if tag in ("dd", "dt"):
            for other in ("dd", "dt"):
                if self._in_scope(other, SCOPE | {"dl"}):
                    self._close(other)
        if tag == "option" and self.open[-1].tag == "option":
            self.open.pop()
        if tag in ("td", "th"):
            for other in ("td", "th"):
                if self._in_scope(other, frozenset(["table"])):
                    self._close(other)
        if tag in ("tr", "tbody", "thead", "tfoot"):
            for other in ("td", "th", "tr") + (() if tag == "tr" else ("tbody", "thead", "tfoot")):
                if self._in_scope(other, frozenset(["table"])):
                    self._close(other)

    def _table_frame(self, tag: str) -> None:
        if tag == "tr" and self.open[-1].tag == "table":
            self.open.append(self.open[-1].append(Node("tbody")))
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._table_frame("tr")
            self.open.append(self.open[-1].append(Node("tr")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "circle", "rect", "use", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag == "p" and not self._in_scope("p"):
            self._body()
            self._place(Node("p"))
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in FORMATTING:
            self._end_formatting(tag)
            return
        if tag in HEADINGS:
            for node in reversed(self.open):
                if node.tag in HEADINGS:
                    self._close(node.tag)
                    return
                if node.tag in SCOPE:
                    return
            return
        stop = frozenset(["table"]) if tag in TABLE_PARTS and tag != "table" else SCOPE - {tag}
        if self._in_scope(tag, stop):
            self._close(tag)

    def _end_formatting(self, tag: str) -> None:
        """Close a formatting element; blocks it is misnested with keep a copy of it inside."""
        entry = next((n for n in reversed(self.formatting) if n.tag == tag), None)
        if entry is None:
            if self._in_scope(tag):
                self._close(tag)
            return
        self.formatting.remove(entry)
        if entry not in self.open:
            return
        at = self.open.index(entry)
        above = self.open[at + 1 :]
        block = next((n for n in above if n.tag in CLOSES_P or n.tag in SCOPE), None)
        if block is None:
            self.open[at:] = []
            return
        parent = entry.parent or self._body()  # the block moves out of the element, its content into a copy
        if block.parent is not None:
            block.parent.children.remove(block)
        parent.append(block)
        copy = Node(tag, dict(entry.attrs))
        for child in block.children:
            child.parent = copy
        copy.children, block.children = block.children, []
        block.append(copy)
        self.open = [n for n in self.open if n is not entry]

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if at.tag in RAW or at.tag == "title":
            at.append(Node(None, text=data))
            return
        if self.body is None:
            if not data.strip():
                return
            self._body()
        if data.strip():
            self._reopen_formatting()
        self._place(Node(None, text=data))


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    builder._body()
    return builder.root


def links(root: Node) -> list[tuple[str, str]]:
    """(href, rel) of anchors and areas, then of canonical links, in document order."""
    anchors = [(n.attrs["href"], n.attrs.get("rel", "")) for n in root.walk() if n.tag in ("a", "area") and "href" in n.attrs]
    canonical = [(n.attrs["href"], "canonical") for n in root.walk() if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical" and "href" in n.attrs]
    return anchors + canonical
