"""The part of CSS that decides block layout: rules that set ``display``, their selectors and the cascade."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from corpusloom.html.dom import Node

Test = Callable[[Node], bool]


@dataclass(frozen=True)
class Rule:
    match: Test
    specificity: tuple[int, int, int]
    display: str
    important: bool


def parse_sheet(text: str) -> list[Rule]:
    """The rules of a style sheet that set display; media blocks count if they hold for a screen."""
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    rules: list[Rule] = []
    at = 0
    while at < len(text):
        brace = text.find("{", at)
        if brace < 0:
            break
        head = text[at:brace].strip().split(";")[-1].strip()
        end = _closing(text, brace)
        inner = text[brace + 1 : end]
        if head.startswith("@media"):
            if _screen(head[6:]):
                rules += parse_sheet(inner)
        elif head.startswith("@supports"):
            rules += parse_sheet(inner)
        elif head and not head.startswith("@"):
            rules += _style_rules(head, inner)
        at = end + 1
    return rules


def _closing(text: str, brace: int) -> int:
    depth = 0
    for i in range(brace, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    return len(text)


def _screen(query: str) -> bool:
    kinds = [q.strip().lower() for q in query.split(",")]
    return any(q.startswith(("all", "screen", "only screen", "only all", "(")) for q in kinds)


def declared_display(block: str) -> tuple[str, bool] | None:
    """(value, important) of the last display declaration."""
    found = None
    for part in block.split(";"):
        name, colon, value = part.partition(":")
        if colon and name.strip().lower() == "display":
            value = value.strip().lower()
            important = value.endswith("!important")
            found = (value.removesuffix("!important").strip(), important)
    return found


def _style_rules(selectors: str, block: str) -> list[Rule]:
    found = declared_display(block)
    if not found:
        return []
    out = []
    for selector in _split(selectors, ","):
        try:
            match, specificity = compile_selector(selector.strip())
        except ValueError:
            continue
        out.append(Rule(match, specificity, *found))
    return out


def _split(text: str, mark: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == mark and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


_SIMPLE = re.compile(
    r"(?P<tag>\*|[\w-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[^\]]+)\]|::?(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"
)
_ATTRIBUTE = re.compile(r"""^\s*([\w:-]+)\s*(?:([~|^$*!]?=)\s*["']?([^"']*)["']?\s*)?$""")


def compile_selector(selector: str) -> tuple[Test, tuple[int, int, int]]:
    """A test of elements and the selector's specificity; ValueError for what can't be read."""
    tokens = re.findall(r"\s*[>+~]\s*|\s+|(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|[^\s>+~\[(])+", selector.strip())
    if not tokens:
        raise ValueError(selector)
    test, weight = _compound(tokens[0])
    for joint, part in zip(tokens[1::2], tokens[2::2]):
        right, more = _compound(part)
        weight = tuple(a + b for a, b in zip(weight, more))
        test = _joined(test, joint.strip(), right)
    return test, weight


def _joined(left: Test, joint: str, right: Test) -> Test:
    if joint == ">":
        return lambda n: right(n) and n.parent is not None and left(n.parent)
    if joint == "+":
        return lambda n: right(n) and (s := _before(n)) != [] and left(s[-1])
    if joint == "~":
        return lambda n: right(n) and any(map(left, _before(n)))
    return lambda n: right(n) and any(left(a) for a in n.ancestors() if a is not n)


def _siblings(n: Node) -> list[Node]:
    return n.parent.elements() if n.parent else [n]


def _before(n: Node) -> list[Node]:
    all_ = _siblings(n)
    return all_[: next(i for i, s in enumerate(all_) if s is n)]


def _compound(text: str) -> tuple[Test, tuple[int, int, int]]:
    tests: list[Test] = []
    ids = classes = tags = at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(text)
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda n, t=m["tag"].lower(): n.tag == t)
                tags += 1
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
            ids += 1
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
            classes += 1
        elif m["attr"]:
            tests.append(_attribute(m["attr"]))
            classes += 1
        else:
            test, weight = _pseudo(m["pseudo"].lower(), m["arg"])
            tests.append(test)
            ids, classes, tags = ids + weight[0], classes + weight[1], tags + weight[2]
    return (lambda n: all(t(n) for t in tests)), (ids, classes, tags)


def _attribute(text: str) -> Test:
    m = _ATTRIBUTE.match(text)
    if not m:
        raise ValueError(text)
    name, op, value = m[1].lower(), m[2], m[3] or ""
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda v: True,
        "=": lambda v: v == value,
        "~=": lambda v: value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v,
    }
    if op == "!=":
        return lambda n: n.attrs.get(name) != value
    return lambda n: name in n.attrs and tests[op](n.attrs[name])


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        raise ValueError(arg)
    if m[3]:
        return lambda i: i == int(m[3])
    a = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    b = int(m[2] or 0)
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _pseudo(name: str, arg: str | None) -> tuple[Test, tuple[int, int, int]]:
    same = lambda n: [s for s in _siblings(n) if s.tag == n.tag]
    place = lambda nodes, n: next(i for i, s in enumerate(nodes) if s is n) + 1
    one = (0, 1, 0)
    if name in ("not", "matches", "is", "has") and arg is not None:
        parts = [compile_selector(p.strip()) for p in _split(arg, ",")]
        weight = max(w for _, w in parts)
        if name == "not":
            return (lambda n: not any(t(n) for t, _ in parts)), weight
        if name == "has":
            return (lambda n: any(t(d) for d in n.walk() if d is not n and d.tag for t, _ in parts)), weight
        return (lambda n: any(t(n) for t, _ in parts)), weight
    if name.startswith("nth-") and arg is not None:
        ok = _nth(arg)
        nodes = same if name.endswith("type") else _siblings
        if "last" in name:
            return (lambda n: ok(len(nodes(n)) + 1 - place(nodes(n), n))), one
        return (lambda n: ok(place(nodes(n), n))), one
    tests: dict[str, Test] = {
        "root": lambda n: n.parent is None,
        "scope": lambda n: n.parent is None,
        "first-child": lambda n: _siblings(n)[0] is n,
        "last-child": lambda n: _siblings(n)[-1] is n,
        "only-child": lambda n: len(_siblings(n)) == 1,
        "first-of-type": lambda n: same(n)[0] is n,
        "last-of-type": lambda n: same(n)[-1] is n,
        "only-of-type": lambda n: len(same(n)) == 1,
        "empty": lambda n: not any(c.tag or c.text for c in n.children),
        "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
        "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
        "enabled": lambda n: "disabled" not in n.attrs,
        "disabled": lambda n: "disabled" in n.attrs,
        "checked": lambda n: "checked" in n.attrs,
    }
    return tests.get(name, lambda n: False), one


def computed_display(node: Node, rules: list[Rule]) -> str | None:
    """The element's own display by the document's sheets and its style attribute; null if nothing sets it."""
    best: tuple | None = None
    for order, rule in enumerate(rules):
        if rule.match(node):
            key = (rule.important, 0, rule.specificity, order)
            best = max(best, (key, rule.display)) if best else (key, rule.display)
    inline = declared_display(node.attrs.get("style", ""))
    if inline:
        key = (inline[1], 1, (0, 0, 0), 0)
        best = max(best, (key, inline[0])) if best else (key, inline[0])
    return best[1] if best else None


def document_rules(root: Node) -> list[Rule]:
    return [r for n in root.walk() if n.tag == "style" for r in parse_sheet(n.content())]
