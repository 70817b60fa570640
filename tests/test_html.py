import pytest

from corpusloom.html import css, dom
from corpusloom.html.convert import convert_page


def blocks(html):
    return [t for k, c, _, t in convert_page(html) if k == "TextBlock"]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<div>a<p>b</p>c</div>", ["b", "a c"]),
        ("<p>a<br>b</p>", ["a b"]),
        ("<p>wor<b>d</b>.</p>", ["wor d ."]),
        ("<p>x &amp;lt; y</p>", ["x < y"]),
        ("<p class='login'>x</p><p>y</p>", ["y"]),
        ("<p aria-hidden='false'>x</p>", []),
        ("<p><img alt='pic'> t</p>", ["pic t"]),
        ("<p><a href='/' title='T'></a></p>", ["T"]),
        ("<style>span{display:block}</style><p>a<span>b</span></p>", ["b", "a"]),
        ("<style>@media print{span{display:block}}</style><p>a<span>b</span></p>", ["a b"]),
        ("", []),
        (None, []),
        ("<p>one<p>two", ["one", "two"]),
        ("<script>'</p>'</script><p>x", ["x"]),
    ],
)
def test_blocks(html, expected):
    assert blocks(html) == expected


def test_list_drops_stray_text_to_the_block_outside():
    rows = convert_page("<ul>stray<li>i</li></ul>")
    assert [(k, c) for k, c, *_ in rows[3:-1]] == [
        ("List", "Start"), ("ListItem", "Start"), ("TextBlock", "Text"), ("ListItem", "End"), ("List", "End"), ("TextBlock", "Text"),
    ]


def test_navigation_list():
    rows = convert_page("<ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul>")
    assert rows[3][0] == "NavigationList"


def test_sections_nest_by_heading_level():
    rows = [(k, c, n, t) for k, c, n, t in convert_page("<h1>A</h1><p>a</p><h2>B</h2><p>b</p><h1>C</h1>") if k == "Section"]
    assert rows == [
        ("Section", "Start", 1, "A"), ("Section", "Start", 2, "B"), ("Section", "End", 2, None), ("Section", "End", 1, None),
        ("Section", "Start", 1, "C"), ("Section", "End", 1, None),
    ]


def test_container_opens_the_section_before_its_content():
    rows = convert_page("<div><h2>A</h2></div><div><div>x</div><h2>B</h2><p>b</p></div>")
    texts = [(k, t) for k, c, _, t in rows if t and k != "Document"]
    assert texts == [("Section", "A"), ("Section", "B"), ("TextBlock", "x"), ("TextBlock", "b")]


def test_unclosed_formatting_is_reopened():
    root = dom.parse("<p><b>a<p>c")
    bolds = [n for n in root.walk() if n.tag == "b"]
    assert [b.content() for b in bolds] == ["a", "c"]


def test_strangers_move_out_of_tables():
    root = dom.parse("<table>x<tr><td>a</td></tr></table>")
    body = root.elements()[1]
    assert body.children[0].text == "x"


def test_deep_markup_is_walked():
    assert blocks("<div>" * 3000 + "x" + "</div>" * 3000) == ["x"]


@pytest.mark.parametrize(
    ("selector", "hits"),
    [("p", 2), (".c", 1), ("#i", 1), ("div > p", 1), ("div p", 2), ("p + p", 0), ("[data-x^=ab]", 1), ("p:not(.c)", 1), ("li:nth-child(2n+1)", 2), ("li:last-child", 1), ("ul:has(li)", 1)],
)
def test_selectors(selector, hits):
    root = dom.parse("<div><p class='a c' id=i>x</p><span><p data-x=abc>y</p></span></div><ul><li><li><li></ul>")
    match, _ = css.compile_selector(selector)
    assert sum(match(n) for n in root.walk() if n.tag) == hits


def test_cascade_prefers_important_then_specific_then_later():
    root = dom.parse("<style>span{display:inline!important}.x{display:block}span.x{display:none}</style><span class=x></span>")
    span = next(n for n in root.walk() if n.tag == "span")
    assert css.computed_display(span, css.document_rules(root)) == "inline"
