import random
from html.parser import HTMLParser

import pytest

from eventloom.sources.feeds import html_rows
from eventloom.sources.selectors import Automaton, page_rows, parsed


class Tree(HTMLParser):
    """Nodes of a well-formed page: [tag, attributes, parent, place, children]."""

    def __init__(self, page):
        super().__init__()
        self.nodes, self.at = [], None
        self.top = {"kids": []}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        up = self.at or self.top
        node = {"tag": tag, "attrs": dict(attrs), "up": self.at, "place": len(up["kids"]) + 1, "kids": [], "siblings": up["kids"]}
        up["kids"].append(node)
        self.nodes.append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]


def selected(node, steps):
    """Right to left, over all ways."""
    combinator, compound = steps[-1]
    if not compound.fits(node["tag"], node["attrs"], (node["attrs"].get("class") or "").split(), node["place"]):
        return False
    if len(steps) == 1:
        return True
    if combinator == ">":
        others = [node["up"]]
    elif combinator == " ":
        others, up = [], node["up"]
        while up:
            others.append(up)
            up = up["up"]
    else:
        earlier = node["siblings"][: node["place"] - 1]
        others = earlier[-1:] if combinator == "+" else earlier
    return any(o and selected(o, steps[:-1]) for o in others)


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 3)):
        tag = rng.choice(["div", "span", "b"])
        attrs = (f' class="{rng.choice(["x", "y", "x y"])}"' if rng.random() < 0.6 else "") + (f' id="{rng.choice("ab")}"' if rng.random() < 0.3 else "")
        out += f"<{tag}{attrs}>{random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else ''}</{tag}>"
    return out


def random_selector(rng):
    compound = lambda: rng.choice(["div", "span", "*", ".x", ".y", "#a", "b.x", "[id]", "[class~=y]", "[id=b]", "[class^='x']", ":first-child", "div:nth-child(2)", "*:nth-child(odd)", ":nth-child(-n+2)"])
    one = lambda: compound() + "".join(rng.choice([" ", " > ", "+", " ~ "]) + compound() for _ in range(rng.randint(0, 3)))
    return one() + (", " + one() if rng.random() < 0.2 else "")


def test_equals_a_search_of_the_tree():
    rng = random.Random(1)
    for _ in range(400):
        page, selector = random_page(rng), random_selector(rng)
        tree, n = Tree(page), 0
        for node in tree.nodes:
            n += any(selected(node, steps) for steps in parsed(selector))
        assert len(page_rows(selector, {})(page)) == n, (page, selector)


@pytest.mark.parametrize("selector", ["", "a >", "> ", "a,,b", "a:hover", "a:nth-child(x)", "a[", "..x", "a b,"])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        Automaton({"row": selector})


def test_rows_of_containers():
    page = "<div class=other><p class=r>no</p></div><div id=list><p class=r>one<p class=r>two</div>"
    assert html_rows(".r", {"title": "b"}, container="#list")(page) == []
    assert [r["t"] for r in page_rows("li", {"t": "> b"}, container="#list")("<ul id=list><li><b>1</b><li><i><b>no</b></i><b>2</b></ul><ul><li><b>3</b></ul>")] == ["1", "2"]
    assert [r["t"] for r in page_rows("li", {"t": "b"}, container="#none")("<ul><li><b>1</b></ul>")] == ["1"]  # no container on the page


@pytest.mark.parametrize("page, rows", [
    ("<table><tr><td>1<td>2<tr><td>3<td>4</table>", [("1", "2"), ("3", "4")]),
    ("<table><tr><td>1<table><tr><td>in</table><td>2</table>", [("1in", "2"), ("in", None)]),
    ("<table><tr><td><b>1</td><td>2</tr></table>", [("1", "2")]),
    ("</td></p><table><tr><td>1<br>x<td>&amp;2", [("1x", "&2")]),
])
def test_unclosed_tags(page, rows):
    got = page_rows("tr", {"a": "> td:first-child", "b": "> td:nth-child(2)"})(page)
    assert [(r.get("a"), r.get("b")) for r in got] == rows


def test_references_that_a_source_escapes_by():
    page = "<div><h1>a &amp;&amp; &quot;b &lt;&amp</h1><a href='/?x=1&copy=2'>l</a><style>p & q</style></div>"
    columns = {"t": "h1", "u": "a@href", "s": "style"}
    assert page_rows("div", columns)(page)[0]["t"] == 'a && "b <&'
    assert page_rows("div", columns, references=("lt", "amp"))(page) == [{"t": "a && &quot;b <&amp", "u": "/?x=1&copy=2", "s": "p & q"}]
