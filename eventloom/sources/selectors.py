"""Selectors of configured pages, compiled to one automaton that runs over a page's tags once.

A selector is compounds (``tag``, ``*``, ``.class``, ``#id``, ``[name]``, ``[name=v]`` with ``~= ^= $= *=``, ``:nth-child(an+b)``, ``:first-child``) with
combinators between them: blank (descendant), ``>``, ``+``, ``~``; a comma gives alternatives. A combinator in front refers to the row. Every prefix of every
selector is a bit. An open element keeps the bits that it matches, those of its ancestors, and those of its children so far, so a tag is matched by
a few operations on integers, however deep it stands.

Elements that pages leave open (p, li, dt, dd, option, cells and rows) are closed where the next one starts; an end tag closes what is
open within its element; one without a start is ignored. Anything else in a selector raises ValueError when it is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: a start tag, the open elements that it ends, and the elements beyond which it doesn't look
ENDS = {
    **dict.fromkeys("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), (frozenset({"p"}), frozenset({"table", "td", "th", "button"}))),
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl"}))),
    "option": (frozenset({"option"}), frozenset({"select"})),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th"}), frozenset({"tr", "table"}))),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"}))),
}
NAME = r"[A-Za-z0-9_\-\u0080-\U0010ffff]+"
SIMPLE = re.compile(rf"""\*|(?P<tag>{NAME})|\.(?P<cls>{NAME})|\#(?P<id>{NAME})|\[\s*(?P<name>{NAME})\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^\]\s]+))\s*)?\]|:(?P<pseudo>first-child|nth-child\(\s*(?P<nth>[^)]*?)\s*\))""")
COMBINATOR = re.compile(r"\s*([>+~,])\s*|\s+")
SCOPE = "scope"
TESTS = {"=": str.__eq__, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: bool(v) and a.startswith(v), "$=": lambda a, v: bool(v) and a.endswith(v), "*=": lambda a, v: bool(v) and v in a}


def _nth(text: str) -> tuple[int, int]:
    text = text.lower().replace(" ", "")
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    found = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not text or not found:
        raise ValueError(f"nth-child({text})")
    a, b = found.groups()
    return (0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)), int(b or 0)


class Compound:
    """What must hold of one element."""

    def __init__(self):
        self.tag, self.classes, self.attributes, self.nth = None, [], [], []

    def fits(self, tag: str, attributes: dict[str, str], classes: list[str], place: int) -> bool:
        if self.tag and self.tag != tag or any(c not in classes for c in self.classes):
            return False
        for name, op, value in self.attributes:
            if name not in attributes or op and not TESTS[op](attributes[name], value):
                return False
        return all((place == b if not a else (place - b) % a == 0 and (place - b) // a >= 0) for a, b in self.nth)


def parsed(selector: str) -> list[list[tuple[str, Compound | str]]]:
    """Alternatives, each a list of (combinator with the one before, compound)."""
    out, steps, at, combinator = [], [], 0, ""
    text = selector.strip()
    if text[:1] in (">", "+", "~"):
        steps, combinator, at = [("", SCOPE)], text[0], len(text) - len(text[1:].lstrip())
    while at < len(text):
        compound, start = Compound(), at
        while found := SIMPLE.match(text, at):
            part = found.groupdict()
            if part["tag"]:
                if at > start:
                    break
                compound.tag = part["tag"].lower()
            elif part["cls"]:
                compound.classes.append(part["cls"])
            elif part["id"]:
                compound.attributes.append(("id", "=", part["id"]))
            elif part["name"]:
                compound.attributes.append((part["name"].lower(), part["op"], next((part[k] for k in "qsv" if part[k] is not None), "")))
            elif part["pseudo"]:
                compound.nth.append((0, 1) if part["pseudo"] == "first-child" else _nth(part["nth"]))
            at = found.end()
        if at == start:
            raise ValueError(f"no selector: {selector!r} at {at}")
        steps.append((combinator, compound))
        if at == len(text):
            break
        between = COMBINATOR.match(text, at)
        if not between or between.end() == len(text):
            raise ValueError(f"no selector: {selector!r} at {at}")
        combinator, at = between.group(1) or " ", between.end()
        if combinator == ",":
            out.append(steps)
            steps, combinator = [], ""
            if text[at] in ">+~":
                steps, combinator = [("", SCOPE)], text[at]
                at += len(text[at:]) - len(text[at + 1 :].lstrip())
    if not steps or steps[-1][1] == SCOPE:
        raise ValueError(f"no selector: {selector!r}")
    return [*out, steps]


class Automaton:
    """Bits of all selectors' prefixes: ``steps`` is (bit, combinator, bit before, compound), ``final`` the bits that complete each selector."""

    def __init__(self, selectors: dict[str, str]):
        self.steps, self.final, self.scope, bit = [], {}, 0, 1
        for name, selector in selectors.items():
            self.final[name] = 0
            for alternative in parsed(selector):
                before = 0
                for combinator, compound in alternative:
                    if compound == SCOPE:
                        self.scope |= bit
                    else:
                        self.steps.append((bit, combinator, before, compound))
                    before, bit = bit, bit << 1
                self.final[name] |= before

    def matched(self, tag: str, attributes: dict[str, str], place: int, parent: int, ancestors: int, previous: int, earlier: int) -> int:
        classes, out = (attributes.get("class") or "").split(), 0
        reach = {" ": ancestors, ">": parent, "+": previous, "~": earlier}
        for bit, combinator, before, compound in self.steps:
            if (not before or reach[combinator] & before) and compound.fits(tag, attributes, classes, place):
                out |= bit
        return out


class _Open:
    __slots__ = ("tag", "own", "above", "last", "earlier", "children", "row", "fields")

    def __init__(self, tag: str, own: int, above: int):
        self.tag, self.own, self.above = tag, own, above
        self.last = self.earlier = self.children = 0
        self.row, self.fields = None, []


class _Run(HTMLParser):
    def __init__(self, automaton: Automaton, columns: dict[str, tuple[str, str]]):
        super().__init__(convert_charrefs=True)
        self.automaton, self.columns = automaton, columns
        self.stack = [_Open("", 0, 0)]
        self.rows: list[tuple[bool, dict]] = []
        self.containers = 0
        self.inside = 0  # open containers
        self.live: list[dict] = []  # open rows
        self.texts: list[tuple[dict, str]] = []  # open fields

    def _close(self) -> None:
        gone = self.stack.pop()
        if gone.own & self.automaton.final.get("container", 0):
            self.inside -= 1
        if gone.row is not None:
            self.live.pop()
        for _ in gone.fields:
            self.texts.pop()

    def handle_starttag(self, tag, attrs):
        ends, until = ENDS.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in until:
                break
            if self.stack[i].tag in ends:
                while len(self.stack) > i:
                    self._close()
                break
        top, attributes = self.stack[-1], {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        top.children += 1
        above = top.above | top.own
        own = self.automaton.matched(tag, attributes, top.children, top.own, above, top.last, top.earlier)
        final, element = self.automaton.final, _Open(tag, own, above)
        in_container = self.inside > 0
        if own & final.get("container", 0):
            self.containers += 1
            self.inside += 1
        for field, (key, attribute) in self.columns.items():
            if own & final[key]:
                for row in self.live:
                    if field not in row:
                        row[field] = attributes.get(attribute, "") if attribute else ""
                        if not attribute:
                            element.fields.append(field)
                            self.texts.append((row, field))
        if own & final["row"]:
            element.row = {}
            self.rows.append((in_container, element.row))
            self.live.append(element.row)
            element.own |= self.automaton.scope
            own = element.own
        top.last = own
        top.earlier |= own
        self.stack.append(element)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as pages are read: a slash closes nothing

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._close()
                break

    def handle_data(self, data):
        for row, field in self.texts:
            row[field] += data


def page_rows(row: str, columns: dict[str, str], container: str | None = None, references: Sequence[str] | None = None) -> Callable[[str], list[dict[str, str]]]:
    """Parser of pages: for each row within a container (or anywhere, if a page has none), the text of the first element of each column, or its
    attribute ("a@href"). Compiled once; ValueError for a selector that isn't one. ``references`` are the names that the
    source escapes by ("amp"): any other reference, or one that was cut before its semicolon, is text. Without it references are read as browsers do."""
    fields = {field: tuple(selector.rpartition("@")[::2]) if "@" in selector else (selector, "") for field, selector in columns.items()}
    keys = {field: (f"field:{field}", attribute) for field, (_, attribute) in fields.items()}
    selectors = {"row": row, **({"container": container} if container else {}), **{keys[f][0]: css for f, (css, _) in fields.items()}}
    automaton = Automaton(selectors)
    # an ampersand that starts none of the references, or an element whose text has none
    other = None if references is None else re.compile(rf"(<(script|style)\b.*?</\2\s*>)|&(?!(?:{'|'.join(map(re.escape, references))});)", re.IGNORECASE | re.DOTALL)

    def parse(page: str) -> list[dict[str, str]]:
        run = _Run(automaton, keys)
        run.feed(other.sub(lambda m: m.group(1) or "&amp;", page) if other else page)
        run.close()
        return [r for within, r in run.rows if within or not run.containers]

    return parse
