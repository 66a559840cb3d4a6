"""The plain version of meridian.text.pages and blocks: a tree a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements that end a line, those that hold no shown text, and those without an end tag.
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 tr".split())
HIDDEN = frozenset(("script", "style", "head"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DASHES = "‐‑‒–—―−"
OPEN, CLOSE = "[TABLE]", "[/TABLE]"
#: Lines before a table that may name it, and their greatest length.
CONTEXT_LINES, CONTEXT_CHARS = 3, 150


class Node:
    __slots__ = ("children", "tag")

    def __init__(self, tag: str) -> None:
        self.tag, self.children = tag, []


class _Tree(HTMLParser):
    """Elements as they are written: an end tag closes the nearest open element of its name, and those inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(re.sub(r"[\r\n]+", " ", data))


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.open[0]


def _plain(text: str) -> str:
    return re.sub(f"[{DASHES}]", "-", text.replace("\xa0", " ").replace("​", ""))


def _strings(node: Node) -> Iterator[str]:
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag not in HIDDEN:
            todo += reversed(x.children)


def merge_cells(cells: list[str]) -> list[str]:
    """An opening sign joins the cell after it, a closing one the cell before, so a value has one cell; empty cells go."""
    out: list[str] = []
    sign = ""
    for cell in filter(None, cells):
        if cell in ("$", "(", "$(", "($"):
            sign += cell
        elif out and not cell.strip(")%"):
            out[-1] += cell
        else:
            out.append(sign + cell)
            sign = ""
    return out


def _rows(table: Node) -> list[list[str]]:
    """The cells of all rows in the table, those of tables inside it too, in the order of the page."""
    out, todo = [], [table]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.tag == "tr":
            cells = [re.sub(r"\s+", " ", _plain(" ".join(_strings(c)))).strip().replace("|", "/") for c in x.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if cells := merge_cells(cells):
                out.append(cells)
        todo += reversed(x.children)
    return out


def _lines(text: str) -> str:
    """Inner spaces as one, runs of blank lines as one, none at the ends."""
    lines: list[str] = []
    for line in _plain(text).splitlines():
        line = re.sub(r"[ \t]+", " ", line).strip()
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines).strip()


def page_text(html: str) -> str:
    """Readable lines: a line a block, outermost tables as rows of ` | ` between marks."""
    out: list[str] = []
    todo: list[Node | str] = [parse(html)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x.tag == "table":
            out.append("\n".join(["", OPEN, *(" | ".join(r) for r in _rows(x)), CLOSE, ""]))
        elif x.tag not in HIDDEN:
            todo += ["\n"] * (x.tag in BLOCKS) + x.children[::-1]
    return _lines("".join(out))


def flat_text(html: str) -> str:
    """Readable lines without table marks: cells parted by ` | `, typographic quotes and dashes plain."""
    out: list[str] = []
    todo: list[Node | str] = [parse(html)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x.tag not in HIDDEN:
            after = "\n" if x.tag in BLOCKS or x.tag == "table" else " | " if x.tag in ("td", "th") else ""
            todo += [after] * bool(after) + x.children[::-1]
    text = "".join(out).translate(str.maketrans("’‘“”", "''\"\""))
    return _lines("\n".join(line.strip(" \t|") for line in text.splitlines()))


def split_blocks(text: str) -> tuple[str, list[dict]]:
    """(prose, tables): each table with its rows and the short ones of the last lines before it."""
    prose: list[str] = []
    tables: list[dict] = []
    parts = re.split(r"(?m)^\[(/?)TABLE\]$\n?", text)
    before: list[str] = []
    for i in range(0, len(parts), 2):
        lines = parts[i].split("\n")
        if i and parts[i - 1] == "":  # inside a table
            rows = [[c.strip() for c in line.split(" | ")] for line in lines if line]
            if rows:
                tables.append({"rows": rows, "context": [c for c in before if len(c) <= CONTEXT_CHARS]})
            before = []
        else:
            prose += lines[: -1 if i < len(parts) - 1 else None]
            before = [line for line in lines if line][-CONTEXT_LINES:]
    return "\n".join(prose), tables

