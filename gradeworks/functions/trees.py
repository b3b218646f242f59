"""Trees of HTML texts and their distance; nothing here needs Spark."""

from __future__ import annotations

import re
import string
from collections import Counter
from html.parser import HTMLParser


class Tree(HTMLParser):
    """Reads HTML into nested ``[label, children]`` lists; attributes and blank texts are dropped."""

    VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "col"))

    def __init__(self) -> None:
        super().__init__()
        self.root: list = ["root", []]
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.path[-1][1].append(node)
        if tag not in self.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self.path[-1][1].append([data.strip(), []])


def pipe_table(text: str) -> str:
    """A pipe table with a separator line as HTML, its first lines as head; any other text as it is."""
    lines = [line.strip() for line in text.strip().splitlines()]
    first = next((i for i, line in enumerate(lines) if "|" in line), len(lines))
    last = next((i for i in range(first, len(lines)) if "|" not in lines[i]), len(lines))
    table = lines[first:last]
    ruled = next((i for i, line in enumerate(table) if re.fullmatch(r"\|?\s*[-:]+[-| :]*", line)), None)
    if len(table) < 2 or ruled is None:
        return text

    def part(name: str, cell: str, rows: list[str]) -> str:
        made = ["".join(f"<{cell}>{c.strip()}</{cell}>" for c in row.strip("|").split("|")) for row in rows]
        return f"<{name}>" + "".join(f"<tr>{r}</tr>" for r in made) + f"</{name}>" if rows else ""

    return "<table>" + part("thead", "th", table[:ruled]) + part("tbody", "td", table[ruled + 1 :]) + "</table>"


def read_tree(markup: str) -> list:
    """The first table of an HTML text or pipe table, or the tree of the whole text without one."""
    parser = Tree()
    parser.feed(pipe_table(markup) if "|" in markup and "<table" not in markup.lower() else markup)

    def table(node: list) -> list | None:
        return node if node[0] == "table" and node[1] else next((t for t in map(table, node[1]) if t), None)

    return table(parser.root) or parser.root


def table_words(text: str) -> Counter:
    """The words of a text, without case and ASCII punctuation, with their counts."""
    return Counter(text.lower().translate(str.maketrans("", "", string.punctuation)).split())


def rough_similarity(a: str, b: str) -> float:
    """How alike two tables are without reading trees: by rows and cells of markup, else by words.

    Markup: the mean of the ratios of rows and of cells; other texts: F1 of their bags of words.
    """
    if re.search("<table|<tr", a, re.I):
        rows, cells = ([max(1, len(re.findall(tag, x, re.I))) for x in (a, b)] for tag in (r"<tr[\s>]", r"<t[dh][\s>]"))
        return 0.5 * min(rows) / max(rows) + 0.5 * min(cells) / max(cells)
    x, y = table_words(a), table_words(b)
    if not x and not y:
        return 1.0
    return 2 * (x & y).total() / (x.total() + y.total())


def tree_size(node: list) -> int:
    """Nodes of a tree."""
    return 1 + sum(tree_size(c) for c in node[1])


def tree_distance(a: list, b: list) -> int:
    """Edits between two ordered trees that keep their roots paired: whole subtrees come and go."""
    left, right = a[1], b[1]
    row = [0]
    for y in right:
        row.append(row[-1] + tree_size(y))
    for x in left:
        gone = tree_size(x)
        last, row[0] = row[0], row[0] + gone
        for j, y in enumerate(right, 1):
            last, row[j] = row[j], min(row[j] + gone, row[j - 1] + tree_size(y), last + tree_distance(x, y))
    return row[-1] + (a[0] != b[0])
