"""Tables with spans, and lists and tables in cells, against a layout drawn character by character; time on long pages."""

import random
import time

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import extract


def drawn(sections):
    """A table of sections of rows of (colspan, rowspan, lines), drawn on a grid of characters."""
    grid, boxes, top = {}, [], 0
    for rows in sections:
        for r, row in enumerate(rows):
            c = 0
            for across, down, lines in row:
                while (top + r, c) in grid:
                    c += 1
                down = len(rows) - r if down == 0 else min(down, len(rows) - r)
                for i in range(down):
                    for j in range(across):
                        grid[top + r + i, c + j] = True
                if lines != [""]:
                    boxes.append((top + r, down, c, across, lines))
                c += across
        top += len(rows)
    width, height = {}, [0] * top
    for r, down, c, across, lines in boxes:
        if across == 1:
            width[c] = max(width.get(c, 0), max(map(len, lines)))
    for n in range(2, 6):
        for r, down, c, across, lines in boxes:
            if across == n:
                own = [k for k in range(c, c + across) if k in width]
                have = sum(width[k] + 2 for k in own) - 2 if own else 0
                if max(map(len, lines)) > have or not own:
                    width[own[-1] if own else c] = width.get(own[-1] if own else c, 0) + max(map(len, lines)) - have
    for r, down, c, across, lines in boxes:
        if down == 1:
            height[r] = max(height[r], len(lines))
    for end in range(1, top + 1):
        for r, down, c, across, lines in boxes:
            if down > 1 and r + down == end:
                height[end - 1] += max(0, len(lines) - sum(height[r:end]))
    chars = {}
    for r, down, c, across, lines in boxes:
        first = min(k for k in range(c, c + across) if k in width)
        x0 = sum(width[k] + 2 for k in width if k < first)
        for i, line in enumerate(lines):
            for j, ch in enumerate(line):
                chars[sum(height[:r]) + i, x0 + j] = ch
    return ["".join(chars.get((y, x), " ") for x in range(max([j for i, j in chars if i == y], default=-1) + 1)).rstrip() for y in range(sum(height))]


CELLS = [
    ("", [""]),
    ("a", ["a"]),
    ("longer words", ["longer words"]),
    ("one<br>two", ["one", "two"]),
    ("<p>first</p><p>second</p>", ["first", "", "second"]),
    ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", ["- x", "- y", "  3. z"]),
    ("<h3>Head</h3>text", ["Head", "", "text"]),
    ("t<table><tr><td>1<td>22<tr><td>333<td>4</table>", ["t", "", "1    22", "333  4"]),
]


@pytest.mark.parametrize("seed", range(60))
def test_random_tables(seed):
    rng = random.Random(seed)
    sections, page = [], []
    for _ in range(rng.randint(1, 3)):
        rows, html = [], []
        for _ in range(rng.randint(1, 4)):
            row, cells = [], []
            for _ in range(rng.randint(0, 4)):
                text, lines = rng.choice(CELLS)
                across, down = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3, 0])
                row.append((across, down, lines))
                cells.append(f"<td{f' colspan={across}' if across > 1 else ''}{f' rowspan={down}' if down != 1 else ''}>{text}</td>")
            rows.append(row)
            html.append(f"<tr>{''.join(cells)}</tr>")
        sections.append(rows)
        page.append(f"<tbody>{''.join(html)}</tbody>")
    want = drawn(sections)
    assert extract(f"<table>{''.join(page)}</table>") == "\n".join(want)


def test_a_page_laid_out_in_a_table_keeps_its_blocks():
    page = "<table><tr><td><p>First para.</p><p>Second para.</p><ul><li>one</li><li>two</li></ul><table><tr><td>x</td><td>y</td></tr><tr><td>longer</td><td>z</td></tr></table></td></tr></table>"
    assert extract(page) == "First para.\n\nSecond para.\n\n- one\n- two\n\nx       y\nlonger  z"


def test_spans_align():
    page = "<table><tr><td colspan=2>Wide heading</td><td>C</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"
    assert extract(page) == "Wide heading  C\na  b          c" or extract(page).split("\n")[0].index("C") == extract(page).split("\n")[1].index("c")


def test_spans_that_are_no_numbers():
    for v in ("x", "-2", "0", "", "1.5", "+1"):
        assert extract(f"<table><tr><td colspan='{v}'>a<td>b<tr><td>c<td>d</table>") == "a  b\nc  d"
    assert extract("<table><tr><td rowspan=99999999999>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert extract("<table><tr><td colspan=99999999999>a<tr><td>c<td>d</table>") == "a\nc  d"


def test_pre_in_cells_and_captions():
    assert extract("<table><caption>Of<br>two</caption><tr><td><pre>a  b\n c</pre><td>x</table>") == "Of\ntwo\na  b  x\n c"


def test_list_numbers():
    assert extract("<ol reversed><li>a<li>b<li value=9>c<li>d</ol>") == "4. a\n3. b\n9. c\n8. d"
    assert extract("<ol start=5 reversed><li>a<li>b</ol><ol><li>x<li value=-2>y<li>z</ol>") == "5. a\n4. b\n\n1. x\n-2. y\n-1. z"
    assert extract("<ol><li value=x>a<li>b</ol><ul><li value=7>u</ul>") == "1. a\n2. b\n\n- u"


def test_tables_and_pre_in_lists_are_indented():
    assert extract("<ul><li>x<ul><li>in<table><tr><td>1<td>2<tr><td>33<td>4</table></ul></ul>") == "- x\n  - in\n\n    1   2\n    33  4"
    assert extract("<ul><li><pre>a\n  b</pre></ul>") == "- a\n    b"


def test_wide_lines_do_not_widen_their_column(monkeypatch):
    monkeypatch.setattr(html_text, "WIDEST", 10)
    assert extract("<table><tr><td>a line beyond ten<td>x<tr><td>short<td>y</table>") == "a line beyond ten  x\nshort  y"


def test_deep_lists_stop_at_a_level():
    lines = extract("<ul><li>x" * 50).split("\n")
    assert [len(x) for x in lines] == [2 * min(i, 32) + 3 for i in range(50)]


@pytest.mark.parametrize(
    "page",
    ["</ " * 340_000, "<a><table><tr><td>" + "<b>" * 90_000 + "</a>" * 180_000, "<ul><li>x" * 100_000, "<table>" + "<tr><td rowspan=65534>a" * 40_000, "<table>" + "<tr><td>" + "x " * 300_000 + "<td>y" + "<tr><td>a<td>b" * 20_000, "<table>" + ("<tr>" + "<td colspan=1000>a" * 20) * 500, "<!--" * 250_000, "<a href='" * 110_000, "<textarea>" * 100_000],
    ids=["bogus", "fenced", "lists", "rowspans", "wide", "colspans", "comments", "attributes", "raw"],
)
def test_long_pages_take_time_in_proportion(page):
    t = time.process_time()
    extract(page)
    assert time.process_time() - t < 6  # some 2 s on a free core; quadratic reading took minutes
