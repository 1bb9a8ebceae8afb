"""Lists by their labels: which lines are items of one list, and which lists go on over pages.

A label is an optional word, an opening bracket, a counter and what closes it. Some counters can be
read in two ways (i. is one in Roman numerals or the ninth letter); what the items around them are
decides. Documents flow through line by line; a document's open lists are all that is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame

from docuflux.operators.groups import flowed
from docuflux.operators.layout import PAGE

# How far labels stand apart in font sizes, by how many of that ordered ones may stray; open lists that are looked at.
APART, STRAY, LOOK_BACK = 0.3, 4, 500
BULLETS = "•◦▪‣·∙●○■□◆◇▶*+–-"
HANGUL = ["가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"]
#: Kinds of objects that may stand between two parts of a list.
PASSED = {"header", "footer", "line", "art", "image"}
# End of fixed values.

COUNTER = r"(?P<decimal>\d{1,3})|(?P<circled>[①-⑳])|(?P<letter>[A-Za-z])|(?P<roman>[ivxlcdm]{2,9}|[IVXLCDM]{2,9})|(?P<hangul>[" + "".join(HANGUL) + "])"
LABEL = re.compile(rf"\s*(?P<prefix>(?:[^\W\d_]{{2,12}}\s+)?[(\[<]?(?:\d{{1,3}}\.)*)(?:{COUNTER})(?P<suffix>[.)\]>:]{{0,2}})(?=\s|$)")
BULLET = re.compile(rf"\s*(?P<sign>[{re.escape(BULLETS)}])(?=\s|$)")


@dataclass(frozen=True)
class Reading:
    """One way to read a label: items of a list share all but the value, which grows by one (bullets have none)."""

    style: str
    prefix: str
    suffix: str
    value: int
    length: int

    def next_to(self, last: Reading) -> bool:
        return (self.style, self.prefix, self.suffix) == (last.style, last.prefix, last.suffix) and (self.style == "bullet" or self.value == last.value + 1)


def roman(text: str) -> int | None:
    """The value of a Roman numeral in its regular form, below 400."""
    tens, ones = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    low, value = text.lower(), 0
    while low.startswith("c") and value < 300 and not low.startswith(("cd", "cm")):
        low, value = low[1:], value + 100
    for n in range(99, -1, -1):
        if low == tens[n // 10] + ones[n % 10]:
            return value + n or None
    return None


def readings(text: str | None) -> list[Reading]:
    """All ways to read a line's label. A counter without brackets, point or outer numbers is no label,
    unless it is circled."""
    if found := BULLET.match(text or ""):
        return [Reading("bullet", found["sign"], "", 0, found.end())]
    found = LABEL.match(text or "")
    if not found:
        return []
    prefix, suffix, end = found["prefix"], found["suffix"], found.end()
    kind = found.lastgroup if found.lastgroup != "suffix" else next(k for k in ("decimal", "circled", "letter", "roman", "hangul") if found[k])
    counter = found[kind]
    if kind != "circled" and not suffix and not prefix:
        return []
    shown = lambda style, value: Reading(style, prefix, suffix, value, end)
    if kind == "decimal":
        return [shown("decimal", int(counter))]
    if kind == "circled":
        return [shown("circled", ord(counter) - 0x2460 + 1)]
    if kind == "hangul":
        return [shown(f"hangul{i}", row.index(counter) + 1) for i, row in enumerate(HANGUL) if counter in row]
    case = "upper" if counter.isupper() else "lower"
    out = [shown(f"{case} letter", ord(counter.lower()) - 96)] if kind == "letter" else []
    value = roman(counter) if counter.lower()[0] in "ivxlc" else None
    return out + ([shown(f"{case} roman", value)] if value else [])


@dataclass
class Open:
    """A list so far; ways: how its last label can be read, given those before it."""

    ways: list[Reading]
    left: float
    gap: float
    first: tuple
    items: int = 1
    waiting: list = field(default_factory=list)


class Intervals:
    """The open lists of a document."""

    def __init__(self):
        self.open: list[Open] = []

    def take(self, row) -> Iterator[tuple]:
        """What becomes known with a line: rows of `items`. The latest open list that the label goes on with
        takes it, if it stands as far left (bullets within the gap, counters within some of them). A
        label that goes on with none may begin a list, whatever its value, as lists are also cut.
        Either ends the lists that stand further right."""
        ways = readings(row.text)
        if not ways or row.x0 is None:
            return
        gap = APART * (row.font_size or 10.0)
        for at in range(len(self.open) - 1, max(-1, len(self.open) - 1 - LOOK_BACK), -1):
            held = self.open[at]
            apart = abs(row.x0 - held.left)
            on = [w for w in ways if any(w.next_to(last) for last in held.ways)]
            if not on or apart > (gap if on[0].style == "bullet" else STRAY * gap):
                continue
            # an ambiguous list is as its items can all be read
            before = [last for last in held.ways if any(w.next_to(last) for w in on)]
            yield from (self._item(held, line, n, before[0], length) for line, n, length in held.waiting)
            held.waiting = []
            held.items += 1
            held.ways, held.left = on, row.x0
            self._leave(row.x0 + gap)
            yield self._item(held, row, held.items, on[0], on[0].length)
            return
        self._leave(row.x0 + gap)
        self.open.append(Open(ways, row.x0, gap, (row.page, row.seq), waiting=[(row, 1, ways[0].length)]))
        if len(self.open) > 2 * LOOK_BACK:
            del self.open[:-LOOK_BACK]

    def _leave(self, right: float) -> None:
        """Lists that stand further right were within an item that has ended."""
        if any(o.left > right for o in self.open):
            self.open = [o for o in self.open if o.left <= right]

    @staticmethod
    def _item(held: Open, row, n: int, way: Reading, length: int) -> tuple:
        return row.doc_id, row.page, row.seq, *held.first, n, way.style, way.prefix, way.suffix, length


ITEMS = "doc_id long, page long, seq long, list_page long, list_seq long, item int, style string, prefix string, suffix string, label_length int"


def items(lines: DataFrame) -> DataFrame:
    """Lines that are items of lists with two items or more: ITEMS. A list is named by its first item.

    lines: doc_id, page, seq (reading order), text, x0, font_size. Null texts and lines without a
    place have no label; an empty table gives none.
    """

    def found(group: Iterator) -> Iterator[tuple]:
        known = Intervals()
        for row in group:
            yield from known.take(row)

    return flowed(lines.select(*PAGE, "seq", "text", "x0", "font_size"), ["doc_id"], ["page", "seq"], found, ITEMS)


# lists over pages -------------------------------------------------------------------------------


@dataclass
class Part:
    """What a list has on a page: its items' rows, and the place from its first to its last item."""

    rows: list
    begin: int
    end: int


def outer_parts(page: list) -> list[Part]:
    """Parts of a page from the top; lists within another's place are in its items."""
    places: dict[tuple, list[int]] = {}
    for i, row in enumerate(page):
        if row.list_seq is not None:
            places.setdefault((row.list_page, row.list_seq), []).append(i)
    out, upto = [], -1
    for at in sorted(places.values()):
        if at[0] > upto:
            upto = at[-1]
            out.append(Part([page[i] for i in at], at[0], upto))
    return out


def one_sequence(rows: list) -> bool:
    """Whether labels read one after the other make one list."""
    ways = readings(rows[0].text)
    for row in rows[1:]:
        ways = [w for w in readings(row.text) if any(w.next_to(last) for last in ways)]
    return bool(ways)


def overlap(a, b) -> bool:
    return min(a.x1, b.x1) > max(a.x0, b.x0)


def chained(document: Iterator) -> Iterator[tuple]:
    """A document's rows to LINKED."""
    last: list = []  # up to two items of the list before
    chain, count, between = None, 0, None
    for number, group in groupby(document, key=lambda r: r.page):
        page = list(group)
        parts = {p.begin: p for p in outer_parts(page)}
        at = 0
        while at < len(page):
            row, part = page[at], parts.get(at)
            at += 1
            if part is None:
                if row.kind in PASSED:
                    continue
                if row.kind == "text" and between is None:
                    between = row
                else:
                    last, between = [], None
                continue
            first = part.rows[0]
            same = bool(last) and (last[-1].list_page, last[-1].list_seq) == (first.list_page, first.list_seq)
            fits = between is None or (between.page == number and between.x0 >= min(r.x0 for r in part.rows))
            linked = bool(last) and (same or (fits and one_sequence(last[-2:] + part.rows[:2])))
            if not linked:
                chain, count = (first.page, first.seq), 0
            elif between is not None and fits:
                if last[-1].page == between.page and overlap(last[-1], between):
                    yield between.doc_id, between.page, between.seq, *chain, count, "body"
                else:  # nothing of the list is above it on this page, so it stands before the first item there
                    count += 1
                    yield between.doc_id, between.page, between.seq, *chain, count, "lead"
            own = {(r.page, r.seq) for r in part.rows}
            for inner in page[part.begin : part.end + 1]:
                if (inner.page, inner.seq) in own:
                    count += 1
                    yield inner.doc_id, inner.page, inner.seq, *chain, count, "item"
                elif inner.kind not in PASSED:
                    yield inner.doc_id, inner.page, inner.seq, *chain, count, "body"
            last, between, at = (last + part.rows if linked else part.rows)[-2:], None, part.end + 1


LINKED = "doc_id long, page long, seq long, chain_page long, chain_seq long, item int, role string"


def linked(objects: DataFrame, found: DataFrame) -> DataFrame:
    """Lists that go on in the next one, over pages or a paragraph: LINKED, a row for each object of a list,
    which is named by its first item; item counts through all parts.

    A list goes on with the next one if it is the same list on a later page, or if the last two labels
    of the one and the first two of the other are one sequence, and if at most one text stands between
    them (headers, footers, lines and images aside) that begins no further left and is on the
    second one's page. That text is absorbed: as the body of the item above it if that is on its page and they
    overlap from side to side, else as an item without a label before the next. What stands
    between two items of a page is the body of the first. objects: doc_id, page, seq (reading order),
    kind, text, x0, x1; found: `items` of them.
    """
    names = found.select(*PAGE, "seq", "list_page", "list_seq")
    rows = objects.select(*PAGE, "seq", "kind", "text", "x0", "x1").join(names, [*PAGE, "seq"], "left")
    return flowed(rows, ["doc_id"], ["page", "seq"], chained, LINKED)
