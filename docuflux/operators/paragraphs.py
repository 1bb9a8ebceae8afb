"""Paragraphs: lines become blocks in nine passes, each over the blocks of the one before it.

A pass goes down a page and joins a block to the one above it where a rule of the pass holds for
the two as they are then. Rules are rows of a table: how the lines that meet are aligned, what the
blocks above and below may be, what else must hold, and what the joined block becomes. Passes are
chained generators, so that a page flows through all nine with a block held for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuflux.operators.blocks import bulleted
from docuflux.operators.groups import flowed
from docuflux.operators.layout import PAGE

# Fixed values, in heights of the lower line: sides that are aligned, centres, a gap and an overlap of lines, a block's spacing.
SIDE, CENTRE, GAP, OVERLAP, SPACING, TIGHT = 0.1, 0.2, 1.0, 0.5, 0.3, 0.1
# Font sizes and weights that are close.
CLOSE = 0.1
# End of fixed values.


@dataclass
class Block:
    """Lines in order (seq, x0, y0, x1, y1, font_size, style, labelled); alignment of the block, and
    whether its first or last line was recognised as such."""

    first: tuple
    last: tuple
    seqs: list[int]
    sizes: set[float]
    alignment: str | None = None
    started: bool = False
    ended: bool = False
    #: Distance of the bottoms of the first two lines and of the last two.
    spacing: tuple[float, float] | None = None
    passes: list[int] = field(default_factory=list)

    @property
    def shape(self) -> str:
        return "line" if len(self.seqs) == 1 else self.alignment or "free"


@dataclass(frozen=True)
class Rule:
    """aligned: how the lines that meet are; above, below: shapes that the blocks may have (all if
    none are named); apart: both may have several lines. The rest: further conditions; to: the joined
    block's alignment ("" leaves it as it is); start, end: what becomes known of its first and last line
    (None leaves it, "below" takes it from the block below)."""

    aligned: str | None = None
    above: tuple[str, ...] = ()
    below: tuple[str, ...] = ()
    both: bool = False
    unlabelled: bool = False
    style: bool = False
    strict_with_justified: bool = False
    unstarted: bool = False
    unended: bool = False
    overlapping: bool = False
    hanging: bool = False
    close_style: bool = False
    to: str = ""
    start: bool | None = None
    end: bool | str | None = None


LEFT = ("line", "left", "justify")
#: What the passes join, in order.
PASSES: list[tuple[str, list[Rule]]] = [
    ("justified lines", [Rule("justify", to="justify")]),
    ("first and last lines of justified blocks", [
        Rule("right", above=("line",), below=("justify",), unstarted=True, to="justify", start=True, end="below"),
        Rule("left", above=("justify",), below=("line",), unended=True, end=True),
    ]),
    ("left-aligned lines of one style", [Rule("left", LEFT, LEFT, both=True, unlabelled=True, style=True, strict_with_justified=True, to="left", end=False)]),
    ("left-aligned lines", [Rule("left", LEFT, LEFT, both=True, unlabelled=True, strict_with_justified=True, to="left", end=False)]),
    ("first lines of left-aligned blocks", [Rule(above=("line",), below=("left",), unlabelled=True, unstarted=True, overlapping=True, to="left", start=True)]),
    ("paragraphs of two lines", [Rule(above=("line",), below=("line",), unlabelled=True, hanging=True, to="left", start=True, end=True)]),
    ("centred lines", [Rule("centre", both=True, to="centre")]),
    ("right-aligned lines", [Rule("right", ("line", "right"), ("line", "right"), to="right")]),
    ("other lines", [Rule(above=("line", "free"), below=("line", "free"), unlabelled=True, overlapping=True, close_style=True)]),
]


def alignment(a, b) -> str | None:
    h = min(a.y1 - a.y0, b.y1 - b.y0)
    left, right = abs(a.x0 - b.x0) <= SIDE * h, abs(a.x1 - b.x1) <= SIDE * h
    if left and right:
        return "justify"
    if left:
        return "left"
    if abs(a.x0 + a.x1 - b.x0 - b.x1) <= CENTRE * h:
        return "centre"
    return "right" if right else None


def follow(above: Block, below: Block, both: bool, tight: bool) -> bool:
    """Whether a block's lines can go on below another: one under the other, no more than a line's
    height apart, and at a spacing that blocks of several lines have had so far."""
    a, b = above.last, below.first
    if len(above.seqs) > 1 and len(below.seqs) > 1 and not both:
        return False
    h = min(a.y1 - a.y0, b.y1 - b.y0)
    step = a.y0 - b.y0
    if step <= 0 or not -OVERLAP * h <= a.y0 - b.y1 <= GAP * h:
        return False
    known = ([above.spacing[1]] if above.spacing else []) + ([below.spacing[0]] if below.spacing else [])
    return all(step - s <= SPACING * h and (not tight or abs(step - s) <= TIGHT * h) for s in known)


def holds(rule: Rule, above: Block, below: Block) -> bool:
    a, b = above.last, below.first
    if rule.aligned is not None and alignment(a, b) != rule.aligned:
        return False
    if rule.above and above.shape not in rule.above or rule.below and below.shape not in rule.below:
        return False
    if not any(abs(x - y) <= CLOSE for x in above.sizes for y in below.sizes):
        return False
    if rule.unlabelled and b.labelled or rule.unstarted and below.started or rule.unended and above.ended:
        return False
    justified = rule.strict_with_justified and "justify" in (above.shape, below.shape)
    if (rule.style or justified) and a.style != b.style:
        return False
    if rule.overlapping and min(a.x1, b.x1) <= max(a.x0, b.x0):
        return False
    if rule.hanging and (a.x0 < b.x0 or a.x1 < b.x1):
        return False
    if rule.close_style and (abs(above.first.font_size - b.font_size) > CLOSE or abs(above.first.font_weight - b.font_weight) > CLOSE):
        return False
    return follow(above, below, rule.both, justified)


def together(rule: Rule, above: Block, below: Block, number: int) -> Block:
    step = above.last.y0 - below.first.y0
    spacing = (above.spacing[0] if above.spacing else step, below.spacing[1] if below.spacing else step)
    end = above.ended if rule.end is None else below.ended if rule.end == "below" else rule.end
    return Block(
        above.first, below.last, above.seqs + below.seqs, above.sizes | below.sizes, rule.to or above.alignment,
        above.started if rule.start is None else rule.start, end, spacing, [*above.passes, number, *below.passes],
    )


def one_pass(blocks: Iterable[Block], number: int, rules: list[Rule]) -> Iterator[Block]:
    held = None
    for block in blocks:
        rule = next((r for r in rules if held is not None and holds(r, held, block)), None)
        if rule is not None:
            held = together(rule, held, block, number)
            continue
        if held is not None:
            yield held
        held = block
    if held is not None:
        yield held


def blocks_of(lines: Iterable, passes=PASSES) -> Iterator[Block]:
    """lines: in order, with the attributes of `Block`'s lines and font_weight."""
    single = (Block(line, line, [line.seq], {line.font_size}) for line in lines)
    return reduce(lambda blocks, p: one_pass(blocks, p[0], p[1][1]), enumerate(passes, 1), single)


def detected(lines: DataFrame) -> DataFrame:
    """Each line's paragraph: doc_id, page, seq, paragraph (from 1 in reading order), line (from 1),
    joined (the pass that joined the line to the one above it, null on first lines), alignment,
    started, ended.

    lines: doc_id, page, seq (order on the page), x0, y0, x1, y1, text, font_size, font_weight, color;
    a row for each line. Lines without a box are paragraphs of their own; an empty table gives none.
    """
    style = F.concat_ws("|", F.col("font_size"), F.col("font_weight"), F.col("color"))
    rows = lines.select(*PAGE, "seq", "x0", "y0", "x1", "y1", F.coalesce("font_size", F.lit(0.0)).alias("font_size"), F.coalesce("font_weight", F.lit(0.0)).alias("font_weight"), style.alias("style"), bulleted(F.col("text")).alias("labelled"))
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    nowhere = F.lit(float("nan"))  # no comparison holds

    def found(group: Iterator) -> Iterator[tuple]:
        first = next(group)
        every = (line for part in ([first], group) for line in part)
        for n, block in enumerate(blocks_of(every), 1):
            for k, seq in enumerate(block.seqs):
                yield first.doc_id, first.page, seq, n, k + 1, block.passes[k - 1] if k else None, block.alignment, block.started, block.ended

    rows = rows.withColumns({c: F.when(boxed, F.col(c)).otherwise(nowhere) for c in ("x0", "y0", "x1", "y1")})
    return flowed(rows, PAGE, ["seq"], found, "doc_id long, page long, seq long, paragraph int, line int, joined int, alignment string, started boolean, ended boolean")
