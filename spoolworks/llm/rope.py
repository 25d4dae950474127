"""Ropes: a text as a balanced tree of short pieces, cut and joined without copying it.

A leaf holds a piece, a node two ropes. Both cache how many units and how many code points they hold, so a cut at either
kind of rank walks one path down and makes a few new nodes; the pieces on either side are shared, not copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

#: Units of a leaf at most.
LEAF_UNITS = 1024


class Rope:
    """`left` and `right`, or for a leaf `text` and, where units are longer than a code point, the ends of its units."""

    __slots__ = ("ends", "left", "points", "right", "text", "units")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.ends, self.left, self.right = text, ends, left, right
        if left is not None:
            self.units, self.points = left.units + right.units, left.points + right.points
        else:
            self.units, self.points = len(text) if ends is None else len(ends), len(text)

    def pieces(self) -> Iterator[str]:
        """The pieces in order. The tree is walked with a stack: it may be deeper than Python's calls may nest."""
        todo = [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                yield at.text
            else:
                todo += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.pieces())


def unit_ends(text: str, unit: re.Pattern) -> list[int]:
    """Where the units of `text` end: at the end of each match of `unit`, found left to right. What stands before a match belongs to
    its unit; what stands after the last one is a unit of its own. Empty matches are none."""
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def rope(text: str, unit: re.Pattern | None = None, leaf_units: int = LEAF_UNITS) -> Rope:
    """A balanced rope of `text`. Without `unit` each code point is a unit."""
    if unit is None:
        level = [Rope(text[i : i + leaf_units]) for i in range(0, len(text), leaf_units)]
    else:
        ends, level = unit_ends(text, unit), []
        for i in range(0, len(ends), leaf_units):
            first, own = ends[i - 1] if i else 0, ends[i : i + leaf_units]
            level.append(Rope(text[first : own[-1]], [e - first for e in own]))
    while len(level) > 1:
        level = [Rope(left=level[i], right=level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else Rope(ends=None if unit is None else [])


def joined(*parts: Rope) -> Rope:
    """The parts one after another. Empty ones are left out."""
    held = [p for p in parts if p.points] or [parts[0]]
    return list(accumulate(held, lambda a, b: Rope(left=a, right=b)))[-1]


def leaf_cut(leaf: Rope, rank: int, points: bool) -> tuple[Rope, Rope]:
    if leaf.ends is None:
        return Rope(leaf.text[:rank]), Rope(leaf.text[rank:])
    if points:
        before = [e for e in leaf.ends if e <= rank]
        after = [e - rank for e in leaf.ends if e > rank]
        if rank and (not before or before[-1] < rank):
            before.append(rank)  # a cut inside a unit makes two of it
        return Rope(leaf.text[:rank], before), Rope(leaf.text[rank:], after)
    at = leaf.ends[rank - 1] if rank else 0
    return Rope(leaf.text[:at], leaf.ends[:rank]), Rope(leaf.text[at:], [e - at for e in leaf.ends[rank:]])


def split(whole: Rope, rank: int, points: bool = False) -> tuple[Rope, Rope]:
    """What lies before and after `rank` units, or code points. A rank outside the rope is taken as its nearest end."""
    size = whole.points if points else whole.units
    rank, path, at = min(max(rank, 0), size), [], whole
    while at.left is not None:
        held = at.left.points if points else at.left.units
        path.append((at, rank < held))
        if rank < held:
            at = at.left
        else:
            at, rank = at.right, rank - held
    before, after = leaf_cut(at, rank, points)
    for node, went_left in reversed(path):
        if went_left:
            after = joined(after, node.right)
        else:
            before = joined(node.left, before)
    return before, after
