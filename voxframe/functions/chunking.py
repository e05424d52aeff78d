"""Cutting a stream of text into sentence chunks, part by part, with the same result as in one go.

Text between single or double backticks and between fences is left out. What is left is cut at
blank lines and after a full stop, exclamation or question mark with white space. A part of a
text knows neither whether it begins inside of code nor what its first words belong to, so:

* ``CodeMap`` maps each state in which a part may begin to the one it ends in; maps of
  neighbouring parts compose.
* ``Cutter`` cuts a part whose state is known: a head up to its first cut, whole chunks, and a
  tail after its last cut.
* ``Joint`` joins what lies between two cuts, the tail of one part and the heads of the next,
  and cuts it again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

CUT = re.compile(r"\n\n+|(?<=[.!?])\s+")
_TICKS = re.compile(r"`+|[^`]+")

#: Ticks seen last (0, 1, 2, 3 or more) times four, plus two in a fence, plus one in inline code.
STATES = 16


def after(state: int, text: str) -> tuple[int, str]:
    """The state after a text, and what of the text lies outside of code."""
    ticks, fence, inline = state >> 2, state >> 1 & 1, state & 1
    out = []
    for part in _TICKS.findall(text):
        if part[0] == "`":
            ticks = min(3, ticks + len(part))
            continue
        if ticks == 3:
            fence ^= 1
        elif ticks and not fence:
            inline ^= 1
        ticks = 0
        if not fence and not inline:
            out.append(part)
    return ticks << 2 | fence << 1 | inline, "".join(out)


class CodeMap:
    """Where each state leads; two maps in a row are one again."""

    def __init__(self) -> None:
        self.exits = list(range(STATES))

    def add(self, text: str) -> None:
        if "`" in text or any(e >> 2 for e in self.exits):
            once = [after(s, text)[0] for s in range(STATES)]
            self.exits = [once[e] for e in self.exits]


def _large(chunk: str) -> bool:
    return len(chunk.encode()) > 2


class Cutter:
    """The ordered texts of one part; rows are (no, kind, chunk, free, sizes, places).

    Kind 0 is the head, where `no` is 1 if a cut follows it; 1 a whole chunk; 2 the tail. Heads
    and tails carry the size and place of every text they are made of. A chunk comes free at
    the place where its cut shows; a head's `free` is where its cut begins.
    """

    def __init__(self) -> None:
        self.state, self.cuts, self.no = 0, 0, 0
        self.texts: list[str] = []
        self.places: list[int] = []
        self.last = ""

    def enter(self, state: int) -> None:
        self.state = state

    def feed(self, place: int, text: str) -> list[tuple]:
        self.state, plain = after(self.state, text)
        self.texts.append(plain)
        self.places.append(place)
        # what is held has no cut, so one can only begin at its last character
        seen = self.last + plain
        self.last = seen[-2:]
        if not CUT.search(seen):
            return []
        *done, rest = CUT.split("".join(self.texts))
        out = []
        for chunk in done:
            if not self.cuts:
                out.append(self._edge(0, chunk, 1))
            elif _large(chunk.strip()):
                out.append((self.no, 1, chunk.strip(), place, [], []))
                self.no += 1
            self.cuts += 1
        self.texts, self.places, self.last = [rest], [place], rest[-2:]
        return out

    def _edge(self, kind: int, text: str, no: int) -> tuple:
        sizes, left, free = [], len(text), None
        for t, place in zip(self.texts, self.places, strict=True):
            if free is None and left < len(t):
                free = place  # the text in which the cut begins
            sizes.append(min(left, len(t)))
            left -= sizes[-1]
        return (no, kind, text, self.places[-1] if free is None else free, sizes, list(self.places))

    def rest(self) -> list[tuple]:
        text = "".join(self.texts)
        if not self.places:
            return []
        return [self._edge(2 if self.cuts else 0, text, 0)]


class Joint:
    """The fragments between two cuts, in order. Left open at the end of a unit, only a flush frees what remains."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.sizes: list[int] = []
        self.places: list[int] = []
        self.block, self.flush, self.open, self.free = None, -1, False, -1

    def add(self, block: int, kind: int, text: str, free: int, sizes: list[int], places: list[int], flush: int, open_: bool) -> None:
        self.texts.append(text)
        self.sizes += sizes
        self.places += places
        self.block = block if self.block is None else self.block
        self.flush, self.open, self.free = flush, open_, free

    def chunks(self) -> list[tuple]:
        text = "".join(self.texts)
        ends = list(accumulate(self.sizes))
        at = lambda i: self.places[min(bisect_right(ends, i), len(self.places) - 1)]
        out, start = [], 0
        for m in CUT.finditer(text):
            # white space after a mark shows at once, a blank line with its second newline
            shown = m.start() + (0 if m.start() and text[m.start() - 1] in ".!?" else 1)
            out.append((text[start : m.start()].strip(), at(shown)))
            start = m.end()
        left = text[start:].strip()
        if not self.open:
            out.append((left, self.free if text[-1:] in (".", "!", "?", "\n") else self.places[-1]))
        elif self.flush >= 0:
            out.append((left, self.flush))
        return [(self.block, i, chunk, free) for i, (chunk, free) in enumerate(c for c in out if _large(c[0]))]


class Unit:
    """A unit that is seen whole; rows are (row id, number, chunk)."""

    def __init__(self) -> None:
        self.cutter, self.no = Cutter(), 0
        self.flush: tuple[int, object] = (-1, None)

    def _row(self, chunk: str, free: object) -> list[tuple]:
        chunk = chunk.strip()
        if not _large(chunk):
            return []
        self.no += 1
        return [(free, self.no - 1, chunk)]

    def feed(self, pos: int, own_id: object, text: str, flush: int, free: int, flush_id: object, free_id: object) -> list[tuple]:
        self.flush = (flush, flush_id)
        at = free_id if free > pos else own_id
        out = []
        for _, _, chunk, *_ in self.cutter.feed(pos, text):
            out += self._row(chunk, at)
        return out

    def rest(self) -> list[tuple]:
        flush, at = self.flush
        return self._row("".join(self.cutter.texts), at) if flush >= 0 else []
