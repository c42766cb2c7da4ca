"""Cutting texts at natural boundaries.

Boundaries, strongest first: page breaks and headings, blank lines, list items and other lines,
sentence ends, clause marks, white space, any other place between two characters (never inside
a character with its combining marks or between CR and LF).  Prefix sums give the tokens of any
stretch at once, so a text of n characters is cut in n log n.
"""

from __future__ import annotations

import re

import numpy as np

from lectern.functions.text import CJK_RANGES

#: Pattern of text before a cut, and the strength of a cut right after it; later ones override.
BOUNDARIES = (
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:]\s+|[，、；：]")),
    (3, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？…]+[”’」』）]*")),
    (4, re.compile(r"(?:\r\n|\r|\n)[ \t]*")),
    (5, re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")),
    (6, re.compile(r"\f\s*|(?:^|[\r\n]+)(?=[ \t]*#{1,6}[ \t])")),
)


class Measured:
    """A text with the prefix sums and boundary strengths that cutting needs."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        wide = np.zeros(len(points), bool)
        for low, high in CJK_RANGES:
            wide |= (points >= low) & (points <= high)
        self.wide = np.concatenate([[0], np.cumsum(wide)])
        self.length = len(points)
        #: Four times the tokens, as far as rounding goes; grows with every character.
        self.weight = np.arange(self.length + 1) + 3 * self.wide
        strength = np.zeros(self.length + 1, np.int8)
        for value, pattern in BOUNDARIES:
            for match in pattern.finditer(text):
                strength[match.end()] = value
        marks = ((points >= 0x300) & (points <= 0x36F)) | (points == 0x200D) | ((points >= 0xFE00) & (points <= 0xFE0F))
        inside = np.flatnonzero(marks)
        strength[inside] = -1
        strength[np.flatnonzero((points[1:] == 10) & (points[:-1] == 13)) + 1] = -1
        self.strength = strength

    def tokens(self, start: int, end: int) -> int:
        wide = int(self.wide[end] - self.wide[start])
        return max(1, wide + (end - start - wide + 3) // 4)

    def prefix(self, start: int, most: int) -> int:
        """The end of the longest stretch from ``start`` of at most ``most`` tokens, one character at least."""
        end = int(np.searchsorted(self.weight, self.weight[start] + 4 * most, "right")) - 1
        while end > start + 1 and self.tokens(start, end) > most:
            end -= 1
        return max(min(end, self.length), start + 1)

    def cut(self, start: int, end: int) -> int:
        """The place to cut ``start:end``, strictly inside."""
        low, high = self.weight[start], self.weight[end]
        first = int(np.searchsorted(self.weight, low + (high - low) / 4))
        last = int(np.searchsorted(self.weight, high - (high - low) / 4, "right"))
        first, last = max(first, start + 1), min(max(last, first + 1), end)
        if first >= last:
            return start + 1
        near = self.strength[first:last]
        best = np.flatnonzero(near == near.max())
        middle = int(np.searchsorted(self.weight, (low + high) / 2)) - first
        return first + int(best[np.argmin(np.abs(best - middle))])

    def overlap_start(self, start: int, least: int, overlap: int) -> int:
        """Where the overlap before ``start`` begins: at a word, at most ``overlap`` tokens before."""
        if overlap <= 0:
            return start
        begin = int(np.searchsorted(self.weight, self.weight[start] - 4 * overlap))
        while begin < start and self.tokens(begin, start) > overlap:
            begin += 1
        begin = max(begin, least)
        half = (begin + start) // 2
        places = np.flatnonzero(self.strength[begin : half + 1] > 0)
        if begin == 0 or (len(places) == 0 and self.strength[begin] >= 0):
            return begin
        if len(places) == 0:
            sound = np.flatnonzero(self.strength[begin : start + 1] >= 0)
            return begin + int(sound[0])
        return begin + int(places[0])


def pieces(text: str | Measured, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) of each piece of ``text``, in order."""
    whole = text if isinstance(text, Measured) else Measured(text)
    if whole.tokens(0, whole.length) <= limit:
        return [(0, 0, whole.length)]
    overlap = max(0, min(overlap, limit - 1))
    room, done, waiting = limit - overlap, [], [(0, whole.length)]
    while waiting:
        start, end = waiting.pop()
        if whole.tokens(start, end) <= room or end - start < 2:
            done.append((start, end))
        else:
            middle = whole.cut(start, end)
            waiting += [(middle, end), (start, middle)]
    out, least = [], 0
    for start, end in done:
        least = whole.overlap_start(start, least, overlap) if start else 0
        out.append((least, start, end))
    return out


def windows(text: str, target: int, overlap: int, most: int) -> list[tuple[int, int]]:
    """(start, end) of consecutive windows over ``text``, each up to ``target`` tokens or, without a boundary
    before, ``most``; each but the first begins about ``overlap`` tokens before the end of the one before.

    A window ends at the strongest boundary in its last third, the last of those as strong."""
    whole, out, start, least = Measured(text), [], 0, 0
    overlap = max(0, min(overlap, target - 1))
    while start < whole.length:
        begin = whole.overlap_start(start, least, overlap) if start else 0
        begin = begin if whole.strength[begin] > 0 else start  # no overlap rather than one that begins in a word
        end = whole.prefix(begin, target)
        if end < whole.length:
            early = max(start + 1, whole.prefix(begin, 2 * target // 3))
            near = whole.strength[early : end + 1]
            if len(near) and near.max() > 0:
                end = early + int(np.flatnonzero(near == near.max())[-1])
            else:
                end = whole.prefix(begin, most)
                while end > start + 1 and whole.strength[end] < 0 and end < whole.length:
                    end -= 1
        end = max(end, start + 1)
        out.append((begin, end))
        least, start = begin, end
    return out
