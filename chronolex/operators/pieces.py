"""Pieces of speech from timed tokens, runs or words: plain functions over one medium's rows in order, for fold()."""

from __future__ import annotations

import bisect
import unicodedata

from chronolex.functions import tokens as tk
from chronolex.functions.text import CLAUSE_ENDERS, SENTENCE_ENDERS

GAP, LONG_RUN, SOFT, HARD = 0.5, 2.0, 5.0, 7.0
# What ends a piece of tokens, and opening marks, which belong to the next word.
TOKEN_ENDS, OPENING = ".!?。！？", "「『（(\"“"


def side(t: float, boundaries: list[float]) -> int:
    """How many of the sorted boundaries are at or before t."""
    return bisect.bisect_right(boundaries, t)


def _mark(x: str) -> bool:
    return unicodedata.category(x)[0] in "PS"


Piece = tuple[str, float, float]


class _Grouping:
    """Takes timed input one by one and gives out each piece as soon as nothing can change it."""

    def __init__(self, boundaries: list[float] = (), every: float | None = None):
        #: the side of a time: how many boundaries, given or at every so many seconds, are at or before it
        self.side = (lambda t: int(t // every)) if every else (lambda t, known=sorted(boundaries): side(t, known))
        self.ready: list[Piece] = []
        self.last: Piece | None = None

    def give(self, text: str, start: float, end: float) -> None:
        """A piece; one without letters or digits is the end of the one before."""
        if self.last and text and not tk.has_content(text):
            self.last = (self.last[0] + text, self.last[1], max(self.last[2], end))
        elif text:
            self.ready += [self.last] if self.last else []
            self.last = (text, start, max(end, start))

    def take(self) -> list[Piece]:
        out, self.ready = self.ready, []
        return out

    def feed(self, text: str, first: float | None, last: float | None) -> list[Piece]:
        self.add(text, first, last)
        return self.take()

    def flush(self) -> list[Piece]:
        self.close()
        self.ready += [self.last] if self.last else []
        self.last = None
        return self.take()

    def over(self, rows) -> list[Piece]:
        return [p for row in rows for p in self.feed(*row)] + self.flush()


class TokenPieces(_Grouping):
    """Pieces of sub-word tokens: closed after a sentence's end, and where a word starts after a gap of 0.5 s or 5 s of
    speech. Signs count in the text and not in the time; special tokens, in angle brackets, are left out."""

    def __init__(self):
        super().__init__()
        self.text, self.start, self.end = "", None, 0.0

    def close(self) -> None:
        if self.start is not None and self.text.strip():
            self.ready.append((self.text.strip(), self.start, max(self.end, self.start)))
        self.text, self.start = "", None

    def add(self, raw: str, first: float, last: float) -> None:
        if not raw or (raw[0] == "<" and raw[-1] == ">"):
            return
        shown = raw.replace("▁", " ")
        signs = all(unicodedata.category(x)[0] == "P" for x in shown.strip())
        starts_word = shown[0] == " " or tk.is_dense(raw[0]) or "가" <= raw[0] <= "힣"
        if self.start is not None and starts_word and (first - self.end > GAP or self.end - self.start >= SOFT):
            self.close()
        if not signs:
            self.start, self.end = first if self.start is None else self.start, max(self.end, last)
        self.text += shown
        if shown.strip()[-1:] in tuple(TOKEN_ENDS):
            self.close()


class RunPieces(_Grouping):
    """Pieces of runs of text, some without a time: closed before a gap, a run of 2 s, the other side of a boundary or
    7 s; after a sentence's end, or after 5 s where a word or clause ends."""

    def __init__(self, boundaries: list[float] = (), every: float | None = None):
        super().__init__(boundaries, every)
        self.text, self.start, self.end, self.here = "", None, 0.0, 0

    def close(self) -> None:
        if self.start is not None:
            clean = self.text.strip()
            clean = "".join(x for i, x in enumerate(clean) if not (x == " " and tk.is_dense(clean[i - 1]) and tk.is_dense(clean[i + 1])))
            self.give(clean, self.start, self.end)
        self.text, self.start = "", None

    def add(self, shown: str, first: float | None, last: float | None) -> None:
        if first is None:
            self.text += shown
            return
        there = self.side((first + last) / 2)
        if self.start is not None and (first - self.end > GAP or last - first >= LONG_RUN or there != self.here or last - self.start >= HARD):
            self.close()
        self.here, self.start, self.end = there, first if self.start is None else self.start, last
        self.text += shown
        safe = self.text[-1:].isspace() or self.text[-1:] in tuple(SENTENCE_ENDERS + CLAUSE_ENDERS)
        if shown.strip()[-1:] in tuple(SENTENCE_ENDERS) or (self.end - self.start >= SOFT and safe) or self.end - self.start >= HARD:
            self.close()


class WordPieces(_Grouping):
    """Pieces of timed words: closed before a gap of 0.5 s, the other side of a boundary or 7 s; after a sentence's end,
    or after 5 s at a clause's end."""

    def __init__(self, boundaries: list[float] = (), every: float | None = None):
        super().__init__(boundaries, every)
        self.held: list[Piece] = []
        self.here = 0

    def close(self) -> None:
        if self.held:
            self.give(tk.join([w for w, _, _ in self.held]).strip(), self.held[0][1], self.held[-1][2])
            self.held = []

    def add(self, word: str, first: float, last: float) -> None:
        there = self.side((first + last) / 2)
        if self.held and (first - self.held[-1][2] >= GAP or there != self.here):
            self.close()
        if self.held and last - self.held[0][1] >= HARD:
            self.close()
        self.here = there
        self.held.append((word, first, last))
        if word[-1:] in tuple(SENTENCE_ENDERS) or (last - self.held[0][1] >= SOFT and word[-1:] in tuple(CLAUSE_ENDERS)):
            self.close()


def group_tokens(tokens: list[Piece]) -> list[Piece]:
    return TokenPieces().over(tokens)


def group_runs(runs: list[tuple[str, float | None, float | None]], boundaries: list[float] = ()) -> list[Piece]:
    return RunPieces(boundaries).over(runs)


def group_words(words: list[Piece], boundaries: list[float] = ()) -> list[Piece]:
    return WordPieces(boundaries).over(words)


def punctuate(words: list[tuple[str, float, float]], text: str, reach: int = 40) -> list[tuple[str, float, float]]:
    """Timed words with the signs that stand beside them in the full text, which is followed from word to word; a word
    that is not next is looked for within `reach` characters, and stays bare if it is not there."""
    at, out = 0, []

    def match(word: str, i: int) -> int | None:
        for c in word:
            while i < len(text) and text[i].isspace():
                i += 1
            if i >= len(text) or text[i].lower() != c.lower():
                return None
            i += 1
        return i

    for word, first, last in words:
        bare = "".join(word.split())
        if not bare:
            continue
        i = at
        while i < len(text) and (text[i].isspace() or _mark(text[i])):
            i += 1
        leading, end = "".join(text[at:i].split()), match(bare, i)
        if end is None:
            leading, end = "", next((e for j in range(at, min(len(text), at + reach)) if (e := match(bare, j)) is not None), None)
        if end is not None:
            at = end
            while at < len(text) and _mark(text[at]) and text[at] not in OPENING:
                at += 1
            bare = leading + bare + text[end:at]
        out.append((bare, first, max(last, first)))
    return out
