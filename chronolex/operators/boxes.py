"""Lines of text in a picture: boxes (text, x, y, w, h) in shares of the picture, grouped to rows and sifted."""

from __future__ import annotations

import re
from functools import lru_cache

from chronolex.functions import tokens as tk
from chronolex.functions.text import ACCEPTED, SCRIPTS

CENTRE, TOLERANCE, HEIGHT = 0.5, 0.05, 0.5
Box = tuple[str, float, float, float, float]


def rows(boxes: list[Box]) -> list[list[Box]]:
    """Boxes of about one height at one height of the picture, from top to bottom, each row from left to right."""
    out: list[list[Box]] = []
    middle = lambda b: b[2] + b[4] / 2
    for b in sorted(boxes, key=middle):
        if out:
            tallest, mean = max(x[4] for x in out[-1]), sum(map(middle, out[-1])) / len(out[-1])
            low, high = sorted((tallest, b[4]))
            if low >= 0.6 * high and abs(middle(b) - mean) < low / 2:
                out[-1].append(b)
                continue
        out.append([b])
    return [sorted(r, key=lambda b: b[1]) for r in out]


def centred(row: list[Box], centre: float = CENTRE, tolerance: float = TOLERANCE) -> list[Box]:
    """What is left of a row when the end that lies farther from the centre goes, until the rest lies in the centre."""
    row = list(row)
    mid = lambda b: b[1] + b[3] / 2
    while row:
        low, high = min(b[1] for b in row), max(b[1] + b[3] for b in row)
        if abs((low + high) / 2 - centre) <= tolerance:
            break
        row.pop(0 if abs(mid(row[0]) - centre) >= abs(mid(row[-1]) - centre) else -1)
    return row


@lru_cache
def _of_scripts(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(f"[{''.join(SCRIPTS[n] for n in names)}]")


def is_written(text: str, language: str) -> bool:
    """Whether more letters of known scripts are of the language's scripts than not."""
    own = ACCEPTED.get(language, ("latin",))
    if text.isascii():
        return "latin" in own and any(map(str.isalpha, text))
    letters = "".join(x for x in text if x.isalpha())
    count = lambda names: len(_of_scripts(names).findall(letters))
    return 2 * count(own) > count(tuple(SCRIPTS))


def kept(boxes: list[Box], language: str, *, left: float = 0.0, width: float = 1.0) -> tuple[str, bool]:
    """(text, other): the text of the rows in the language's script that are at least half as tall as the tallest, and
    whether there are rows in another script. Boxes are in shares of an area; rows are centred if it holds the centre."""
    centre = (CENTRE - left) / width
    found = [centred(r, centre, TOLERANCE / width) if 0 <= centre <= 1 else r for r in rows(boxes)]
    lines = [(tk.join([b[0].strip() for b in r]), max(b[4] for b in r)) for r in found if r]
    own = [is_written(t, language) for t, _ in lines]
    written = [x for x, mine in zip(lines, own, strict=True) if mine]
    tallest = max((h for _, h in written), default=0.0)
    other = any(not mine and any(map(str.isalpha, t)) for (t, _), mine in zip(lines, own, strict=True))
    return tk.join([t for t, h in written if h >= HEIGHT * tallest]), other
