"""Tokens of texts in plain Python, for folds; the column forms are in text.py."""

from __future__ import annotations

import re

from chronolex.functions.text import DENSE

_DENSE = re.compile(f"[{DENSE}]")
_TOKEN = re.compile(rf"[{DENSE}]|[^\s{DENSE}]+")


def is_dense(char: str) -> bool:
    return bool(_DENSE.match(char))


def dense_char(char: str) -> bool:
    """A letter of a script that is written without spaces."""
    return char.isalpha() and is_dense(char)


def dense_letter(text: str) -> bool:
    return not text.isascii() and any(x.isalpha() for x in _DENSE.findall(text))


def split(text: str) -> list[str]:
    if not dense_letter(text):
        return [x for x in text.split(" ") if x]
    return [x for x in _TOKEN.findall(text) if not x.isspace()]


def join(tokens: list[str]) -> str:
    if not any(map(dense_letter, tokens)):
        return " ".join(tokens)
    out = ""
    for x in tokens:
        tight = not out or not x or out[-1].isspace() or x[0].isspace() or is_dense(out[-1]) or is_dense(x[0])
        out += x if tight else f" {x}"
    return out


def plain(word: str) -> str:
    return "".join(x for x in word.lower() if x.isalnum())


def has_content(text: str) -> bool:
    return any(x.isalnum() for x in text)
