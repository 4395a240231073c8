"""Cutting a text where byte-level BPE cannot reach across, so that encodings of the pieces can be kept and joined.

The pre-tokenizer's pattern never joins a white-space run to what stands before it: every run begins a new match, whatever
is on its left. A text may thus be cut before each run (here: before each run that begins with a space or a line feed),
and the parts be encoded alone."""

from __future__ import annotations

import re

_RISK = re.compile(r"\s[ \n]|\x00")
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\0"]  # no white space lies beyond
_RUN = re.compile(r"(?<=\S)(?=[ \n])")


def chunks(text: str) -> list[str]:
    """Parts that spell text and encode as they do inside it."""
    if not text:
        return []
    runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    if runs or (any(map(text.__contains__, _RARE)) and _RISK.search(text)):  # runs of several characters: cut only where one begins
        return _RUN.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").removeprefix("\0").split("\0")
