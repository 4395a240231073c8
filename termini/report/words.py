"""Numbers, Markdown tables and bars as text."""

from __future__ import annotations

from collections.abc import Sequence

# Separator cells of a Markdown table.
MARKS = {"l": ":--", "r": "--:", "c": ":-:"}
PAD = {"l": str.ljust, "r": str.rjust, "c": str.center}


def integer(n: int) -> str:
    return f"{n:,}"


def delta(n: int, zero: str = "-") -> str:
    return f"{n:+,}" if n else zero


def decimal(x: float, places: int = 1) -> str:
    return f"{x:,.{places}f}"


def table(head: Sequence[str], rows: Sequence[Sequence[str]], align: str = "") -> str:
    """A padded table, one letter of align (l, r, c) a column; no rows give no text."""
    align = align or "l" * len(head)
    if len(align) != len(head) or set(align) - set(MARKS):
        raise ValueError(f"align {align!r} does not fit {len(head)} columns")
    if wrong := [r for r in rows if len(r) != len(head)]:
        raise ValueError(f"{wrong[0]!r} does not have {len(head)} cells")
    if not rows:
        return ""
    body = [[str(c) for c in r] for r in (head, *rows)]
    wide = [max(3, *(len(r[k]) for r in body)) for k in range(len(head))]
    rule = [MARKS[a][0] + "-" * (w - 2) + MARKS[a][-1] for a, w in zip(align, wide, strict=True)]
    lines = [[PAD[a](c, w) for a, c, w in zip(align, r, wide, strict=True)] for r in body]
    return "\n".join("| " + " | ".join(r) + " |" for r in (lines[0], rule, *lines[1:]))


def pairs(items: Sequence[tuple[str, str]], key: str = "Metric") -> str:
    return table([key, "Value"], items, "lr")


def bars(bins: Sequence[tuple[int, int, int]], width: int = 24) -> str:
    """(first, last, n) of each bin as a horizontal bar; the longest has `width` marks."""
    if not bins:
        return ""
    most = max(n for *_, n in bins) or 1
    names = [f"{a}-{b}" if a != b else str(a) for a, b, _ in bins]
    room = max(map(len, names))
    return "\n".join(f"  {name:>{room}} | {'#' * round(width * n / most):<{width}} {n:>{len(str(most))}}" for name, (*_, n) in zip(names, bins, strict=True))
