"""Charts as SVG text; each has a table beside it that says the same."""

from __future__ import annotations

from html import escape

from .facts import Facts

WIDTH, ROW, LABEL = 760, 18, 150
INK = {"L": "#2f6f9f", "R": "#b5622d"}
WORDS = {"L": "left", "R": "right"}


def _text(x: float, y: float, words: str, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(words)}</text>'


def _svg(height: float, title: str, parts: list[str]) -> str:
    return f'<svg viewBox="0 0 {WIDTH} {height:.0f}" role="img" aria-label="{escape(title)}"><title>{escape(title)}</title>{"".join(parts)}</svg>'


def depth_strip(f: Facts) -> str:
    """A dot for each contig end by its number of reads; flagged ends are ringed, and each contig's deepest one is named."""
    points = [(c.contig, e, n) for c in f.supported for e, n in (("L", c.left_count), ("R", c.right_count))]
    if not points:
        return ""
    most = max(n for *_, n in points) or 1
    flagged = {(r.contig, r.measure[0].upper()) for r in f.flags if r.measure.endswith("_count")}
    deepest: dict[str, tuple] = {}
    for p in points:
        if p[:2] in flagged and (p[0] not in deepest or p[2] > deepest[p[0]][2]):
            deepest[p[0]] = p
    lane = {"L": 30, "R": 70}
    at = lambda n: LABEL + (WIDTH - LABEL - 40) * n / most
    parts = [_text(8, y + 4, f"{WORDS[e]} ends") for e, y in lane.items()]
    parts += [f'<circle cx="{at(n):.1f}" cy="{lane[e]}" r="4" fill="{INK[e]}" fill-opacity=".5"{" stroke=\'#c00\' stroke-width=\'2\'" if (c, e) in flagged else ""}><title>{escape(c)} {WORDS[e]}: {n:,}</title></circle>' for c, e, n in points]
    for x, y, name in stacked([(at(n), lane[e], c) for c, e, n in deepest.values()]):
        parts.append(_text(x, y, name, "middle"))
    parts += [_text(LABEL, 105, "0", "middle"), _text(at(most), 105, f"{most:,}", "middle")]
    return _svg(112, "Reads at each contig end", parts)


def stacked(labels: list[tuple[float, float, str]], letter: float = 6.5, lift: float = 11) -> list[tuple[float, float, str]]:
    """Labels above their points, moved up until none lies on another."""
    placed: list[tuple[float, float, str]] = []
    for x, y, name in sorted(labels):
        y -= 8
        half = letter * len(name) / 2
        while any(abs(y - b) < lift and abs(x - a) < half + letter * len(other) / 2 for a, b, other in placed):
            y -= lift
        placed.append((x, y, name))
    return placed


def length_profiles(f: Facts) -> str:
    """Each contig end's clip lengths: a mirrored profile up to the 99 % quantile, quartile bar and median tick; ends with
    few reads have no profile."""
    ends = [(c.contig, e) for c in f.supported for e in "LR" if (c.contig, e) in f.quantiles]
    if not ends:
        return ""
    most = max(f.quantiles[k].longest for k in ends) or 1
    at = lambda v: LABEL + (WIDTH - LABEL - 40) * v / most
    parts = []
    for row, (contig, e) in enumerate(ends):
        q, y = f.quantiles[contig, e], ROW * (row + 1)
        parts.append(_text(8, y + 4, f"{contig} {WORDS[e]}"))
        if shape := f.profiles.get((contig, e)):
            xs = [at(q.p99 * (k + 0.5) / len(shape)) for k in range(len(shape))]
            up, down = ([f"{x:.1f},{y + s * 7 * d:.1f}" for x, d in zip(xs, shape, strict=True)] for s in (-1, 1))
            parts.append(f'<polygon points="{" ".join([*up, *down[::-1]])}" fill="{INK[e]}" fill-opacity=".35"/>')
        parts.append(f'<line x1="{at(q.q1):.1f}" x2="{at(q.q3):.1f}" y1="{y}" y2="{y}" stroke="{INK[e]}" stroke-width="3"/><line x1="{at(q.q2):.1f}" x2="{at(q.q2):.1f}" y1="{y - 5}" y2="{y + 5}" stroke="#111"/>')
    parts.append(_text(at(most), ROW * (len(ends) + 1.5), f"{most:,} bp", "end"))
    return _svg(ROW * (len(ends) + 2), "Overhang lengths at each contig end", parts)


def depth_by_length(f: Facts) -> str:
    """A dot for each contig end: its reads across, its median clip length up."""
    ends = [(k, f.quantiles[k]) for c in f.supported for e in "LR" if (k := (c.contig, e)) in f.quantiles]
    if not ends:
        return ""
    deep, long = max(q.depth for _, q in ends) or 1, max(q.q2 for _, q in ends) or 1
    parts = ['<path d="M60 10V210H740" fill="none" stroke="#888"/>', _text(740, 228, f"{deep:,} reads", "end"), _text(56, 20, f"{long:,.0f} bp", "end")]
    parts += [f'<circle cx="{60 + 680 * q.depth / deep:.1f}" cy="{210 - 200 * q.q2 / long:.1f}" r="4" fill="{INK[e]}" fill-opacity=".55"><title>{escape(c)} {WORDS[e]}: {q.depth:,} reads, median {q.q2:,.1f} bp</title></circle>' for (c, e), q in ends]
    return _svg(236, "Reads against median overhang length", parts)


def quantile_rows(f: Facts) -> list[list[str]]:
    return [[c.contig, WORDS[e], f"{q.depth:,}", *[f"{v:,.1f}" for v in (q.q1, q.q2, q.q3)], f"{q.longest:,}", f"{q.best_gain:+,}"] for c in f.supported for e in "LR" if (q := f.quantiles.get((c.contig, e)))]


def flag_words(measure: str, z: float) -> str:
    side, kind = measure.split("_")
    return f"{side}: {'more reads' if kind == 'count' else 'longer overhangs'} than other ends (score {z:.1f})"
