"""The extension report as one HTML file without outside parts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import escape

from . import charts, markdown
from .facts import Facts, Panel
from .layout import reference_row, terminus, ticks

STYLE = """body{font:15px/1.5 system-ui,sans-serif;max-width:1000px;margin:2em auto;padding:0 1em;color:#222}
table{border-collapse:collapse;margin:1em 0}td,th{padding:.2em .7em;border-bottom:1px solid #ddd;text-align:left}td.n,th.n{text-align:right}
svg{width:100%;height:auto;font-size:11px}.pile{overflow-x:auto;font:12px/1.35 ui-monospace,monospace;white-space:pre}
.clip{background:#fde7c7}.anchor{color:#666}.motif{background:#bfe3c0;font-weight:bold}.rule{color:#999}.reference{color:#246}.edge{display:inline-block;width:0;color:#c33}.used{font-weight:bold}"""
NUMBER = re.compile(r"[+–-]?[\d,.]*%?( bp)?")
LENGTHS = ["Contig", "End", "Reads", "Q1", "Median", "Q3", "Longest", "Best gain"]


def table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """A table whose numbers stand on the right; no change is a dash."""
    if not rows:
        return ""
    right = [all(NUMBER.fullmatch(r[k]) for r in rows) for k in range(len(head))]
    cell = lambda tag, k, v: f"<{tag}{' class=n' if right[k] else ''}>{'–' if v == '-' else escape(v)}</{tag}>"
    line = lambda tag, r: "<tr>" + "".join(cell(tag, k, v) for k, v in enumerate(r)) + "</tr>"
    return f"<table>{line('th', head)}{''.join(line('td', r) for r in rows)}</table>"


def runs(panel: Panel, bases: dict, motif: re.Pattern | None) -> str:
    """One read as spans of equal kind; motifs in the clip are marked, also across columns that are empty in this read."""
    kept = [(k, *bases[c]) for k, c in enumerate(panel.columns) if c in bases]
    if not kept:
        return ""
    kinds = ["gap"] * len(panel.columns)
    letters = [" "] * len(panel.columns)
    for k in range(kept[0][0], kept[-1][0] + 1):
        letters[k] = "·"
    for k, base, kind in kept:
        kinds[k], letters[k] = kind, base
    clip = [k for k, _, kind in kept if kind == "clip"]
    if motif:
        for hit in motif.finditer("".join(letters[k] for k in clip)):
            for k in clip[hit.start() : hit.end()]:
                kinds[k] = "motif"
    out, begin = [], 0
    for k in range(1, len(kinds) + 1):
        if k == len(kinds) or kinds[k] != kinds[begin]:
            words = escape("".join(letters[begin:k]))
            out.append(words if kinds[begin] == "gap" else f'<span class="{kinds[begin]}">{words}</span>')
            begin = k
    return "".join(out).rstrip()


def ruler(panel: Panel) -> str:
    line = [" "] * (len(panel.columns) + 8)
    free = 0
    for k, label in ticks(panel.columns):
        if k >= free:
            line[k : k + len(label)] = label
            free = k + len(label) + 1
    return "".join(line).rstrip()


def pile(panel: Panel, used: str | None, patterns: Sequence[str]) -> str:
    motif = re.compile("|".join(sorted(patterns, key=len, reverse=True)), re.IGNORECASE) if patterns else None
    lines = [f'<span class="rule">{ruler(panel)}</span>']
    if panel.reference:
        row, at = reference_row(panel.reference, panel.end, panel.columns), terminus(panel.end, panel.columns)
        edge = '<span class="edge">|</span>'  # takes no width
        lines.append(f'<span class="reference">{escape(row[:at])}{edge}{escape(row[at:].rstrip())}</span>  <span class="rule">{escape(panel.contig)}</span>')
    for read, bases in panel.reads:
        name = escape(f"{read.qname}  clip {read.clip_length:,}  gain {read.net_gain:+,}  mapq {read.mapq}")
        lines.append(f"{runs(panel, bases, motif)}  <span class=\"{'used' if read.qname == used else 'rule'}\">{name}</span>")
    return f"<h3>{escape(panel.contig)}, {charts.WORDS[panel.end]} end</h3><div class=pile>" + "\n".join(lines) + "</div>"


def render(f: Facts, panels: Sequence[Panel], patterns: Sequence[str] = ()) -> str:
    """patterns: motifs that are marked in the clips."""
    flags = [[r.contig, charts.flag_words(r.measure, r.z)] for r in f.flags]
    used = lambda p: getattr(f.extensions.get(p.contig), "left_read" if p.end == "L" else "right_read", None)
    parts = [
        ("Summary", table(["Metric", "Value"], markdown.summary(f))),
        ("Extensions", table(markdown.EXTENSIONS, markdown.extension_rows(f))),
        ("Motifs", table(markdown.MOTIFS, markdown.motif_rows(f))),
        ("Reads at contig ends", charts.depth_strip(f) + table(markdown.SUPPORT, markdown.support_rows(f))),
        ("Overhang lengths", charts.length_profiles(f) + charts.depth_by_length(f) + table(LENGTHS, charts.quantile_rows(f)) + table(markdown.LENGTHS, markdown.length_rows(f))),
        ("Unusual contig ends", table(["Contig", "Finding"], flags)),
        ("Excluded contigs", table(["Contig"], [[c] for c in f.excluded])),
        ("Warnings", "".join(f"<p>{escape(w)}</p>" for w in f.warnings)),
        ("Reads", "".join(pile(p, used(p), patterns) for p in panels)),
    ]
    title = "Contig extension report" + (" (dry run)" if f.dry_run else "")
    body = "".join(f"<section><h2>{name}</h2>{part}</section>" for name, part in parts if part)
    return f'<!doctype html><html lang=en><meta charset=utf-8><title>{title}</title><style>{STYLE}</style><h1>{title}</h1>{body}</html>\n'
