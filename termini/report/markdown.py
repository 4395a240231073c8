"""The statistics report of an extension as Markdown; sections without rows are left out."""

from __future__ import annotations

from .facts import Facts
from .words import decimal, delta, integer, pairs, table

SIDES = {"L": "left", "R": "right"}


def sides_extended(left: int, right: int) -> str:
    return {(True, True): "both", (True, False): "left", (False, True): "right"}.get((left > 0, right > 0), "no")


def motif_rows(f: Facts) -> list[list[str]]:
    return [[m.contig, SIDES[m.end], m.motif, integer(m.window), integer(m.pre), integer(m.post), delta(m.gain)] for m in f.motifs if m.contig in f.extensions]


def summary(f: Facts) -> list[tuple[str, str]]:
    gained, trimmed = f.gained(), f.trimmed()
    rows = [
        ("Mode", "dry run (no sequences written)" if f.dry_run else "extension applied"),
        ("Contigs in assembly", integer(len(f.contigs))),
        ("Contigs with overhang support", integer(len(f.supported))),
        ("Contigs extended", integer(len(f.extensions))),
        ("Contig ends extended", f"{integer(f.ends_extended())} of {integer(2 * len(f.contigs))}"),
        ("Net bases gained", integer(gained)),
        ("Bases trimmed back", integer(trimmed)),
        ("Raw overhang bases grafted", integer(gained + trimmed)),
    ]
    if f.motifs:
        rows.append(("Motifs counted", ", ".join(sorted({m.motif for m in f.motifs}))))
        rows.append(("Total motif gain", delta(sum(m.gain for m in f.motifs if m.contig in f.extensions))))
    if f.window:
        rows.append(("Terminal screening window", f"{integer(f.window)} bp"))
    return [*rows, ("Contigs excluded", integer(len(f.excluded))), ("Warnings", integer(len(f.warnings)))]


def extension_rows(f: Facts) -> list[list[str]]:
    out = []
    for name, e in sorted(f.extensions.items()):
        reads = [(read or "-") if gain else "-" for read, gain in ((e.left_read, e.left_gain), (e.right_read, e.right_gain))]
        sizes = [integer(e.original_length), integer(e.final_length)]
        out.append([name, *sizes, *map(delta, (e.left_gain, e.right_gain, e.left_gain + e.right_gain)), *reads, integer(e.left_trim), integer(e.right_trim)])
    return out


def length_rows(f: Facts) -> list[list[str]]:
    named = (("Left", "L"), ("Right", "R"), ("Combined", "both"))
    return [[name, integer(o.n), decimal(o.mean), decimal(o.median), decimal(o.sd), integer(o.least), integer(o.most)] for name, end in named if (o := f.overall.get(end))]


def support_rows(f: Facts) -> list[list[str]]:
    out = []
    for c in f.supported:
        e = f.extensions.get(c.contig)
        out.append([c.contig, *map(integer, (c.contig_length, c.left_count, c.right_count, c.left_max, c.right_max)), sides_extended(e.left_gain, e.right_gain) if e else "no"])
    return out


def flag_rows(f: Facts) -> list[list[str]]:
    """Depth flags only, left before right."""
    return [[r.contig, r.measure.split("_")[0], integer(int(r.value))] for r in f.flags if r.measure.endswith("_count")]


EXTENSIONS = ["Contig", "Original bp", "Final bp", "Left +bp", "Right +bp", "Total +bp", "Left read", "Right read", "Left trim", "Right trim"]
LENGTHS = ["Set", "N", "Mean", "Median", "SD", "Min", "Max"]
SUPPORT = ["Contig", "Length", "Left reads", "Right reads", "Longest left", "Longest right", "Extended"]
MOTIFS = ["Contig", "End", "Motif", "Window bp", "Pre", "Post", "Gain"]


def render(f: Facts) -> str:
    total = delta(sum(m.gain for m in f.motifs if m.contig in f.extensions))
    parts = [
        ("Summary", pairs(summary(f)), ""),
        ("Extensions That Would Be Applied" if f.dry_run else "Extensions Applied", table(EXTENSIONS, extension_rows(f), "lrrrrrllrr"), "Gains are net of the contig bases trimmed away."),
        ("Telomere Motif Analysis", table(MOTIFS, motif_rows(f), "lllrrrr"), f"Before: the window at the contig end. After: that window and the bases added there. Total gain: {total}."),
        ("Overhang Length Statistics", table(LENGTHS, length_rows(f), "lrrrrrr"), ""),
        ("Per-Contig Overhang Support", table(SUPPORT, support_rows(f), "lrrrrrl"), "Reads that passed the filters at each end."),
        ("Excluded Contigs", table(["Contig", "Reason"], [[c, "user exclusion list"] for c in f.excluded]), ""),
        ("Contigs With Anomalous Overhang Coverage", table(["Contig", "End", "Overhang reads"], flag_rows(f), "llr"), "Far more reads than at other ends: perhaps a collapsed repeat. These contigs were not excluded."),
        ("Warnings", "\n".join(f"- {w}" for w in f.warnings), ""),
    ]
    out = ["# Contig extension report" + (" (dry run)" if f.dry_run else "")]
    for title, body, note in parts:
        if body:
            out += [f"## {title}", *([note] if note else []), body]
    if f.extensions and not f.dry_run:
        out.append("Extended contigs should be polished before further use.")
    return "\n\n".join(out) + "\n"
