"""What a report tells, gathered from DataFrames: rows for contigs and contig ends, and for the few reads it draws.

Aggregation is Spark's; a report lists every contig, so the rows of an assembly's contigs are what the driver holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import extend as X
from ..operators import stats as S
from . import layout


@dataclass
class Facts:
    contigs: list[Row]  # contig_stats, all contigs
    extensions: dict[str, Row]  # X.gains() of extended contigs
    overall: dict[str, Row]
    quantiles: dict[tuple[str, str], Row]
    profiles: dict[tuple[str, str], list[float]]
    flags: list[Row]
    motifs: list[Row] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    dry_run: bool = False
    window: int = 0
    least: int = 1

    @property
    def supported(self) -> list[Row]:
        return sorted((c for c in self.contigs if max(c.left_count, c.right_count) >= self.least), key=lambda c: c.contig)

    def ends_extended(self) -> int:
        return sum((e.left_gain > 0) + (e.right_gain > 0) for e in self.extensions.values())

    def gained(self) -> int:
        return sum(e.left_gain + e.right_gain for e in self.extensions.values())

    def trimmed(self) -> int:
        return sum(e.left_trim + e.right_trim for e in self.extensions.values())


def gather(overhangs: DataFrame, contigs: DataFrame, gains: DataFrame, least: int = 1, threshold: float = 3.5, motifs: DataFrame | None = None, **more: object) -> Facts:
    """least: reads that one end needs for its contig to count as supported, which is the population of the flags."""
    stats = S.contig_stats(overhangs, contigs)
    profiles: dict[tuple[str, str], list[float]] = {}
    for r in S.density(overhangs).orderBy("contig", "end", "bin").collect():
        profiles.setdefault((r.contig, r.end), []).append(r.density)
    return Facts(
        contigs=stats.orderBy("contig_ord").collect(),
        extensions={r.contig: r for r in gains.where("status <> 'no'").collect()},
        overall={r.end: r for r in S.overall(overhangs).collect()},
        quantiles={(r.contig, r.end): r for r in S.quantiles(overhangs).collect()},
        profiles=profiles,
        flags=S.anomalies(S.supported(stats, least), threshold).orderBy("measure", F.desc("z"), "contig").collect(),
        motifs=motifs.orderBy("contig", "end", "motif").collect() if motifs is not None else [],
        least=least,
        **more,  # type: ignore[arg-type]
    )


@dataclass
class Panel:
    contig: str
    end: str
    columns: list[tuple[int, int]]
    reads: list[tuple[Row, dict[tuple[int, int], tuple[str, str]]]]  # read, its bases: column -> (base, kind)
    reference: str = ""  # the contig's bases at this end


def panels(overhangs: DataFrame, most_reads: int = 25, sequences: DataFrame | None = None) -> list[Panel]:
    """A panel for each contig end with reads: at most most_reads of them, which is what the report shows, and of the contig's
    sequence no more than a pile's widest window."""
    top = X.top_reads(overhangs, most_reads)
    placed = layout.cells(top)
    shared: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for r in layout.columns(placed).orderBy("contig", "end", "off", "ins").collect():
        shared.setdefault((r.contig, r.end), []).append((r.off, r.ins))
    bases: dict[tuple, dict[tuple[int, int], tuple[str, str]]] = {}
    lists = placed.groupBy("contig", "end", "qname", "pos").agg(F.collect_list(F.struct("off", "ins", "base", "kind")).alias("cells"))
    for r in lists.toLocalIterator():
        bases[r.contig, r.end, r.qname, r.pos] = {(c.off, c.ins): (c.base, c.kind) for c in r.cells}
    out: dict[tuple[str, str], Panel] = {}
    for r in top.orderBy("contig_ord", "end", "place").drop("seq").collect():
        panel = out.setdefault((r.contig, r.end), Panel(r.contig, r.end, shared.get((r.contig, r.end), []), []))
        panel.reads.append((r, bases.get((r.contig, r.end, r.qname, r.pos), {})))
    if sequences is not None:
        w = F.lit(layout.MOST_WINDOW)
        known = sequences.join(top.select("contig").distinct(), "contig").select("contig", F.left("seq", w).alias("L"), F.right("seq", w).alias("R"))
        for r in known.toLocalIterator():
            for end in "LR":
                if (r.contig, end) in out:
                    out[r.contig, end].reference = r[end]
    return list(out.values())
