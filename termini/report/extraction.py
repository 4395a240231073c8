"""The text report of an extraction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buckets that the report counts, in its order.
BUCKETS = ("unmapped", "secondary", "no_clip", "quality", "min_anchor", "max_break", "min_clip", "motifs", "unknown_contig", "malformed")


def tally(rows: DataFrame, contigs: DataFrame) -> tuple[int, int, list[str], int]:
    """Left and right overhangs, the contigs without any, and the number of contigs."""
    n = rows.agg(F.count_if(F.col("end") == "L").alias("left"), F.count_if(F.col("end") == "R").alias("right")).first()
    bare = contigs.join(rows.select("contig").distinct(), "contig", "left_anti").orderBy("contig").collect()
    return n.left, n.right, [r.contig for r in bare], contigs.count()


def render(lines: int, buckets: Mapping[str, int], left: int, right: int, bare: list[str], contigs: int) -> str:
    dropped = {b: buckets.get(b, 0) for b in BUCKETS if buckets.get(b)}
    out = ["Extraction Statistics Report", "=" * 40, f"Total SAM lines processed: {lines:,}", f"Ends passed to the writer: {left + right:,}", f"Total filtered: {sum(dropped.values()):,}"]
    if dropped:
        out += ["", "Filtering breakdown:", *[f"  {b}: {n:,} ({100 * n / lines if lines else 0:.1f}%)" for b, n in dropped.items()]]
    if contigs:
        out += ["", "Contig Analysis:", f"Total reference contigs: {contigs:,}", f"Contigs with overhangs: {contigs - len(bare):,}", f"Contigs with zero overhangs: {len(bare):,}"]
        out += [f"Zero-overhang contigs: {', '.join(bare)}"] if bare else []
    return "\n".join([*out, "", f"Total alignments processed: {left + right:,}", f"Left overhangs: {left:,}", f"Right overhangs: {right:,}"]) + "\n"
