"""Reads placed base by base around a contig end, as expressions: one row for each base that a report draws.

Offset 0 is the contig's end base. Inserted bases have ins 1, 2, ... after the offset they follow; deleted bases have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cigar as C
from ..operators.extend import END

WINDOW, MOST_WINDOW, MOST_CLIP, TICK = 500, 2000, 300, 20
SEGMENT = "array<struct<op:string,n:bigint,read:bigint,ref:bigint>>"


def segments(cigar: Column, pos: Column) -> Column:
    """The CIGAR's operations, each with the read index (from 0) and the reference position where it begins."""
    step = lambda x, codes: F.when(x["op"].isin(*codes), x["n"]).otherwise(0)
    start = F.struct(F.lit(0).cast("long").alias("read"), pos.cast("long").alias("ref"), F.array().cast(SEGMENT).alias("out"))

    def walk(acc: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["read"].alias("read"), acc["ref"].alias("ref"))
        return F.struct((acc["read"] + step(x, "MIS=X")).alias("read"), (acc["ref"] + step(x, C.SPAN_OPS)).alias("ref"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(C.operations(cigar), start, walk, lambda acc: acc["out"])


RUN = "array<struct<kind:string,inserted:boolean,off:bigint,n:bigint,idx:bigint>>"


def drawn(least: int = WINDOW, most: int = MOST_WINDOW) -> Column:
    """How many reference bases are drawn at each contig end: at least `least` or the longest anchor of the reads that are
    drawn, at most `most` or the contig."""
    end = W.partitionBy(*END)
    return F.greatest(F.lit(1), F.least(F.max("contig_length").over(end), F.lit(most), F.greatest(F.lit(least), F.max("anchor").over(end)))).cast("long")


def cells(overhangs: DataFrame, least: int = WINDOW, most: int = MOST_WINDOW, most_clip: int = MOST_CLIP) -> DataFrame:
    """contig, end, qname, pos, off, ins, base, kind (anchor or clip) of every base in the window, for the reads that a report
    draws. A read becomes its runs of bases, cut to the window, and these are taken apart, so a long read costs no more than
    a short one and reads are read once. Reads without a sequence have no rows."""
    used = [*END, "qname", "pos", "aln_end", "contig_length", "cigar", "seq", "clip_seq"]
    rows = overhangs.where(F.length("seq") > 0).select(*used, "anchor").withColumn("drawn", drawn(least, most))
    left = F.col("end") == "L"
    rows = rows.withColumn("origin", F.when(left, F.lit(1).cast("long")).otherwise(F.col("contig_length")))
    rows = rows.withColumns({"lo": F.when(left, F.col("origin")).otherwise(F.col("origin") - F.col("drawn") + 1), "hi": F.when(left, F.col("origin") + F.col("drawn") - 1).otherwise(F.col("origin"))})
    rows = rows.withColumn("clip", F.when(left, F.right("clip_seq", F.lit(most_clip))).otherwise(F.left("clip_seq", F.lit(most_clip))))

    def run(kind: str, inserted: bool, off: Column, n: Column, idx: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(inserted).alias("inserted"), off.cast("long").alias("off"), n.cast("long").alias("n"), idx.cast("long").alias("idx"))

    def of(s: Column) -> Column:
        first, last = F.greatest(s["ref"], F.col("lo")), F.least(s["ref"] + s["n"] - 1, F.col("hi"))
        held = (s["op"] == "I") & (s["ref"] - 1).between(F.col("lo"), F.col("hi"))
        return F.when(s["op"].isin(*C.ANCHOR_OPS), run("anchor", False, first - F.col("origin"), last - first + 1, s["read"] + first - s["ref"])).when(held, run("anchor", True, s["ref"] - 1 - F.col("origin"), s["n"], s["read"]))

    begin = F.when(left, F.col("pos") - F.col("origin") - F.length("clip")).otherwise(F.col("aln_end") - F.col("origin") + 1)
    clipped = F.array(run("clip", False, begin, F.length("clip"), F.lit(0)))
    runs = F.concat(F.transform(segments(F.col("cigar"), F.col("pos")), of).cast(RUN), clipped.cast(RUN))
    parts = rows.select(*END, "qname", "pos", "seq", "clip", F.explode(F.filter(runs, lambda r: r["n"] > 0)).alias("r"))
    placed = parts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.n") - 1)))
    base = F.substring(F.when(F.col("r.kind") == "clip", F.col("clip")).otherwise(F.col("seq")), (F.col("r.idx") + F.col("k") + 1).cast("int"), 1)
    off = F.when(F.col("r.inserted"), F.col("r.off")).otherwise(F.col("r.off") + F.col("k"))
    return placed.select(*END, "qname", "pos", off.alias("off"), F.when(F.col("r.inserted"), F.col("k") + 1).otherwise(0).cast("int").alias("ins"), base.alias("base"), F.col("r.kind").alias("kind")).where("base <> ''")


def columns(placed: DataFrame) -> DataFrame:
    """The columns that all reads of a contig end share, in order: column, off, ins."""
    deepest = placed.groupBy(*END, "off").agg(F.max("ins").alias("deepest"))
    return deepest.select(*END, "off", F.explode(F.sequence(F.lit(0), F.col("deepest"))).alias("ins"))


def reference_row(sequence: str, end: str, shared: list[tuple[int, int]]) -> str:
    """The contig's bases under the shared columns; `sequence` is its part at this end. Columns outside the contig are blank,
    those of inserted bases a dash."""
    first = 0 if end == "L" else 1 - len(sequence)
    letters = []
    for off, ins in shared:
        k = off - first
        letters.append(" " if not 0 <= k < len(sequence) else "-" if ins else sequence[k])
    return "".join(letters)


def terminus(end: str, shared: list[tuple[int, int]]) -> int:
    """The column where the contig ends: its first base's on the left, the one behind its last base and what is inserted
    there on the right."""
    zero = [k for k, (off, _) in enumerate(shared) if off == 0]
    return 0 if not zero else zero[0] if end == "L" else zero[-1] + 1


def ticks(shared: list[tuple[int, int]], step: int = TICK) -> list[tuple[int, str]]:
    """(column, label) of the ruler: the reference offsets that step divides."""
    return [(k, f"{off:+d}" if off else "0") for k, (off, ins) in enumerate(shared) if not ins and off % step == 0]
