"""Alignments against contig ends: geometry, verdicts, buckets and overhang rows. One narrow stage after the contig look-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import motifs as M


BUCKETS = ("malformed", "unmapped", "secondary", "no_clip", "unknown_contig", "min_anchor", "max_break", "min_clip")


@dataclass(frozen=True)
class Limits:
    """The command-line defaults."""

    min_clip: int = 1
    max_break: int = 50
    min_anchor: int = 100
    min_mapq: int = 0
    keep_secondary: bool = False


def geometry(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """alignments (qname, flag, rname, pos, mapq, cigar, seq) with contig_length, contig_ord and the derived geometry.

    The contig index joins without a hint: Catalyst broadcasts it while it is small and sorts otherwise."""
    index = contigs.select(F.col("contig").alias("rname"), F.col("contig_length").cast("long"), "contig_ord")
    rows = alignments.join(index, "rname", "left")
    rows = rows.select("*", F.inline(C.measured(F.coalesce("cigar", F.lit("")))))
    rows = rows.withColumn("aln_end", F.col("pos") + F.col("span") - 1)
    return rows.withColumns({"gap_left": F.col("pos").cast("long") - 1, "gap_right": F.col("contig_length") - F.col("aln_end")})


def _reason(clip: Column, gap: Column, limits: Limits) -> Column:
    return F.when(clip <= 0, "no_clip").when(gap > limits.max_break, "max_break").when(clip - gap < limits.min_clip, "min_clip")


def _shape() -> Column:
    return F.col("cigar").contains("S") & ~F.col("cigar").contains("H")


def classify(alignments: DataFrame, contigs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """geometry() with left_reason and right_reason (null: accepted) and `bucket`, the filter's verdict on the row."""
    rows = geometry(alignments, contigs)
    rows = rows.withColumns({"left_reason": _reason(F.col("left_clip"), F.col("gap_left"), limits), "right_reason": _reason(F.col("right_clip"), F.col("gap_right"), limits)})
    either = lambda reason: (F.col("left_reason") == reason) | (F.col("right_reason") == reason)
    bucket = F.when(F.col("flag").bitwiseAND(4) != 0, "unmapped")
    if not limits.keep_secondary:
        bucket = bucket.when(F.col("flag").bitwiseAND(256) != 0, "secondary")
    bucket = (
        bucket.when(~_shape(), "no_clip")
        .when(F.col("contig_length").isNull(), "unknown_contig")
        .when(F.col("pos").isNull(), "malformed")
        .when(F.col("anchor") < limits.min_anchor, "min_anchor")
        .when(F.col("left_reason").isNull() | F.col("right_reason").isNull(), "kept")
        .when(either("max_break"), "max_break")
        .when(either("min_clip"), "min_clip")
        .otherwise("no_clip")
    )
    return rows.withColumn("bucket", bucket)


def left_seq() -> Column:
    return F.left(F.coalesce("seq", F.lit("")), F.col("left_clip").cast("int"))


def right_seq() -> Column:
    return F.right(F.coalesce("seq", F.lit("")), F.col("right_clip").cast("int"))


def motif_hit(patterns: dict[str, str], repeats: int = 1, anywhere: bool = False) -> Column:
    """The filter's motif predicate on a classified row: in an accepted clip, or anywhere in the read."""
    if anywhere:
        return M.present(F.col("seq"), patterns, repeats)
    left = F.col("left_reason").isNull() & M.present(left_seq(), patterns, repeats)
    return left | (F.col("right_reason").isNull() & M.present(right_seq(), patterns, repeats))


def filtered(classified: DataFrame, patterns: dict[str, str] | None = None, repeats: int = 1, anywhere: bool = False) -> DataFrame:
    """The rows that the filter passes on. What flag and shape say is asked again, since these two reach the scan."""
    kept = classified.where((F.col("flag").bitwiseAND(4) == 0) & _shape() & (F.col("bucket") == "kept"))
    return kept.where(motif_hit(patterns, repeats, anywhere)) if patterns else kept


def buckets(classified: DataFrame, patterns: dict[str, str] | None = None, repeats: int = 1, anywhere: bool = False) -> DataFrame:
    """bucket and n: the run counters; rows that only the motif predicate drops count as `motifs`."""
    bucket = F.col("bucket")
    if patterns:
        bucket = F.when((bucket == "kept") & ~motif_hit(patterns, repeats, anywhere), "motifs").otherwise(bucket)
    return classified.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def counters(classified: DataFrame, malformed: DataFrame | None = None, patterns: dict[str, str] | None = None, repeats: int = 1, anywhere: bool = False) -> DataFrame:
    """One row: processed, kept (before motifs), both (kept at both ends of a contig), output, motif (null without
    patterns), removed, and a counter for each bucket. malformed: lines that are no alignment, which count as processed."""
    is_kept = F.col("bucket") == "kept"
    passed = is_kept & motif_hit(patterns, repeats, anywhere) if patterns else is_kept
    each = [F.count_if(F.col("bucket") == name).alias(f"excluded_{name}") for name in BUCKETS]
    both = F.count_if(is_kept & F.col("left_reason").isNull() & F.col("right_reason").isNull())
    one = classified.agg(F.count("*").alias("n"), F.count_if(is_kept).alias("kept"), both.alias("both"), F.count_if(passed).alias("output"), *each)
    lines = malformed.agg(F.count("*").alias("lines")) if malformed is not None else classified.sparkSession.range(1).select(F.lit(0).cast("long").alias("lines"))
    one = one.crossJoin(lines)  # one row each
    known = [F.col(f"excluded_{name}") + (F.col("lines") if name == "malformed" else 0) for name in BUCKETS]
    return one.select(
        (F.col("n") + F.col("lines")).alias("processed"), "kept", "both", "output", (F.col("output") if patterns else F.lit(None).cast("long")).alias("motif"), (F.col("n") + F.col("lines") - F.col("output")).alias("removed"),
        *[c.alias(f"excluded_{name}") for c, name in zip(known, BUCKETS, strict=True)], (F.col("kept") - F.col("output")).alias("excluded_motifs"),
    )


def kept_ends(classified: DataFrame) -> DataFrame:
    """contig, left_kept, right_kept: the reads kept at each end, before motifs."""
    kept = filtered(classified)
    return kept.groupBy(F.col("rname").alias("contig")).agg(F.count_if(F.col("left_reason").isNull()).alias("left_kept"), F.count_if(F.col("right_reason").isNull()).alias("right_kept"))


def ends(classified: DataFrame) -> DataFrame:
    """Two rows for each alignment, one for each contig end, with its verdict."""
    side = lambda end, clip, gap, reason, seq: F.struct(F.lit(end).alias("end"), F.col(clip).alias("clip_length"), F.col(gap).alias("gap"), F.col(reason).alias("reason"), seq.alias("clip_seq"))
    both = F.array(side("L", "left_clip", "gap_left", "left_reason", left_seq()), side("R", "right_clip", "gap_right", "right_reason", right_seq()))
    kept = [c for c in classified.columns if c not in ("left_reason", "right_reason", "left_clip", "right_clip", "gap_left", "gap_right")]
    spans_both = (F.col("left_reason").isNull() & F.col("right_reason").isNull()).alias("spans_both_ends")
    rows = classified.select(*kept, spans_both, F.explode(both).alias("side")).select(*kept, "spans_both_ends", "side.*")
    return rows.withColumns({"net_gain": F.col("clip_length") - F.col("gap"), "trim": F.greatest(F.lit(0), F.col("gap"))}).withColumnRenamed("rname", "contig")


def extract_buckets(classified: DataFrame, limits: Limits, patterns: dict[str, str] | None = None) -> DataFrame:
    """The extract flavour: rows for unmapped, secondary, shape, quality and anchor; ends for max_break, min_clip, motifs;
    ends without a clip are not counted. `accepted` counts the ends written."""
    row = F.when(F.col("flag").bitwiseAND(4) != 0, "unmapped")
    if not limits.keep_secondary:
        row = row.when(F.col("flag").bitwiseAND(256) != 0, "secondary")
    row = row.when(~_shape(), "no_clip").when(F.col("mapq") < limits.min_mapq, "quality").when(F.col("contig_length").isNull(), "unknown_contig").when(F.col("anchor") < limits.min_anchor, "min_anchor")
    rows = classified.withColumn("row_bucket", row)
    by_row = rows.where("row_bucket is not null").select(F.col("row_bucket").alias("bucket"))
    end = F.coalesce("reason", F.lit("accepted"))
    if patterns:
        end = F.when((end == "accepted") & ~M.present(F.upper("clip_seq"), patterns), "motifs").otherwise(end)
    by_end = ends(rows.where("row_bucket is null")).select(end.alias("bucket")).where("bucket <> 'no_clip'")
    return by_row.unionByName(by_end).groupBy("bucket").agg(F.count("*").alias("n"))


def extracted(classified: DataFrame, limits: Limits, patterns: dict[str, str] | None = None) -> DataFrame:
    """The overhang rows that extract writes, a row for each accepted end."""
    drop = F.col("flag").bitwiseAND(4 if limits.keep_secondary else 260) != 0
    rows = ends(classified.where(~drop & _shape() & (F.col("mapq") >= limits.min_mapq) & F.col("contig_length").isNotNull() & (F.col("anchor") >= limits.min_anchor)))
    rows = rows.where("reason is null")
    return rows.where(M.present(F.upper("clip_seq"), patterns)) if patterns else rows


def overhangs(classified: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The overhang rows that extend works on: primary alignments only."""
    rows = classified.where((F.col("flag").bitwiseAND(2308) == 0) & _shape() & F.col("contig_length").isNotNull() & (F.col("anchor") >= limits.min_anchor))
    return ends(rows).where("reason is null").drop("reason", "bucket")


def masked(limits_off: bool = False) -> Column:
    """A read with its overhanging clip in lower case (rows of ends())."""
    n = F.col("clip_length").cast("int")
    rest = F.length("seq") - n
    if limits_off:
        return F.col("seq")
    return F.when(F.col("end") == "L", F.concat(F.lower(F.left("seq", n)), F.substring("seq", n + 1, F.length("seq")))).otherwise(F.concat(F.left("seq", rest), F.lower(F.right("seq", n))))


def read_slice(limit: int) -> list[Column]:
    """slice, at most `limit` bases of the read from the contig end's side on, and slice_offset, where it begins in the read
    (rows of ends()). Without a sequence, or with a limit below 1, empty and 0."""
    seq = F.coalesce("seq", F.lit(""))
    some = F.lit(max(limit, 0))
    at_left = F.col("end") == "L"
    begin = F.when(at_left | (some == 0), 0).otherwise(F.greatest(F.length(seq) - some, F.lit(0)))
    return [F.when(at_left, F.left(seq, some)).otherwise(F.right(seq, some)).alias("slice"), begin.cast("int").alias("slice_offset")]


def sequence_header() -> Column:
    """read overhang_{end}_{contig} with the stats; overhang_length is the whole clip."""
    word = F.when(F.col("end") == "L", "left").otherwise("right")
    return F.concat_ws(" ", "qname", F.concat_ws("_", F.lit("overhang"), word, "contig"), F.concat(F.lit("mapq="), F.col("mapq")), F.concat(F.lit("clip_length="), F.col("clip_length")), F.concat(F.lit("overhang_length="), F.col("clip_length")))
