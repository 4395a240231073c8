"""Ranking overhangs, choosing one for each contig end, and extending contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import motifs as M

END = ("contig", "end")
TIES = ("pos", "qname")


def _banded(overhangs: DataFrame, min_extension: int) -> DataFrame:
    """Candidates with `band`: how many margins below the end's best gain. The best is taken before any other filter, by a
    grouping that needs two columns only; its row for each end joins back."""
    rows = overhangs.where(F.col("net_gain") >= min_extension)
    best = rows.groupBy(*END).agg(F.max("net_gain").alias("best"))
    margin = F.greatest(F.lit(10), F.floor(F.lit(0.05) * F.col("best"))).cast("long")
    return rows.join(best, list(END)).withColumn("band", F.floor((F.col("best") - F.col("net_gain")) / margin)).drop("best")


def _order() -> list[Column]:
    trim = F.col("clip_length") - F.col("net_gain")
    return [F.col("band"), trim, F.desc("net_gain"), F.desc("clip_length"), *map(F.col, TIES)]


def ranked(overhangs: DataFrame, min_extension: int = 1) -> DataFrame:
    """Candidates with `rank` within their contig end."""
    rows = _banded(overhangs, min_extension)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*END).orderBy(*_order())))


def best(overhangs: DataFrame, min_extension: int = 1, max_homopolymer: int = 500) -> DataFrame:
    """The first ranked candidate of each end whose clip has no homopolymer run of max_homopolymer or more. An aggregate, so
    that each partition sends on one candidate for each end, whatever number of reads an end has."""
    rows = _banded(overhangs, min_extension).where(~M.has_homopolymer(F.col("clip_seq"), max_homopolymer))
    order = F.struct(F.col("band"), F.col("clip_length") - F.col("net_gain"), -F.col("net_gain"), -F.col("clip_length"), *TIES)
    others = [c for c in rows.columns if c not in END]
    return rows.groupBy(*END).agg(F.min_by(F.struct(*others), order).alias("first")).select(*END, "first.*")


def rejected_homopolymers(overhangs: DataFrame, max_homopolymer: int = 500) -> DataFrame:
    return overhangs.where(M.has_homopolymer(F.col("clip_seq"), max_homopolymer))


def top_reads(overhangs: DataFrame, n: int = 25) -> DataFrame:
    """The n reads of each end that a report shows."""
    order = W.partitionBy(*END).orderBy(F.desc("net_gain"), F.desc("clip_length"), *TIES)
    return overhangs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def plan(chosen: DataFrame, contigs: DataFrame) -> DataFrame:
    """A row for each contig with its winners of both ends side by side, in contig order."""
    side = {}
    for end, name in (("L", "left"), ("R", "right")):
        one = F.when(F.col("end") == end, F.struct("qname", "clip_seq", "clip_length", "net_gain", "trim"))
        side[name] = F.max(one)  # one row for each end: the maximum is that row
    wide = chosen.groupBy("contig").agg(*[s.alias(n) for n, s in side.items()])
    rows = contigs.select("contig", F.col("contig_length").cast("long"), "contig_ord").join(wide, "contig", "left")
    cols = ["contig", "contig_ord", "contig_length"]
    for name in side:
        cols += [F.col(f"{name}.qname").alias(f"{name}_read"), F.coalesce(f"{name}.clip_seq", F.lit("")).alias(f"{name}_clip")]
        cols += [F.coalesce(f"{name}.{c}", F.lit(0).cast("long")).alias(f"{name}_{c}") for c in ("clip_length", "net_gain", "trim")]
    return rows.select(*cols)


def dry_run(planned: DataFrame) -> DataFrame:
    """What would become of each contig, without its sequence."""
    final = F.col("contig_length") + F.col("left_net_gain") + F.col("right_net_gain")
    return planned.select("contig", "contig_ord", "contig_length", "left_read", "right_read", "left_net_gain", "right_net_gain", "left_trim", "right_trim", final.alias("final_length"))


def apply_extensions(planned: DataFrame, sequences: DataFrame) -> DataFrame:
    """contig, contig_ord, original_length, extended (the sequence), final_length, net_gain, left_gain, right_gain, status.

    Left first, then right on the result, so that overlapping trims on tiny contigs work as one after the other. A side
    that does not pass validated() is not applied; extension_warnings() tells of it. Contigs without a sequence are left
    out."""
    rows = _applied(planned, sequences)
    size = F.length("seq")
    status = F.when(F.col("left_ok") & F.col("right_ok"), "both").when(F.col("left_ok"), "left").when(F.col("right_ok"), "right").otherwise("no")
    return rows.select("contig", "contig_ord", size.cast("long").alias("original_length"), "extended", F.length("extended").cast("long").alias("final_length"), (F.length("extended") - size).cast("long").alias("net_gain"), (F.length("after_left") - size).cast("long").alias("left_gain"), (F.length("extended") - F.length("after_left")).cast("long").alias("right_gain"), status.alias("status"))


def validated(original: Column, extended: Column, clip: Column, trim: Column, left: bool) -> Column:
    """Is an extension right? The clip stands at its end, what trimming leaves of the original is still there, and the
    result is longer than the untrimmed original."""
    kept = F.greatest(F.length(original) - trim.cast("int"), F.lit(0))
    retained = F.right(original, kept) if left else F.left(original, kept)
    stands = extended.startswith(clip) if left else extended.endswith(clip)
    return stands & extended.contains(retained) & (F.length(extended) > F.length(original))


def extension_warnings(planned: DataFrame, sequences: DataFrame) -> DataFrame:
    """contig, contig_ord, warning: a row for each side that was planned and not applied, also where both were not."""
    rows = _applied(planned, sequences)
    said = lambda side, word: F.when(F.col(f"{side}_read").isNotNull() & ~F.col(f"{side}_ok"), F.concat(F.lit(f"the {word} end of "), "contig", F.lit(" is not extended: the overhang of "), f"{side}_read", F.lit(" would not make it longer")))
    return rows.select("contig", "contig_ord", F.explode(F.array_compact(F.array(said("left", "left"), said("right", "right")))).alias("warning"))


def _applied(planned: DataFrame, sequences: DataFrame) -> DataFrame:
    """planned with seq, after_left, extended, left_ok and right_ok."""
    rows = planned.join(sequences.select("contig", "seq"), "contig")
    left = F.concat("left_clip", F.substring("seq", F.col("left_trim").cast("int") + 1, F.length("seq")))
    rows = rows.withColumn("left_ok", F.col("left_read").isNotNull() & validated(F.col("seq"), left, F.col("left_clip"), F.col("left_trim"), True))
    rows = rows.withColumn("after_left", F.when(F.col("left_ok"), left).otherwise(F.col("seq")))
    keep = F.greatest(F.length("after_left") - F.col("right_trim").cast("int"), F.lit(0))
    right = F.concat(F.left("after_left", keep), "right_clip")
    rows = rows.withColumn("right_ok", F.col("right_read").isNotNull() & validated(F.col("after_left"), right, F.col("right_clip"), F.col("right_trim"), False))
    return rows.withColumn("extended", F.when(F.col("right_ok"), right).otherwise(F.col("after_left")))


def gains(planned: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """What each contig's extension did: lengths, gain, trim and read of both ends, status. Without applied: what it would do."""
    if applied is None:
        known = {f"{s}_gain": F.when(F.col(f"{s}_read").isNull(), F.lit(0).cast("long")).otherwise(F.col(f"{s}_clip_length") - F.col(f"{s}_trim")) for s in ("left", "right")}
        rows = planned.withColumns(known).withColumns({"original_length": F.col("contig_length"), "final_length": F.col("contig_length") + F.col("left_gain") + F.col("right_gain")})
    else:
        rows = planned.drop("contig_ord").join(applied.drop("extended", "net_gain", "status"), "contig")
    both = (F.col("left_gain") > 0, F.col("right_gain") > 0)
    status = F.when(both[0] & both[1], "both").when(both[0], "left").when(both[1], "right").otherwise("no")
    cut = lambda s: F.when(F.col(f"{s}_gain") > 0, F.col(f"{s}_trim")).otherwise(0).cast("long").alias(f"{s}_trim")
    return rows.select("contig", "contig_ord", "original_length", "final_length", "left_gain", "right_gain", "left_read", "right_read", cut("left"), cut("right"), status.alias("status"))


def grafted(planned: DataFrame, sequences: DataFrame) -> DataFrame:
    """What a dry run counts motifs in: clips beside the untrimmed contig, with the gains of both ends."""
    known = gains(planned).select("contig", "left_gain", "right_gain")
    rows = planned.select("contig", "left_clip", "right_clip").join(sequences.select("contig", "seq"), "contig").join(known, "contig")
    return rows.select("contig", F.concat("left_clip", "seq", "right_clip").alias("extended"), "left_gain", "right_gain")


def assembly(applied: DataFrame, contigs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every contig with a sequence, extended or as it was, in contig order."""
    done = applied.select("contig", "extended")
    rows = contigs.select("contig", "contig_ord").join(sequences.select("contig", "seq"), "contig").join(done, "contig", "left")
    return rows.select("contig", "contig_ord", F.coalesce("extended", "seq").alias("seq")).orderBy("contig_ord")


def terminal_counts(sequences: DataFrame, column: str, patterns: dict[str, str], window: int, halve: bool, upper: bool) -> DataFrame:
    """contig, end, window, motif, n in the windows at both ends. Before an extension the window stops at the contig's middle
    and case is ignored; after it, neither, and the bases added at an end (left_gain, right_gain) widen its window."""
    w = F.least(F.lit(window), F.floor(F.length(column) / 2).cast("int")) if halve else F.lit(window)
    wide = lambda gain: w if halve else (w + F.col(gain)).cast("int")
    windows = (("L", F.left, wide("left_gain")), ("R", F.right, wide("right_gain")))
    part = lambda cut, w: F.upper(cut(column, w)) if upper else cut(column, w)
    ends = F.array(*[F.struct(F.lit(e).alias("end"), w.alias("window"), part(cut, w).alias("part")) for e, cut, w in windows])
    rows = sequences.select("contig", F.explode(ends).alias("e")).where("e.window > 0")
    rows = rows.select("contig", "e.end", "e.window", F.explode(M.counts(F.col("e.part"), patterns)).alias("c"))
    return rows.select("contig", "end", "window", "c.motif", "c.n")


def motif_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = after.select("contig", "end", "motif", "window", F.col("n").alias("post")).join(before.select("contig", "end", "motif", F.col("n").alias("pre")), ["contig", "end", "motif"], "left")
    pre = F.coalesce("pre", F.lit(0).cast("long"))
    return rows.select("contig", "end", "motif", "window", pre.alias("pre"), "post", (F.col("post") - pre).alias("gain"))


def overhang_log(overhangs: DataFrame) -> DataFrame:
    """The ten columns of the overhang log."""
    return overhangs.select(
        "contig", "contig_length", "end", F.col("qname").alias("read"), F.col("pos").alias("aln_start"), "aln_end", F.col("gap").alias("gap_from_end"), "clip_length", F.col("net_gain").alias("overhang_length"), F.col("anchor").alias("anchor_length")
    )


def summary(planned: DataFrame) -> DataFrame:
    """One row: contigs, contigs extended, ends extended, bases gained, trimmed and grafted."""
    ends = (F.col("left_net_gain") > 0).cast("int") + (F.col("right_net_gain") > 0).cast("int")
    return planned.agg(
        F.count("*").alias("contigs"),
        F.count_if(ends > 0).alias("contigs_extended"),
        F.sum(ends).alias("ends_extended"),
        F.sum(F.col("left_net_gain") + F.col("right_net_gain")).alias("net_gained"),
        F.sum(F.col("left_trim") + F.col("right_trim")).alias("trimmed"),
        F.sum(F.col("left_clip_length") + F.col("right_clip_length")).alias("grafted"),
    )


def insertion_columns(placed: DataFrame) -> DataFrame:
    """Shared columns of a pile of placed bases (contig, end, off, ins): every offset with its deepest insertion."""
    deepest = placed.groupBy("contig", "end", "off").agg(F.max("ins").alias("deepest"))
    return deepest.select("contig", "end", "off", F.explode(F.sequence(F.lit(0), F.col("deepest"))).alias("ins"))


def placed_insertions(overhangs: DataFrame) -> DataFrame:
    """Where inserted bases of each read stand: reference offset of the base before, and their number, from the CIGAR."""
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+[MIDN=X])"), F.lit(1))
    n = lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("long")
    walk = F.aggregate(
        ops,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<off:bigint,ins:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.when(x.rlike("[MDN=X]$"), n(x)).otherwise(0)).alias("at"),
            F.concat(acc["out"], F.when(x.endswith("I"), F.array(F.struct((acc["at"] - 1).alias("off"), n(x).alias("ins")))).otherwise(F.array().cast("array<struct<off:bigint,ins:bigint>>"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    rows = overhangs.select("contig", "end", "pos", F.explode(walk).alias("i"))
    return rows.select("contig", "end", (F.col("pos") + F.col("i.off")).alias("off"), F.col("i.ins").alias("ins"))
