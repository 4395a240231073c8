"""Statistics of contig ends: counts, robust scores, flags, histograms and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.storagelevel import StorageLevel

FLOOR = 8  # contigs below which no flag is raised
BINS, PROFILE_BINS, BIN_BASES = 10, 14, 65_536


def _lengths(overhangs: DataFrame) -> DataFrame:
    """Clip lengths counted: contig, end, clip_length, n, best. Medians and quantiles of an end then meet its distinct lengths
    only, whatever number of reads it has."""
    return overhangs.groupBy("contig", "end", F.col("clip_length").cast("long").alias("clip_length")).agg(F.count("*").alias("n"), F.max("net_gain").alias("best"))


def contig_stats(overhangs: DataFrame, contigs: DataFrame) -> DataFrame:
    """A row for each contig, zeros for an empty end."""
    agg = []
    for end, name in (("L", "left"), ("R", "right")):
        here = F.col("end") == end
        clip = F.when(here, F.col("clip_length"))
        agg += [F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0).cast("long")).alias(f"{name}_count"), F.sum(clip * F.col("n")).alias(f"{name}_total"), F.percentile(clip, F.lit(0.5), F.col("n")).alias(f"{name}_median"), F.max(clip).alias(f"{name}_max")]
    found = _lengths(overhangs).groupBy("contig").agg(*agg)
    rows = contigs.select("contig", F.col("contig_length").cast("long"), "contig_ord").join(found, "contig", "left")
    return rows.select("contig", "contig_length", "contig_ord", *[F.coalesce(c, F.lit(0.0 if c.endswith("median") else 0)).alias(c) for c in found.columns if c != "contig"])


def supported(stats: DataFrame, least: int = 1) -> DataFrame:
    return stats.where(F.greatest("left_count", "right_count") >= least)


def overall(overhangs: DataFrame) -> DataFrame:
    """end in L, R, both: count, mean, median, sample deviation, min, max."""
    grouped = overhangs.select("end", "clip_length").unionByName(overhangs.select(F.lit("both").alias("end"), "clip_length")).groupBy("end")
    return grouped.agg(
        F.count("*").alias("n"), F.avg("clip_length").alias("mean"), F.median("clip_length").alias("median"), F.coalesce(F.stddev_samp("clip_length"), F.lit(0.0)).alias("sd"), F.min("clip_length").alias("least"), F.max("clip_length").alias("most")
    )


def measures(stats: DataFrame) -> DataFrame:
    """The four measures of a contig as rows."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("value")) for m, c in (("left_count", "left_count"), ("right_count", "right_count"), ("left_median", "left_median"), ("right_median", "right_median"))])
    return stats.select("contig", F.explode(rows).alias("m")).select("contig", "m.*")


def modified_z(values: DataFrame) -> DataFrame:
    """values (contig, measure, value) with z: distance from the median in scaled MADs, in scaled mean deviations where the
    MAD is 0, and 0 where that is 0 too or there is one value only. The medians are a row for each measure. The values are
    read three times, so they are kept: a row for each contig and measure."""
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    middle = values.groupBy("measure").agg(F.median("value").alias("mid"), F.count("*").alias("n_values"))
    rows = values.join(middle, "measure").withColumn("off", F.abs(F.col("value") - F.col("mid")))
    spread = rows.groupBy("measure").agg(F.median("off").alias("mad"), F.avg("off").alias("mean_off"))
    rows = rows.join(spread, "measure")
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(1.253314 * F.col("mean_off"))
    z = F.when((F.col("n_values") <= 1) | (scale == 0), 0.0).otherwise((F.col("value") - F.col("mid")) / scale)
    return rows.select("contig", "measure", "value", z.alias("z"), "n_values")


def anomalies(stats: DataFrame, threshold: float = 3.5) -> DataFrame:
    """contig, measure, value, z of what exceeds the threshold, if there are enough contigs."""
    return modified_z(measures(stats)).where((F.col("n_values") >= FLOOR) & (F.col("z") > threshold)).drop("n_values")


def flagged_both(flags: DataFrame) -> DataFrame:
    """Contig ends that are both deep and long."""
    half = lambda kind: flags.where(F.col("measure").endswith(kind)).select("contig", F.split("measure", "_")[0].alias("side"))
    return half("_count").intersect(half("_median"))


def histogram(values: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal integer-width bins from least to most, empty ones included: bin, low, n."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    span = span.withColumn("bins", F.least(F.lit(bins), F.col("hi") - F.col("lo") + 1).cast("int")).withColumn("width", (F.col("hi") - F.col("lo") + 1) / F.col("bins"))
    counted = values.crossJoin(F.broadcast(span)).groupBy(F.least(F.col("bins") - 1, F.floor((F.col(column) - F.col("lo")) / F.col("width"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # span: one row
    spine = span.select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "width")
    return spine.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def quantiles(overhangs: DataFrame) -> DataFrame:
    """Depth, quartiles, median, longest and best gain of each contig end."""
    q = lambda p: F.percentile("clip_length", F.lit(p), F.col("n"))
    return _lengths(overhangs).groupBy("contig", "end").agg(F.sum("n").alias("depth"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), q(0.99).alias("p99"), F.max("clip_length").alias("longest"), F.max("best").alias("best_gain"))


def density(overhangs: DataFrame, least: int = 4, bins: int = PROFILE_BINS) -> DataFrame:
    """Profile of clip lengths of each contig end with `least` reads: bins up to the 99 % quantile (longer ones in the last),
    smoothed twice by a three-bin mean, scaled to a maximum of 1. Groups are counts per bin, not reads."""
    lengths = _lengths(overhangs)
    top = lengths.groupBy("contig", "end").agg(F.sum("n").alias("depth"), F.percentile("clip_length", F.lit(0.99), F.col("n")).alias("p99")).where((F.col("depth") >= least) & (F.col("p99") > 0))
    at = F.least(F.floor(F.col("clip_length") / (F.col("p99") / bins)), F.lit(bins - 1)).cast("int")
    counted = lengths.join(top, ["contig", "end"]).groupBy("contig", "end", at.alias("bin")).agg(F.sum("n").alias("n"))
    spine = top.select("contig", "end", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = spine.join(counted, ["contig", "end", "bin"], "left").withColumn("v", F.coalesce("n", F.lit(0)).cast("double"))
    near = W.partitionBy("contig", "end").orderBy("bin").rowsBetween(-1, 1)
    rows = rows.withColumn("v", F.avg("v").over(near)).withColumn("v", F.avg("v").over(near))
    return rows.select("contig", "end", "bin", (F.col("v") / F.max("v").over(W.partitionBy("contig", "end"))).alias("density"))


def coverage(intervals: DataFrame, width: int = BIN_BASES) -> DataFrame:
    """Depth at each position where it changes, from (contig, first, last) intervals: +1 and -1 events summed along. Sums
    run inside bins of `width` positions, from the sum of the bins before, so no task holds a contig's positions."""
    events = intervals.select("contig", F.explode(F.array(F.struct(F.col("first").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("contig", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("step")).withColumn("bin", F.floor(F.col("pos") / width))
    bins = steps.groupBy("contig", "bin").agg(F.sum("step").alias("total"))
    before = W.partitionBy("contig").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("contig", "bin", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = F.sum("step").over(W.partitionBy("contig", "bin").orderBy("pos"))
    return steps.withColumn("inside", inside).join(bins, ["contig", "bin"]).select("contig", "pos", (F.col("base") + F.col("inside")).alias("depth"))


def median_or_zero(column: str) -> Column:
    return F.coalesce(F.median(column), F.lit(0.0))
