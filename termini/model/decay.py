"""Expected relative coverage near a molecule's end, for fixed and lognormal fragment lengths."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAST_SURVIVAL, END_SURVIVAL = 1e-12, 1e-9
FAR, TERMS = 9.0, 160  # of the series of the normal distribution


class CutoffError(ValueError):
    """No fragment is expected above the cutoff."""


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def normal_cdf_column(x: Column) -> Column:
    """Spark has no error function; this is the series 1/2 + phi(x) (x + x^3/3 + x^5/15 + ...) from its last term on, exact to
    1e-15. Beyond FAR the result is 0 or 1 to that precision."""
    z = F.least(F.greatest(x, F.lit(-FAR)), F.lit(FAR))
    series = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: 1.0 + z * z / (2 * k + 1) * acc)
    return 0.5 + z * series * F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)


@dataclass(frozen=True)
class Fixed:
    length: float

    def __post_init__(self) -> None:
        if not self.length > 0:
            raise ValueError("length must be positive")

    def survival(self, x: float) -> float:
        return 1.0 if x <= self.length else 0.0

    def survival_column(self, x: Column) -> Column:
        return F.when(x <= self.length, 1.0).otherwise(0.0)

    def partial(self, x: float) -> float:
        """E[length; length >= x]."""
        return self.length if x <= self.length else 0.0

    def partial_column(self, x: Column) -> Column:
        return F.when(x <= self.length, self.length).otherwise(0.0)

    def sample(self) -> Column:
        return F.lit(float(self.length))


@dataclass(frozen=True)
class Lognormal:
    mean: float
    sd: float

    def __post_init__(self) -> None:
        if not (self.mean > 0 and self.sd > 0):
            raise ValueError("mean and sd must be positive")

    @property
    def sigma(self) -> float:
        return math.sqrt(math.log(1.0 + (self.sd / self.mean) ** 2))

    @property
    def mu(self) -> float:
        return math.log(self.mean) - self.sigma**2 / 2.0

    def survival(self, x: float) -> float:
        return 1.0 if x <= 0 else normal_cdf((self.mu - math.log(x)) / self.sigma)

    def survival_column(self, x: Column) -> Column:
        return F.when(x <= 0, 1.0).otherwise(normal_cdf_column((self.mu - F.log(x)) / self.sigma))

    def partial(self, x: float) -> float:
        return self.mean if x <= 0 else self.mean * normal_cdf((self.mu + self.sigma**2 - math.log(x)) / self.sigma)

    def partial_column(self, x: Column) -> Column:
        return F.when(x <= 0, self.mean).otherwise(self.mean * normal_cdf_column((self.mu + self.sigma**2 - F.log(x)) / self.sigma))

    def sample(self, seed: int = 0) -> Column:
        return F.exp(self.mu + self.sigma * F.randn(seed))


def _kept(lengths: Fixed | Lognormal, cutoff: float) -> float:
    kept = lengths.survival(cutoff)
    if kept < LEAST_SURVIVAL:
        raise CutoffError(f"no fragment reaches the cutoff {cutoff}")
    return kept


def relative_coverage(positions: DataFrame, lengths: Fixed | Lognormal, cutoff: float = 0.0) -> DataFrame:
    """positions (x) with c = E[min(x + 1, l)] / E[l] over fragments of the cutoff or more."""
    kept = _kept(lengths, cutoff)
    mean = lengths.partial(cutoff) / kept
    a = F.col("x").cast("double") + 1.0
    inside = lengths.partial(cutoff) - lengths.partial_column(a) + a * lengths.survival_column(a)
    return positions.withColumn("c", F.when(a <= cutoff, a).otherwise(inside / kept) / mean)


def upper_end(top: float, lengths: Fixed | Lognormal, cutoff: float = 0.0) -> float:
    """Where integrals end: doubled from the largest point on until hardly a fragment is longer."""
    upper = max(top, cutoff, 1.0)
    while lengths.survival(upper) >= END_SURVIVAL:
        upper *= 2.0
    return upper


def quadrature_coverage(positions: DataFrame, lengths: Fixed | Lognormal, cutoff: float = 0.0, nodes: int = 8192, upper: float | None = None) -> DataFrame:
    """positions (x) with c by the integral of the truncated survival function, for any lengths with a survival function: the
    trapezoid rule on one grid of even nodes, all points and the cutoff, so that each integral ends on a point of the grid.

    The grid is summed cell by cell (between two nodes) and then over the cells, whose number is a parameter."""
    kept = _kept(lengths, cutoff)
    a = F.col("x").cast("double") + 1.0
    if upper is None:
        upper = upper_end(positions.agg(F.max(a)).first()[0] or 0.0, lengths, cutoff)
    step = upper / (nodes - 1)
    place = lambda t: F.least(F.floor(t / step), F.lit(nodes - 2)).cast("long")
    points = positions.select("x").distinct().withColumn("t", F.least(a, F.lit(upper))).select("x", "t", place(F.col("t")).alias("cell"))
    spark = positions.sparkSession
    none = F.lit(None).cast(positions.schema["x"].dataType)
    ends = spark.range(nodes - 1).select(none.alias("x"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("k"), F.col("id").alias("cell")).select("x", (F.col("k") * step).alias("t"), "cell")
    cut = spark.range(1).select(none.alias("x"), F.lit(min(float(cutoff), upper)).alias("t")).withColumn("cell", place(F.col("t")))
    inside = W.partitionBy("cell").orderBy("t", F.asc_nulls_first("x"))
    grid = points.unionByName(ends).unionByName(cut).withColumn("s", F.when(F.col("t") < cutoff, 1.0).otherwise(lengths.survival_column(F.col("t")) / kept))
    grid = grid.withColumn("area", F.coalesce((F.col("t") - F.lag("t").over(inside)) * (F.col("s") + F.lag("s").over(inside)) / 2.0, F.lit(0.0)))
    grid = grid.withColumn("upto", F.sum("area").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    cells = grid.groupBy("cell").agg(F.max("upto").alias("total"))
    along = W.orderBy("cell")  # `nodes` rows
    cells = cells.select("cell", (F.sum("total").over(along) - F.col("total")).alias("base"), F.sum("total").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("whole"))
    found = grid.where("x is not null").join(cells, "cell").select("x", ((F.col("base") + F.col("upto")) / F.col("whole")).alias("c"))
    return positions.join(found, "x", "left")


def simulated(spark: SparkSession, molecule: int, depth: float, lengths: Fixed | Lognormal, window: int, cutoff: float = 0.0, reps: int = 1, seed: int = 0) -> DataFrame:
    """rep, x, c: coverage of the first `window` positions relative to the molecule's mean, by fragments with a uniform
    start that lie wholly inside the molecule and reach the cutoff. Tallied by difference events, a partition of the window for each rep."""
    kept = _kept(lengths, cutoff)
    mean = lengths.partial(cutoff) / kept
    n = int(math.ceil(depth * molecule / mean / kept))
    draws = spark.range(reps * n).select((F.col("id") % reps).cast("int").alias("rep"), F.floor(lengths.sample(seed) if isinstance(lengths, Lognormal) else lengths.sample()).cast("long").alias("l"), F.rand(seed + 1).alias("u"))
    draws = draws.where((F.col("l") >= cutoff) & (F.col("l") > 0) & (F.col("l") <= molecule)).withColumn("first", F.floor(F.col("u") * (F.lit(molecule) - F.col("l") + 1)))
    total = draws.groupBy("rep").agg((F.sum("l") / molecule).alias("mean_depth"))
    near = draws.where(F.col("first") < window)
    events = near.select("rep", F.explode(F.array(F.struct(F.col("first").alias("x"), F.lit(1).alias("d")), F.struct((F.col("first") + F.col("l")).alias("x"), F.lit(-1).alias("d")))).alias("e")).where(F.col("e.x") < window)
    steps = events.groupBy("rep", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    spine = spark.range(reps).select(F.col("id").cast("int").alias("rep")).crossJoin(spark.range(window).select(F.col("id").alias("x")))  # reps x window positions, both parameters
    rows = spine.join(steps, ["rep", "x"], "left").withColumn("depth", F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy("rep").orderBy("x")))
    return rows.join(total, "rep").select("rep", "x", (F.col("depth") / F.col("mean_depth")).alias("c"))


def bootstrap(spark: SparkSession, molecule: int, depth: float, lengths: Fixed | Lognormal, window: int, cutoff: float = 0.0, reps: int = 10, level: float = 0.95, seed: int = 0) -> DataFrame:
    """x, mean, lo, hi over the reps, and the analytic curve."""
    tail = (1.0 - level) / 2.0
    runs = simulated(spark, molecule, depth, lengths, window, cutoff, reps, seed)
    band = runs.groupBy("x").agg(F.avg("c").alias("mean"), F.percentile("c", F.lit(tail)).alias("lo"), F.percentile("c", F.lit(1.0 - tail)).alias("hi"))
    return relative_coverage(band, lengths, cutoff).withColumnRenamed("c", "analytic")
