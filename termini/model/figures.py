"""The curves behind the figures of the coverage model, as DataFrames; drawing them is left to the reader's own tool."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decay

# The library, cutoffs and extent that the figures show.
LIBRARY, CUTOFFS, CUTOFF, FAR, POINTS = decay.Lognormal(15_000.0, 3_000.0), (0.0, 10_000.0, 13_000.0, 17_000.0), 10_000.0, 35_000.0, 700
OTHERS = {"lognormal, sd 3 Kbp": LIBRARY, "lognormal, sd 6 Kbp": decay.Lognormal(15_000.0, 6_000.0), "fixed 15 Kbp": decay.Fixed(15_000.0)}


def retained(lengths: decay.Fixed | decay.Lognormal, cutoff: float) -> float:
    """The share of all bases that lies in fragments of the cutoff or more."""
    return lengths.partial(cutoff) / lengths.partial(0.0)


def decay_families(spark: SparkSession, far: float = FAR, points: int = POINTS) -> DataFrame:
    """panel, series, x, y at even points from 0 to far. Panel a: coverage against the selected library's own inner depth, a
    series for each cutoff; b: the same against the depth of the library before selection; c: other lengths, one cutoff."""
    grid = spark.range(points).select((F.col("id") * far / (points - 1)).alias("x"))
    curves = [(panel, f"cutoff {c:g}", LIBRARY, c, retained(LIBRARY, c) if panel == "b" else 1.0) for panel in "ab" for c in CUTOFFS]
    curves += [("c", name, lengths, CUTOFF, 1.0) for name, lengths in OTHERS.items()]
    parts = [decay.relative_coverage(grid, lengths, c).select(F.lit(panel).alias("panel"), F.lit(name).alias("series"), "x", (F.col("c") * share).alias("y")) for panel, name, lengths, c, share in curves]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decay_band(spark: SparkSession, depth: float = 30.0, reps: int = 200, seed: int = 42, molecule: int = 1_000_000, window: int = 35_000) -> DataFrame:
    """x with the simulated depth's mean and 95 % band (lo, hi) over the reps, and the analytic depth."""
    rows = decay.bootstrap(spark, molecule, depth, LIBRARY, window, CUTOFF, reps, seed=seed)
    return rows.select("x", *[(F.col(c) * depth).alias(c) for c in ("mean", "lo", "hi", "analytic")])
