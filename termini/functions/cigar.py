"""CIGAR strings as Catalyst expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_OPS, ANCHOR_OPS = "MDN=X", "M=X"


def operations(cigar: Column) -> Column:
    """ARRAY<STRUCT<n BIGINT, op STRING>>, by one match over the text; what is no operation is skipped, '' and '*' give none."""
    found = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.left(x, F.length(x) - 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def measured(cigar: Column) -> Column:
    """One-element ARRAY<STRUCT<span, anchor, left_clip, right_clip>>. inline() of it is a barrier: predicates on the four
    stay above, so that the text is taken apart once for each row, however often they are used."""
    parts = lambda ops: F.struct(reference_span(ops).alias("span"), anchor(ops).alias("anchor"), left_clip(ops).alias("left_clip"), right_clip(ops).alias("right_clip"))
    return F.transform(F.array(operations(cigar)), parts)


def total(ops: Column, codes: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin(*codes), x["n"]).otherwise(0))


def reference_span(ops: Column) -> Column:
    return total(ops, SPAN_OPS)


def anchor(ops: Column) -> Column:
    return total(ops, ANCHOR_OPS)


def left_clip(ops: Column) -> Column:
    first = F.get(ops, F.lit(0))
    return F.when(first["op"] == "S", first["n"]).otherwise(F.lit(0).cast("long"))


def right_clip(ops: Column) -> Column:
    """The last operation if it is a soft clip; a single operation counts on the left only."""
    last = F.get(ops, F.size(ops) - 1)
    return F.when((F.size(ops) > 1) & (last["op"] == "S"), last["n"]).otherwise(F.lit(0).cast("long"))
