"""The filter on a stream: lines are parsed, joined with the static contig index and classified as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.classify import Limits, classify
from ..sources.text import parse_sam


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def stream_classified(lines: DataFrame, contigs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    rows = parse_sam(lines).where("not malformed").select("value", "qname", "flag", "rname", "pos", "mapq", "cigar", "seq")
    return classify(rows, contigs, limits)
