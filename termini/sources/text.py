"""SAM, FAI, FASTA and name lists through Spark's text reader."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIELDS = 11


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no; line_no rises in file order within a file (gaps are possible)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def sam_columns(value: Column) -> list[Column]:
    """The fields of an alignment line; a number that is none becomes null instead of failing."""
    f = F.split(value, "\t")
    text = {"qname": 0, "rname": 2, "cigar": 5, "rnext": 6, "seq": 9, "qual": 10}
    number = {"flag": 1, "pos": 3, "mapq": 4, "pnext": 7, "tlen": 8}
    cols = [F.get(f, F.lit(k)).alias(n) for n, k in text.items()] + [F.get(f, F.lit(k)).try_cast("int").alias(n) for n, k in number.items()]
    return [*cols, F.size(f).alias("n_fields")]


def parse_sam(rows: DataFrame) -> DataFrame:
    """Alignment rows of SAM lines (column value): headers and blank lines left out, `malformed` marked. Works on streams."""
    rows = rows.where((F.trim("value") != "") & ~F.col("value").startswith("@"))
    return rows.select("*", *sam_columns(F.col("value"))).withColumn("malformed", (F.col("n_fields") < FIELDS) | F.col("flag").isNull())


def undecodable(rows: DataFrame) -> bool:
    """Is there a line that is not UTF-8 text?"""
    return rows.where(~F.is_valid_utf8("value")).limit(1).count() > 0


def flaws(rows: DataFrame, most: int = 5, width: int = 120) -> tuple[list[tuple[str, str]], bool]:
    """(reason, excerpt) of the first `most` rows of parse_sam that are no alignments, in file order, and whether there are
    more. A number that cannot be read in POS or in a clipped row's CIGAR makes a row one of them too."""
    reason = F.when(F.col("n_fields") < FIELDS, "too few tab-separated fields").when(F.col("flag").isNull(), F.concat(F.lit("FLAG is not an integer: "), F.get(F.split("value", "\t"), F.lit(1))))
    clipped = (F.col("flag").bitwiseAND(4) == 0) & F.col("cigar").contains("S") & ~F.col("cigar").contains("H")
    reason = reason.when(clipped & F.col("pos").isNull(), F.concat(F.lit("POS is not an integer: "), F.get(F.split("value", "\t"), F.lit(3))))
    excerpt = F.when(F.length("value") > width, F.concat(F.left("value", F.lit(width - 3)), F.lit("..."))).otherwise(F.col("value"))
    found = rows.select("line_no", reason.alias("reason"), excerpt.alias("excerpt")).where("reason is not null").orderBy("line_no").limit(most + 1).collect()
    return [(r.reason, r.excerpt) for r in found[:most]], len(found) > most


def spooled(spark: SparkSession, stream: BinaryIO) -> str:
    """A file with what the stream holds, where executors can read it: in the folder that the cluster shares
    (spark.checkpoint.dir), or a local one where driver and executors are one process. It goes when the driver ends."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise SpoolError("standard input needs spark.checkpoint.dir, a folder that driver and executors share")
    path = f"{folder or 'file://' + tempfile.gettempdir()}/termini-input-{uuid.uuid4().hex}.sam"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
    out = files.create(hadoop)
    files.deleteOnExit(hadoop)
    while data := stream.read(1 << 20):
        out.write(bytearray(data))
    out.close()
    return path


class SpoolError(ValueError):
    pass


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, alignments) with line_no as the order of both."""
    rows = lines(spark, path)
    return rows.where(F.col("value").startswith("@")).select("line_no", "value"), parse_sam(rows)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """contig, contig_length, contig_ord; of a repeated name the last line counts."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.trim("value") != "").select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("long").alias("contig_length"), "line_no")
    rows = rows.groupBy("contig").agg(F.max_by("contig_length", "line_no").alias("contig_length"), F.min("line_no").alias("line_no"))
    return rows.select("contig", "contig_length", F.row_number().over(W.orderBy("line_no")).cast("int").alias("contig_ord"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig and seq, case kept."""
    rows = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "").alias("seq"))


class ExclusionError(ValueError):
    pass


def exclusions(spark: SparkSession, contigs: DataFrame, names: str = "", path: str | None = None) -> list[str]:
    """Names of a comma list and a file; an empty file or a name that the index lacks is an error."""
    found = [n.strip() for n in names.split(",") if n.strip()]
    if path:
        listed = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
        if not listed:
            raise ExclusionError(f"{path} names no contig")
        found += listed
    found = list(dict.fromkeys(found))
    if found:
        unknown = spark.createDataFrame([(n,) for n in found], "contig string").join(contigs, "contig", "left_anti").collect()
        if unknown:
            raise ExclusionError("not in the index: " + ", ".join(sorted(r.contig for r in unknown)))
    return found
