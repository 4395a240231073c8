"""Alignments, contigs and sequences derived from the star schema, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTIGS = """SELECT 'ctg' || lpad(CAST(n_nationkey AS VARCHAR(10)), 2, '0') AS contig, CAST(500 + 37 * n_nationkey AS BIGINT) AS contig_length, CAST(n_nationkey AS INT) AS contig_ord FROM {nation}"""

SEQUENCES = """SELECT contig, substr(repeat(translate(md5(contig), '0123456789abcdef', 'ACGTACGTACGTACGT'), 60), 1, CAST(contig_length AS INT)) AS seq FROM ({contigs}) c"""

ALIGNMENTS = """
SELECT qname, flag, rname, pos, mapq,
    CASE side WHEN 0 THEN head || core WHEN 1 THEN core || head ELSE core END AS cigar,
    CASE side WHEN 0 THEN clip || body WHEN 1 THEN body || clip ELSE body END AS seq
FROM (
    SELECT *, CASE WHEN cl > 0 THEN CAST(cl AS VARCHAR(10)) || 'S' ELSE '' END AS head,
        CASE op WHEN 1 THEN CAST(m - 40 AS VARCHAR(10)) || 'M3I37M' WHEN 2 THEN CAST(m - 40 AS VARCHAR(10)) || 'M4D36M' ELSE CAST(m AS VARCHAR(10)) || 'M' END AS core,
        CASE WHEN okey % 7 = 1 THEN repeat('A', cl) WHEN okey % 3 = 0 THEN substr(repeat(CASE WHEN side = 0 THEN 'CCCTAA' ELSE 'TTAGGG' END, 15), 1, cl) ELSE substr(repeat(base, 3), 1, cl) END AS clip,
        substr(repeat(base, 5), 1, CASE WHEN op = 2 THEN m - 4 ELSE m END) AS body,
        CAST(CASE side WHEN 0 THEN 1 + g WHEN 1 THEN contig_length - g - m + 1 ELSE 100 + g END AS INT) AS pos
    FROM (
        SELECT CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST(l_linenumber AS VARCHAR(10)) || '_' || CAST(l_partkey AS VARCHAR(20)) || '_' || CAST(l_suppkey AS VARCHAR(20)) || '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)) AS qname,
            CASE l_linenumber WHEN 5 THEN 4 WHEN 6 THEN 256 WHEN 7 THEN 2048 ELSE 0 END AS flag,
            CAST(l_quantity AS INT) AS mapq, l_orderkey AS okey, CAST(l_partkey % 3 AS INT) AS side, CAST(l_partkey % 61 AS INT) AS g, CAST(l_partkey % 89 AS INT) AS cl, CAST(80 + l_orderkey % 60 AS INT) AS m,
            CAST(CAST(l_quantity AS INT) % 5 AS INT) AS op, contig AS rname, contig_length,
            translate(md5(CAST(l_orderkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(10))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS base
        FROM {lineitem} l JOIN ({contigs}) c ON l_suppkey % 25 = contig_ord
    ) a
) b"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTIGS, nation=_read(spark, sf_dir, "nation"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEQUENCES.replace("({contigs})", "{contigs}"), contigs=contigs(spark, sf_dir))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ALIGNMENTS.replace("({contigs})", "{contigs}"), lineitem=_read(spark, sf_dir, "lineitem"), contigs=contigs(spark, sf_dir))


_C = CONTIGS.format(nation="nation")
NUMBERS = "list_transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), lambda x: x::BIGINT)"
LETTERS = "regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)"


def _sum(codes: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(list_zip(n, o), lambda z: z[2] IN ({', '.join(repr(c) for c in codes)})), lambda z: z[1])), 0)::BIGINT"


def sql_prefix(max_break: int = 50, min_clip: int = 1, min_anchor: int = 100) -> str:
    """DuckDB CTEs: contigs, sequences, calls (classified rows), overhangs (extend's rows)."""
    reason = lambda clip, gap: f"CASE WHEN {clip} <= 0 THEN 'no_clip' WHEN {gap} > {max_break} THEN 'max_break' WHEN {clip} - {gap} < {min_clip} THEN 'min_clip' END"
    end = lambda e, s, cut: f"SELECT qname, flag, rname AS contig, pos, mapq, cigar, seq, contig_length, contig_ord, anchor, aln_end, '{e}' AS \"end\", {s}_clip AS clip_length, gap_{s} AS gap, {cut}(seq, {s}_clip) AS clip_seq, {s}_clip - gap_{s} AS net_gain, greatest(0, gap_{s}) AS trim FROM calls WHERE flag & 2308 = 0 AND shape AND anchor >= {min_anchor} AND {s}_reason IS NULL"
    return f"""
WITH contigs AS ({_C}),
sequences AS ({SEQUENCES.format(contigs="SELECT * FROM contigs")}),
aln AS ({ALIGNMENTS.format(lineitem="lineitem", contigs="SELECT * FROM contigs")}),
ops AS (SELECT aln.*, contig_length, contig_ord, {NUMBERS} AS n, {LETTERS} AS o FROM aln JOIN contigs ON rname = contig),
geo AS (SELECT *, {_sum("MDN=X")} AS span, {_sum("M=X")} AS anchor, CASE WHEN o[1] = 'S' THEN n[1] ELSE 0 END AS left_clip, CASE WHEN len(o) > 1 AND o[-1] = 'S' THEN n[-1] ELSE 0 END AS right_clip, cigar LIKE '%S%' AND cigar NOT LIKE '%H%' AS shape FROM ops),
gaps AS (SELECT *, (pos + span - 1)::BIGINT AS aln_end, (pos - 1)::BIGINT AS gap_left, (contig_length - (pos + span - 1))::BIGINT AS gap_right FROM geo),
calls AS (SELECT *, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 256 <> 0 THEN 'secondary' WHEN NOT shape THEN 'no_clip' WHEN anchor < {min_anchor} THEN 'min_anchor' WHEN left_reason IS NULL OR right_reason IS NULL THEN 'kept'
        WHEN left_reason = 'max_break' OR right_reason = 'max_break' THEN 'max_break' WHEN left_reason = 'min_clip' OR right_reason = 'min_clip' THEN 'min_clip' ELSE 'no_clip' END AS bucket
    FROM (SELECT *, {reason("left_clip", "gap_left")} AS left_reason, {reason("right_clip", "gap_right")} AS right_reason FROM gaps)),
overhangs AS ({end("L", "left", "left")} UNION ALL {end("R", "right", "right")})"""
