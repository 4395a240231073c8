"""All registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import motifs as M
from ..model import decay, figures
from ..operators import classify as K
from ..operators import extend as X
from ..operators import stats as S
from ..report import layout
from .derived import LETTERS, NUMBERS, alignments, contigs, sequences, sql_prefix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MOTIFS = ["TTAGGG"]
EXACT, FUZZY = M.patterns(MOTIFS), M.patterns(MOTIFS, fuzzy=True)
LIMITS = K.Limits()
RUN = 12  # homopolymer threshold of the queries: derived clips are 88 bases at most
WINDOW = 200
PREFIX = sql_prefix()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if "WITH " in sql else PREFIX + "\n" + sql
        return f

    return add


def calls(s: SparkSession, d: str, limits: K.Limits = LIMITS) -> DataFrame:
    return K.classify(alignments(s, d), contigs(s, d), limits)


def overhangs(s: SparkSession, d: str) -> DataFrame:
    return K.overhangs(calls(s, d))


def stats(s: SparkSession, d: str) -> DataFrame:
    return S.contig_stats(overhangs(s, d), contigs(s, d))


def chosen(s: SparkSession, d: str) -> DataFrame:
    return X.best(overhangs(s, d), 1, RUN)


def planned(s: SparkSession, d: str) -> DataFrame:
    return X.plan(chosen(s, d), contigs(s, d))


def applied(s: SparkSession, d: str) -> DataFrame:
    return X.apply_extensions(planned(s, d), sequences(s, d))


def any_sql(seq: str, patterns: dict[str, str], repeats: int = 1) -> str:
    return "(" + " OR ".join(f"regexp_matches({seq}, '{p if repeats <= 1 else f'(?:{p}){{{repeats}}}'}')" for p in patterns.values()) + ")"


def count_sql(seq: str, pattern: str) -> str:
    return f"len(regexp_extract_all({seq}, '{pattern}'))::BIGINT"


def run_sql(seq: str, n: int) -> str:
    return "regexp_matches(upper(" + seq + "), '" + "|".join(f"{c}{{{n},}}" for c in "ACGTN") + "')"


# --- geometry and classification ------------------------------------------------------------------------------------
@query("cigar_ops", "SELECT o[i] AS op, count(*) AS n_ops, sum(n[i])::BIGINT AS bases FROM ops, generate_series(1, len(ops.o)) t(i) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = alignments(s, d).select(F.explode(C.operations(F.col("cigar"))).alias("x"))
    return rows.groupBy(F.col("x.op").alias("op")).agg(F.count("*").alias("n_ops"), F.sum("x.n").alias("bases"))


@query("aln_geometry", "SELECT qname, rname, pos, span, anchor, left_clip, right_clip, aln_end, gap_left, gap_right FROM calls")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.geometry(alignments(s, d), contigs(s, d)).select("qname", "rname", "pos", "span", "anchor", F.col("left_clip").cast("long"), F.col("right_clip").cast("long"), "aln_end", "gap_left", "gap_right")


@query("end_classification", "SELECT coalesce(left_reason, 'accepted') AS left_call, coalesce(right_reason, 'accepted') AS right_call, count(*) AS n FROM calls GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    a = F.lit("accepted")
    return calls(s, d).groupBy(F.coalesce("left_reason", a).alias("left_call"), F.coalesce("right_reason", a).alias("right_call")).agg(F.count("*").alias("n"))


@query("filter_kept", "SELECT qname, flag, rname, pos, mapq, cigar, seq FROM calls WHERE bucket = 'kept'")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.filtered(calls(s, d)).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq")


@query("filter_buckets", "SELECT bucket, count(*) AS n FROM calls GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.buckets(calls(s, d))


@query(
    "both_end_reads",
    """SELECT qname, rname, gap_left, gap_right, left_clip, right_clip FROM (
        SELECT qname, rname, (pos - 1)::BIGINT AS gap_left, (mapq - 1)::BIGINT AS gap_right, left_clip, CASE WHEN mapq > 0 THEN mapq ELSE 0 END::BIGINT AS right_clip FROM geo WHERE flag & 260 = 0 AND left_clip > 0 AND anchor >= 100)
    WHERE gap_left <= 50 AND left_clip - gap_left >= 1 AND gap_right <= 50 AND right_clip - gap_right >= 1""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Short contigs: every left-clipped read gets a right clip of mapq bases, and its contig ends mapq - 1 bases behind it."""
    index = contigs(s, d)
    geo = K.geometry(alignments(s, d), index).where((F.col("flag").bitwiseAND(4) == 0) & (F.col("left_clip") > 0))
    short = geo.select("qname", "flag", F.col("qname").alias("rname"), "pos", "mapq", F.concat("cigar", F.col("mapq"), F.lit("S")).alias("cigar"), "seq", F.lit(0).alias("contig_ord"), (F.col("aln_end") + F.col("mapq") - 1).alias("contig_length"), F.col("rname").alias("contig_name"))
    own = short.select(F.col("rname").alias("contig"), "contig_length", "contig_ord")
    rows = K.filtered(K.classify(short.select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq"), own)).where("left_reason is null and right_reason is null")
    return rows.join(short.select("qname", "contig_name"), "qname").select("qname", F.col("contig_name").alias("rname"), "gap_left", "gap_right", F.col("left_clip").cast("long"), F.col("right_clip").cast("long"))


def _counters(passed: str, motif: str) -> str:
    excluded = ", ".join(f"count(*) FILTER (bucket = '{b}') AS excluded_{b}" for b in K.BUCKETS)
    return f"""SELECT count(*) AS processed, count(*) FILTER (bucket = 'kept') AS kept, count(*) FILTER (bucket = 'kept' AND left_reason IS NULL AND right_reason IS NULL) AS both, count(*) FILTER (bucket = 'kept' AND {passed}) AS output, {motif} AS motif,
    count(*) - count(*) FILTER (bucket = 'kept' AND {passed}) AS removed, {excluded}, count(*) FILTER (bucket = 'kept' AND NOT {passed}) AS excluded_motifs FROM calls"""


@query("run_counters", _counters("true", "NULL::BIGINT"))
def _(s: SparkSession, d: str) -> DataFrame:
    return K.counters(calls(s, d))


@query("contig_end_counts", "SELECT rname AS contig, count(*) FILTER (left_reason IS NULL) AS left_kept, count(*) FILTER (right_reason IS NULL) AS right_kept FROM calls WHERE bucket = 'kept' GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.kept_ends(calls(s, d))


# --- extract --------------------------------------------------------------------------------------------------------
_EXTRACT = "sides AS (SELECT * FROM (SELECT *, 'L' AS \"end\", left_reason AS reason, left_clip AS clip_length, gap_left AS gap, left(seq, left_clip) AS clip_seq FROM calls UNION ALL SELECT *, 'R', right_reason, right_clip, gap_right, right(seq, right_clip) FROM calls))"
_EX = PREFIX + ",\n" + _EXTRACT + "\n"


@query("extract_overhangs", _EX + "SELECT qname, rname AS contig, \"end\", clip_length, (clip_length - gap)::BIGINT AS net_gain, clip_seq FROM sides WHERE flag & 260 = 0 AND shape AND anchor >= 100 AND reason IS NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.extracted(calls(s, d), LIMITS).select("qname", "contig", "end", F.col("clip_length").cast("long"), "net_gain", "clip_seq")


@query("extract_motif_ends", _EX + f"SELECT qname, rname AS contig, \"end\" FROM sides WHERE flag & 260 = 0 AND shape AND anchor >= 100 AND reason IS NULL AND {any_sql('upper(clip_seq)', EXACT)}")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.extracted(calls(s, d), LIMITS, EXACT).select("qname", "contig", "end")


@query(
    "extract_buckets",
    _EX + f""", r AS (SELECT *, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 256 <> 0 THEN 'secondary' WHEN NOT shape THEN 'no_clip' WHEN mapq < 20 THEN 'quality' WHEN anchor < 100 THEN 'min_anchor' END AS row_bucket FROM calls)
    SELECT bucket, count(*) AS n FROM (SELECT row_bucket AS bucket FROM r WHERE row_bucket IS NOT NULL
    UNION ALL SELECT CASE WHEN reason IS NULL AND NOT {any_sql('upper(clip_seq)', EXACT)} THEN 'motifs' ELSE coalesce(reason, 'accepted') END FROM sides WHERE flag & 260 = 0 AND shape AND mapq >= 20 AND anchor >= 100 AND coalesce(reason, '') <> 'no_clip') GROUP BY 1
    """,
)
def _(s: SparkSession, d: str) -> DataFrame:
    limits = K.Limits(min_mapq=20)
    return K.extract_buckets(calls(s, d, limits), limits, EXACT)


@query("mapq_filtered", _EX + "SELECT rname AS contig, count(*) AS n, min(mapq) AS least_mapq FROM sides WHERE flag & 260 = 0 AND shape AND mapq >= 30 AND anchor >= 100 AND reason IS NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    limits = K.Limits(min_mapq=30)
    return K.extracted(calls(s, d, limits), limits).groupBy("contig").agg(F.count("*").alias("n"), F.min("mapq").alias("least_mapq"))


@query("overhang_masked", "SELECT qname, \"end\", CASE WHEN \"end\" = 'L' THEN lower(left(seq, clip_length)) || substr(seq, clip_length + 1) ELSE left(seq, length(seq) - clip_length) || lower(right(seq, clip_length)) END AS masked FROM overhangs")
def _(s: SparkSession, d: str) -> DataFrame:
    return overhangs(s, d).select("qname", "end", K.masked().alias("masked"))


@query("read_slices", "SELECT qname, \"end\", CASE WHEN \"end\" = 'L' THEN left(seq, 40) ELSE right(seq, 40) END AS slice, (CASE WHEN \"end\" = 'L' THEN 0 ELSE greatest(length(seq) - 40, 0) END)::INT AS slice_offset FROM overhangs")
def _(s: SparkSession, d: str) -> DataFrame:
    return overhangs(s, d).select("qname", "end", *K.read_slice(40))


@query("extract_headers", "SELECT qname || ' overhang_' || CASE WHEN \"end\" = 'L' THEN 'left' ELSE 'right' END || '_' || contig || ' mapq=' || mapq || ' clip_length=' || clip_length || ' overhang_length=' || clip_length AS header FROM overhangs")
def _(s: SparkSession, d: str) -> DataFrame:
    return overhangs(s, d).select(K.sequence_header().alias("header"))


@query("zero_overhang_contigs", "SELECT contig FROM contigs WHERE contig NOT IN (SELECT contig FROM overhangs WHERE net_gain >= 85)")
def _(s: SparkSession, d: str) -> DataFrame:
    return contigs(s, d).join(overhangs(s, d).where("net_gain >= 85"), "contig", "left_anti").select("contig")


@query("distinct_contigs", "SELECT count(DISTINCT contig) AS any_end, count(DISTINCT contig) FILTER (\"end\" = 'L') AS left_end, count(DISTINCT contig) FILTER (\"end\" = 'R') AS right_end FROM overhangs")
def _(s: SparkSession, d: str) -> DataFrame:
    of = lambda e: F.count_distinct(F.when(F.col("end") == e, F.col("contig")))
    return overhangs(s, d).agg(F.count_distinct("contig").alias("any_end"), of("L").alias("left_end"), of("R").alias("right_end"))


# --- motifs ---------------------------------------------------------------------------------------------------------
def _clip_hit(p: dict[str, str], n: int = 1) -> str:
    return f"((left_reason IS NULL AND {any_sql('left(seq, left_clip)', p, n)}) OR (right_reason IS NULL AND {any_sql('right(seq, right_clip)', p, n)}))"


for _name, _p, _n in (("motif_presence_exact", EXACT, 1), ("motif_presence_fuzzy", FUZZY, 1), ("motif_repeats", EXACT, 3), ("motif_repeats_fuzzy", FUZZY, 3)):

    @query(_name, f"SELECT qname, rname FROM calls WHERE bucket = 'kept' AND {_clip_hit(_p, _n)}")
    def _(s: SparkSession, d: str, p: dict = _p, n: int = _n) -> DataFrame:
        return K.filtered(calls(s, d), p, n).select("qname", "rname")


@query("motif_anywhere", f"SELECT qname, rname FROM calls WHERE bucket = 'kept' AND {any_sql('seq', EXACT)}")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.filtered(calls(s, d), EXACT, anywhere=True).select("qname", "rname")


@query("run_counters_motifs", _counters(_clip_hit(EXACT), f"count(*) FILTER (bucket = 'kept' AND {_clip_hit(EXACT)})"))
def _(s: SparkSession, d: str) -> DataFrame:
    return K.counters(calls(s, d), patterns=EXACT)


@query("motif_buckets", f"SELECT CASE WHEN bucket = 'kept' AND NOT {_clip_hit(EXACT)} THEN 'motifs' ELSE bucket END AS bucket, count(*) AS n FROM calls GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return K.buckets(calls(s, d), EXACT)


for _name, _p in (("motif_counts_exact", EXACT), ("motif_counts_fuzzy", FUZZY)):
    _sql = " UNION ALL ".join(f"SELECT contig, '{m}' AS motif, sum({count_sql('clip_seq', p)})::BIGINT AS n, count(*) FILTER ({count_sql('clip_seq', p)} > 0) AS reads FROM overhangs GROUP BY 1" for m, p in _p.items())

    @query(_name, _sql)
    def _(s: SparkSession, d: str, p: dict = _p) -> DataFrame:
        rows = overhangs(s, d).select("contig", F.explode(M.counts(F.col("clip_seq"), p)).alias("c"))
        return rows.groupBy("contig", F.col("c.motif").alias("motif")).agg(F.sum("c.n").alias("n"), F.count_if(F.col("c.n") > 0).alias("reads"))


# --- statistics -----------------------------------------------------------------------------------------------------
_STATS = """cs AS (SELECT contig, c.contig_length, c.contig_ord,
    count(*) FILTER ("end" = 'L') AS left_count, coalesce(sum(clip_length) FILTER ("end" = 'L'), 0)::BIGINT AS left_total, coalesce(median(clip_length) FILTER ("end" = 'L'), 0.0)::DOUBLE AS left_median, coalesce(max(clip_length) FILTER ("end" = 'L'), 0) AS left_max,
    count(*) FILTER ("end" = 'R') AS right_count, coalesce(sum(clip_length) FILTER ("end" = 'R'), 0)::BIGINT AS right_total, coalesce(median(clip_length) FILTER ("end" = 'R'), 0.0)::DOUBLE AS right_median, coalesce(max(clip_length) FILTER ("end" = 'R'), 0) AS right_max
    FROM contigs c LEFT JOIN overhangs o USING (contig) GROUP BY 1, 2, 3)"""
_ST = PREFIX + ",\n" + _STATS + "\n"


@query("contig_stats", _ST + "SELECT * FROM cs")
def _(s: SparkSession, d: str) -> DataFrame:
    return stats(s, d)


@query("supported_contigs", _ST + "SELECT contig, left_count, right_count FROM cs WHERE greatest(left_count, right_count) >= 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.supported(stats(s, d), 20).select("contig", "left_count", "right_count")


@query("excluded_contigs", _ST + "SELECT contig, left_count, right_count, contig IN ('ctg03', 'ctg17') AS excluded FROM cs")
def _(s: SparkSession, d: str) -> DataFrame:
    return stats(s, d).select("contig", "left_count", "right_count", F.col("contig").isin("ctg03", "ctg17").alias("excluded"))


@query("overall_stats", "SELECT e AS \"end\", count(*) AS n, round(avg(clip_length), 6) AS mean, median(clip_length)::DOUBLE AS median, round(coalesce(stddev_samp(clip_length), 0.0), 6) AS sd, min(clip_length) AS least, max(clip_length) AS most FROM (SELECT \"end\" AS e, clip_length FROM overhangs UNION ALL SELECT 'both', clip_length FROM overhangs) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.overall(overhangs(s, d)).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


_MEASURES = "ms AS (" + " UNION ALL ".join(f"SELECT contig, '{m}' AS measure, {m}::DOUBLE AS value FROM cs" for m in ("left_count", "right_count", "left_median", "right_median")) + ")"
_Z = """z AS (SELECT contig, measure, value, CASE WHEN k <= 1 OR sc = 0 THEN 0.0 ELSE (value - mid) / sc END AS z, k FROM (
    SELECT *, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.253314 * mean_off END AS sc FROM (
        SELECT *, median(abs(value - mid)) OVER (PARTITION BY measure) AS mad, avg(abs(value - mid)) OVER (PARTITION BY measure) AS mean_off FROM (
            SELECT *, median(value) OVER (PARTITION BY measure) AS mid, count(*) OVER (PARTITION BY measure) AS k FROM ms))))"""
_ZQ = PREFIX + ",\n" + _STATS + ",\n" + _MEASURES + ",\n" + _Z + "\n"


@query("modified_z", _ZQ + "SELECT contig, measure, value, round(z, 6)::DOUBLE AS z FROM z")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.modified_z(S.measures(stats(s, d))).select("contig", "measure", "value", F.round("z", 6).alias("z"))


@query("anomaly_flags", _ZQ + "SELECT contig, measure, value, round(z, 6)::DOUBLE AS z FROM z WHERE z > 1.5 AND k >= 8")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.anomalies(stats(s, d), 1.5).select("contig", "measure", "value", F.round("z", 6).alias("z"))


@query("flag_intersection", _ZQ + "SELECT contig, string_split(measure, '_')[1] AS side FROM z WHERE z > 0.5 AND measure LIKE '%count' INTERSECT SELECT contig, string_split(measure, '_')[1] FROM z WHERE z > 0.5 AND measure LIKE '%median'")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.flagged_both(S.anomalies(stats(s, d), 0.5))


@query(
    "depth_histogram",
    PREFIX + """, b AS (SELECT min(clip_length) AS lo, max(clip_length) AS hi, least(10, max(clip_length) - min(clip_length) + 1)::INT AS bins FROM overhangs), w AS (SELECT *, (hi - lo + 1) / bins AS width FROM b)
    SELECT bin::INT AS bin, round(lo + bin * width, 6)::DOUBLE AS low, count(clip_length) AS n FROM w, generate_series(0, bins - 1) t(bin) LEFT JOIN overhangs ON least(bins - 1, floor((clip_length - lo) / width)) = bin GROUP BY 1, 2""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return S.histogram(overhangs(s, d), "clip_length").select("bin", F.round("low", 6).alias("low"), "n")


@query("length_quantiles", "SELECT contig, \"end\", count(*) AS depth, quantile_cont(clip_length, 0.25) AS q1, quantile_cont(clip_length, 0.5) AS q2, quantile_cont(clip_length, 0.75) AS q3, round(quantile_cont(clip_length, 0.99), 6) AS p99, max(clip_length) AS longest, max(net_gain)::BIGINT AS best_gain FROM overhangs GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.quantiles(overhangs(s, d)).withColumn("p99", F.round("p99", 6))


@query(
    "density_profile",
    PREFIX + """, t AS (SELECT contig, "end" AS e, quantile_cont(clip_length, 0.99) AS p99 FROM overhangs GROUP BY 1, 2 HAVING count(*) >= 4 AND quantile_cont(clip_length, 0.99) > 0),
    c AS (SELECT o.contig, e, least(floor(clip_length / (p99 / 14)), 13)::INT AS bin, count(*) AS n FROM overhangs o JOIN t ON o.contig = t.contig AND o."end" = e GROUP BY 1, 2, 3),
    g AS (SELECT t.contig, t.e, b.bin, coalesce(n, 0)::DOUBLE AS v FROM t CROSS JOIN generate_series(0, 13) b(bin) LEFT JOIN c ON c.contig = t.contig AND c.e = t.e AND c.bin = b.bin),
    s1 AS (SELECT *, avg(v) OVER (PARTITION BY contig, e ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v1 FROM g), s2 AS (SELECT *, avg(v1) OVER (PARTITION BY contig, e ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v2 FROM s1)
    SELECT contig, e AS "end", bin::INT AS bin, round(v2 / max(v2) OVER (PARTITION BY contig, e), 6) AS density FROM s2""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return S.density(overhangs(s, d)).withColumn("density", F.round("density", 6))


@query(
    "coverage_tally",
    PREFIX + """, ev AS (SELECT rname AS contig, pos::BIGINT AS p, 1 AS d FROM calls WHERE flag & 260 = 0 UNION ALL SELECT rname, aln_end + 1, -1 FROM calls WHERE flag & 260 = 0), st AS (SELECT contig, p, sum(d) AS d FROM ev GROUP BY 1, 2)
    SELECT contig, p AS pos, (sum(d) OVER (PARTITION BY contig ORDER BY p))::BIGINT AS depth FROM st""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = calls(s, d).where(F.col("flag").bitwiseAND(260) == 0)
    return S.coverage(rows.select(F.col("rname").alias("contig"), F.col("pos").cast("long").alias("first"), F.col("aln_end").alias("last")))


# --- ranking and extension ------------------------------------------------------------------------------------------
_BAND = """cand AS (SELECT *, (best - net_gain) // greatest(10, floor(0.05::DOUBLE * best)::BIGINT) AS band FROM (SELECT *, max(net_gain) OVER (PARTITION BY contig, "end") AS best FROM overhangs WHERE net_gain >= 1)),
rk AS (SELECT *, row_number() OVER (PARTITION BY contig, "end" ORDER BY band, clip_length - net_gain, net_gain DESC, clip_length DESC, pos, qname) AS rank FROM cand)"""
_BEST = PREFIX + ",\n" + _BAND + f""",
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, "end" ORDER BY band, clip_length - net_gain, net_gain DESC, clip_length DESC, pos, qname) AS r FROM cand WHERE NOT {run_sql("clip_seq", RUN)}) WHERE r = 1),
pl AS (SELECT c.contig, c.contig_ord, c.contig_length, l.qname AS left_read, r.qname AS right_read, coalesce(l.clip_seq, '') AS lc, coalesce(r.clip_seq, '') AS rc,
    coalesce(l.clip_length, 0)::BIGINT AS left_clip_length, coalesce(l.net_gain, 0)::BIGINT AS left_net_gain, coalesce(l.trim, 0)::BIGINT AS left_trim, coalesce(r.clip_length, 0)::BIGINT AS right_clip_length, coalesce(r.net_gain, 0)::BIGINT AS right_net_gain, coalesce(r.trim, 0)::BIGINT AS right_trim
    FROM contigs c LEFT JOIN (SELECT * FROM win WHERE "end" = 'L') l USING (contig) LEFT JOIN (SELECT * FROM win WHERE "end" = 'R') r USING (contig)),
ap AS (SELECT *, CASE WHEN right_read IS NOT NULL AND length(r1) > length(w1) THEN r1 ELSE w1 END AS ext FROM (
    SELECT *, left(w1, greatest(length(w1) - right_trim, 0)) || rc AS r1 FROM (
        SELECT *, CASE WHEN left_read IS NOT NULL AND length(l1) > length(seq) THEN l1 ELSE seq END AS w1 FROM (SELECT pl.*, seq, lc || substr(seq, left_trim + 1) AS l1 FROM pl JOIN sequences USING (contig)))))
"""


@query("ranked_overhangs", PREFIX + ",\n" + _BAND + "\nSELECT contig, \"end\", qname, net_gain, clip_length, rank::INT AS rank FROM rk WHERE rank <= 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.ranked(overhangs(s, d)).where("rank <= 10").select("contig", "end", "qname", "net_gain", F.col("clip_length").cast("long"), "rank")


@query("best_overhang", PREFIX + ",\n" + _BAND + "\nSELECT contig, \"end\", qname, net_gain, clip_length, trim FROM rk WHERE rank = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.best(overhangs(s, d)).select("contig", "end", "qname", "net_gain", F.col("clip_length").cast("long"), "trim")


@query("best_overhang_homopolymer", _BEST + "SELECT contig, \"end\", qname, net_gain, clip_length, trim FROM win")
def _(s: SparkSession, d: str) -> DataFrame:
    return chosen(s, d).select("contig", "end", "qname", "net_gain", F.col("clip_length").cast("long"), "trim")


@query("homopolymer_reject", f"SELECT contig, \"end\", qname FROM overhangs WHERE {run_sql('clip_seq', RUN)}")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.rejected_homopolymers(overhangs(s, d), RUN).select("contig", "end", "qname")


@query("panel_topn", "SELECT contig, \"end\", qname, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY contig, \"end\" ORDER BY net_gain DESC, clip_length DESC, pos, qname) AS place FROM overhangs) WHERE place <= 25")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.top_reads(overhangs(s, d)).select("contig", "end", "qname", "place")


@query("extension_dry_run", _BEST + "SELECT contig, contig_ord, contig_length, left_read, right_read, left_net_gain, right_net_gain, left_trim, right_trim, contig_length + left_net_gain + right_net_gain AS final_length FROM pl")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.dry_run(planned(s, d))


@query("extension_applied", _BEST + "SELECT contig, length(seq)::BIGINT AS original_length, length(ext)::BIGINT AS final_length, (length(ext) - length(seq))::BIGINT AS net_gain, CASE WHEN length(w1) > length(seq) AND ext <> w1 THEN 'both' WHEN length(w1) > length(seq) THEN 'left' WHEN ext <> w1 THEN 'right' ELSE 'no' END AS status FROM ap")
def _(s: SparkSession, d: str) -> DataFrame:
    return applied(s, d).select("contig", "original_length", "final_length", "net_gain", "status")


@query("extended_sequences", _BEST + "SELECT contig, ext AS extended FROM ap")
def _(s: SparkSession, d: str) -> DataFrame:
    return applied(s, d).select("contig", "extended")


@query("extended_assembly_order", _BEST + "SELECT contig, contig_ord, ext AS seq FROM ap ORDER BY contig_ord")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.assembly(applied(s, d), contigs(s, d), sequences(s, d))


def _windows(source: str, column: str, halve: bool, upper: bool) -> str:
    w = f"least({WINDOW}, length({column}) // 2)" if halve else str(WINDOW)
    added = {"left": "length(w1) - length(seq)", "right": "length(ext) - length(w1)"}
    width = lambda side: w if halve else f"({w} + {added[side]})"
    cut = lambda side: f"upper({side}({column}, {width(side)}))" if upper else f"{side}({column}, {width(side)})"
    return " UNION ALL ".join(f"SELECT contig, '{e}' AS \"end\", ({width(side)})::INT AS \"window\", '{m}' AS motif, {count_sql(cut(side), p)} AS n FROM {source}" for e, side in (("L", "left"), ("R", "right")) for m, p in EXACT.items())


@query("terminal_motifs_pre", _windows("sequences", "seq", True, True))
def _(s: SparkSession, d: str) -> DataFrame:
    return X.terminal_counts(sequences(s, d), "seq", EXACT, WINDOW, True, True)


@query("terminal_motifs_post", _BEST + _windows("ap", "ext", False, False))
def _(s: SparkSession, d: str) -> DataFrame:
    return X.terminal_counts(applied(s, d), "extended", EXACT, WINDOW, False, False)


@query("motif_gain", _BEST + f", a AS ({_windows('ap', 'ext', False, False)}), b AS ({_windows('sequences', 'seq', True, True)}) SELECT contig, a.\"end\", motif, a.\"window\", coalesce(b.n, 0) AS pre, a.n AS post, a.n - coalesce(b.n, 0) AS gain FROM a LEFT JOIN b USING (contig, \"end\", motif)")
def _(s: SparkSession, d: str) -> DataFrame:
    after = X.terminal_counts(applied(s, d), "extended", EXACT, WINDOW, False, False)
    return X.motif_gain(X.terminal_counts(sequences(s, d), "seq", EXACT, WINDOW, True, True), after)


@query("overhang_log", "SELECT contig, contig_length, \"end\", qname AS read, pos AS aln_start, aln_end, gap AS gap_from_end, clip_length, net_gain::BIGINT AS overhang_length, anchor AS anchor_length FROM overhangs")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.overhang_log(overhangs(s, d)).withColumn("clip_length", F.col("clip_length").cast("long"))


@query(
    "report_summary",
    _BEST + """SELECT count(*) AS contigs, count(*) FILTER (left_net_gain > 0 OR right_net_gain > 0) AS contigs_extended, sum((left_net_gain > 0)::INT + (right_net_gain > 0)::INT)::BIGINT AS ends_extended, sum(left_net_gain + right_net_gain)::BIGINT AS net_gained,
    sum(left_trim + right_trim)::BIGINT AS trimmed, sum(left_clip_length + right_clip_length)::BIGINT AS grafted FROM pl""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return X.summary(planned(s, d))


@query(
    "insertion_columns",
    PREFIX + """, i AS (SELECT contig, "end" AS e, pos + string_split(regexp_extract(cigar, '([0-9]+M)3I', 1), 'M')[1]::BIGINT - 1 AS off, 3 AS deepest FROM overhangs WHERE cigar LIKE '%3I%')
    SELECT contig, e AS "end", off::BIGINT AS off, unnest(generate_series(0::BIGINT, max(deepest)::BIGINT))::BIGINT AS ins FROM i GROUP BY contig, e, off""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return X.insertion_columns(X.placed_insertions(overhangs(s, d)))


@query(
    "placed_bases",
    PREFIX + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, "end" ORDER BY net_gain DESC, clip_length DESC, pos, qname) AS place FROM overhangs) WHERE place <= 25),
    wide AS (SELECT *, greatest(1, least(contig_length, 2000, greatest(500, max(anchor) OVER (PARTITION BY contig, "end")))) AS span, CASE WHEN "end" = 'L' THEN 1 ELSE contig_length END AS origin FROM top),
    cut AS (SELECT *, """ + NUMBERS + """ AS n, """ + LETTERS + """ AS o, CASE WHEN "end" = 'L' THEN origin ELSE origin - span + 1 END AS lo, CASE WHEN "end" = 'L' THEN origin + span - 1 ELSE origin END AS hi FROM wide),
    op AS (SELECT *, n[k] AS len, o[k] AS letter,
        coalesce(list_sum(list_transform(list_filter(list_zip(n, o)[1:k - 1], lambda z: z[2] IN ('M', 'I', 'S', '=', 'X')), lambda z: z[1])), 0)::BIGINT AS rd,
        pos + coalesce(list_sum(list_transform(list_filter(list_zip(n, o)[1:k - 1], lambda z: z[2] IN ('M', 'D', 'N', '=', 'X')), lambda z: z[1])), 0)::BIGINT AS rf
        FROM (SELECT *, unnest(generate_series(1, len(n))) AS k FROM cut)),
    step AS (SELECT *, unnest(generate_series(0::BIGINT, len - 1)) AS j FROM op)
    SELECT contig, "end", qname, pos, rf + j - origin AS off, 0 AS ins, substr(seq, rd + j + 1, 1) AS base, 'anchor' AS kind FROM step WHERE letter IN ('M', '=', 'X') AND rf + j BETWEEN lo AND hi
    UNION ALL SELECT contig, "end", qname, pos, rf - 1 - origin, (j + 1)::INT, substr(seq, rd + j + 1, 1), 'anchor' FROM step WHERE letter = 'I' AND rf - 1 BETWEEN lo AND hi
    UNION ALL SELECT contig, "end", qname, pos, (CASE WHEN "end" = 'L' THEN pos - origin - length(clip_seq) ELSE aln_end - origin + 1 END + i)::BIGINT, 0, substr(clip_seq, i + 1, 1), 'clip' FROM (SELECT *, unnest(generate_series(0::BIGINT, length(clip_seq) - 1)) AS i FROM cut)""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return layout.cells(X.top_reads(overhangs(s, d)))


# --- decay model ----------------------------------------------------------------------------------------------------
@query("decay_fixed", "WITH p AS (SELECT x FROM generate_series(0::BIGINT, 9999::BIGINT) t(x)) SELECT x, round(least(x + 1, 8000) / 8000.0::DOUBLE, 9) AS c FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    return decay.relative_coverage(s.range(10_000).withColumnRenamed("id", "x"), decay.Fixed(8000.0)).select("x", F.round("c", 9).alias("c"))


LENGTHS, CUTOFF, NODES = decay.Lognormal(8000.0, 4000.0), 5000.0, 8192
KEPT = LENGTHS.survival(CUTOFF)
UPPER = decay.upper_end(10_000.0, LENGTHS, CUTOFF)


def cdf_sql(x: str) -> str:
    """DuckDB has no error function either: the same series."""
    steps = f"list_concat([1.0::DOUBLE], list_transform(range({decay.TERMS}, 0, -1), lambda k: (2 * k + 1)::DOUBLE))"
    return f"(SELECT 0.5 + z * list_reduce({steps}, lambda acc, k: 1.0 + z * z / k * acc) * exp(-z * z / 2.0) / sqrt(2.0 * pi()) FROM (SELECT least(greatest({x}, -{decay.FAR}), {decay.FAR})::DOUBLE AS z))"


def survival_sql(t: str, lengths: decay.Lognormal = LENGTHS) -> str:
    return f"CASE WHEN {t} <= 0 THEN 1.0 ELSE {cdf_sql(f'({lengths.mu!r}::DOUBLE - ln({t})) / {lengths.sigma!r}::DOUBLE')} END"


def partial_sql(t: str, lengths: decay.Lognormal = LENGTHS) -> str:
    return f"{lengths.mean!r} * {cdf_sql(f'({lengths.mu!r}::DOUBLE + {lengths.sigma!r}::DOUBLE ** 2 - ln({t})) / {lengths.sigma!r}::DOUBLE')}"


def family_sql(panel: str, series: str, lengths: decay.Lognormal | decay.Fixed, cutoff: float, share: float) -> str:
    """One curve of decay_families over p (x, a = x + 1)."""
    kept, part = lengths.survival(cutoff), lengths.partial(cutoff)
    if isinstance(lengths, decay.Fixed):
        inside = f"least(a, {lengths.length!r}::DOUBLE)"
    else:
        inside = f"({part!r}::DOUBLE - {partial_sql('a', lengths)} + a * {survival_sql('a', lengths)}) / {kept!r}::DOUBLE"
    return f"SELECT '{panel}' AS panel, '{series}' AS series, x, round({share!r}::DOUBLE * CASE WHEN a <= {cutoff!r} THEN a ELSE {inside} END / ({part / kept!r}::DOUBLE), 8) AS y FROM p"


@query(
    "decay_lognormal",
    f"""WITH p AS (SELECT x, x + 1.0::DOUBLE AS a FROM generate_series(0::BIGINT, 9999::BIGINT) t(x)),
    q AS (SELECT x, a, {survival_sql("a")} AS s, {partial_sql("a")} AS e FROM p)
    SELECT x, round(CASE WHEN a <= {CUTOFF} THEN a ELSE ({LENGTHS.partial(CUTOFF)!r}::DOUBLE - e + a * s) / {KEPT!r}::DOUBLE END / ({LENGTHS.partial(CUTOFF)!r}::DOUBLE / {KEPT!r}::DOUBLE), 8) AS c FROM q""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return decay.relative_coverage(s.range(10_000).withColumnRenamed("id", "x"), LENGTHS, CUTOFF).select("x", F.round("c", 8).alias("c"))


@query(
    "decay_quadrature",
    f"""WITH g AS (SELECT k * ({UPPER!r}::DOUBLE / {NODES - 1}) AS t FROM generate_series(0::BIGINT, {NODES - 1}::BIGINT) n(k) UNION SELECT x + 1.0::DOUBLE FROM generate_series(0::BIGINT, 9999::BIGINT) p(x) UNION SELECT {CUTOFF!r}::DOUBLE),
    s AS (SELECT t, CASE WHEN t < {CUTOFF} THEN 1.0 ELSE {survival_sql("t")} / {KEPT!r}::DOUBLE END AS s FROM g),
    a AS (SELECT t, coalesce((t - lag(t) OVER w) * (s + lag(s) OVER w) / 2.0, 0.0) AS area FROM s WINDOW w AS (ORDER BY t)),
    c AS (SELECT t, sum(area) OVER (ORDER BY t) AS upto, sum(area) OVER () AS whole FROM a)
    SELECT x, round(upto / whole, 8) AS c FROM generate_series(0::BIGINT, 9999::BIGINT) p(x) JOIN c ON t = x + 1.0::DOUBLE""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return decay.quadrature_coverage(s.range(10_000).withColumnRenamed("id", "x"), LENGTHS, CUTOFF, NODES).select("x", F.round("c", 8).alias("c"))


FAMILIES = [(panel, f"cutoff {c:g}", figures.LIBRARY, c, figures.retained(figures.LIBRARY, c) if panel == "b" else 1.0) for panel in "ab" for c in figures.CUTOFFS]
FAMILIES += [("c", name, lengths, figures.CUTOFF, 1.0) for name, lengths in figures.OTHERS.items()]


@query(
    "decay_families",
    f"WITH p AS (SELECT k * {figures.FAR!r}::DOUBLE / {figures.POINTS - 1} AS x, x + 1.0::DOUBLE AS a FROM generate_series(0::BIGINT, {figures.POINTS - 1}::BIGINT) n(k)) " + " UNION ALL ".join(family_sql(*f) for f in FAMILIES),
)
def _(s: SparkSession, d: str) -> DataFrame:
    return figures.decay_families(s).withColumn("y", F.round("y", 8))


@query("decay_simulated")
def _(s: SparkSession, d: str) -> DataFrame:
    return decay.simulated(s, 1_000_000, 30.0, decay.Lognormal(8000.0, 4000.0), 10_000, 2500.0, seed=7)


@query("decay_bootstrap")
def _(s: SparkSession, d: str) -> DataFrame:
    return decay.bootstrap(s, 1_000_000, 30.0, decay.Lognormal(8000.0, 4000.0), 3_000, 2500.0, reps=10, seed=7)
