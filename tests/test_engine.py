import struct
import zlib

import pytest
from pyspark.sql import functions as F

from termini.functions import cigar as C
from termini.functions import motifs as M
from termini.model import decay, figures
from termini.operators import classify as K
from termini.operators import extend as X
from termini.operators import stats as S
from termini.plans import catalogue
from termini.sinks import files
from termini.sources import formats, text
from termini.streaming.sam import stream_classified, stream_lines

SF = "/root/testdata/sf0.001"
ROW = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string"


def test_cigar_table(spark):
    cases = {"": (0, 0, 0, 0), "*": (0, 0, 0, 0), "100S": (0, 0, 100, 0), "10S100M5I20D3N7=2X8S": (132, 109, 10, 8), "15H20S30M40=20X10S5H": (90, 90, 0, 0)}
    ops = C.operations(F.col("c"))
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", C.reference_span(ops), C.anchor(ops), C.left_clip(ops), C.right_clip(ops)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == cases


def classified(spark, rows, **limits):
    contigs = spark.createDataFrame([("c1", 1000, 0)], "contig string, contig_length long, contig_ord int")
    return {r.qname: r for r in K.classify(spark.createDataFrame(rows, ROW), contigs, K.Limits(**limits)).collect()}


def test_boundaries(spark):
    seq = "A" * 400
    rows = [
        ("at_break", 0, "c1", 51, 60, "60S120M", seq), ("past_break", 0, "c1", 52, 60, "60S120M", seq), ("min_clip", 0, "c1", 51, 60, "51S120M", seq), ("short_clip", 0, "c1", 51, 60, "50S120M", seq),
        ("anchor", 0, "c1", 1, 60, "9S100M", seq), ("low_anchor", 0, "c1", 1, 60, "9S99M", seq), ("hard", 0, "c1", 1, 60, "9S100M5H", seq), ("both", 0, "c1", 1, 60, "9S1000M9S", seq), ("beyond", 0, "c1", 950, 60, "120M5S", seq),
    ]
    got = {k: r.bucket for k, r in classified(spark, rows).items()}
    assert got == {"at_break": "kept", "past_break": "max_break", "min_clip": "kept", "short_clip": "min_clip", "anchor": "kept", "low_anchor": "min_anchor", "hard": "no_clip", "both": "kept", "beyond": "kept"}


def test_motifs():
    assert M.fuzzy_pattern("TTAGGG") == "(T{1,3}AG{2,4})"
    assert M.with_complements(["TTAGGG"]) == ["CCCTAA", "TTAGGG"]
    assert M.parse_motifs(" ttaggg, NNA,TTAGGG") == (["TTAGGG"], ["NNA"])
    with pytest.raises(M.MotifError):
        M.parse_filter_motifs("ttaggg")


def test_repeats_do_not_overflow(spark):
    df = spark.createDataFrame([("TTAGGG" * 5000,)], "s string")
    assert df.select(M.present(F.col("s"), M.patterns(["TTAGGG"], fuzzy=True), 3), M.count(F.col("s"), M.fuzzy_pattern("TTAGGG"))).first() == (True, 5000)


def test_homopolymer_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("aaaAC",), ("AAAC",)], "s string")
    assert [r[0] for r in df.select(M.has_homopolymer(F.col("s"), 4)).collect()] == [True, False]


def test_modified_z(spark):
    values = [("c%d" % k, "flat", 5.0) for k in range(5)] + [("c%d" % k, "one", 1.0 if k else 101.0) for k in range(5)]
    got = {(r.contig, r.measure): r.z for r in S.modified_z(spark.createDataFrame(values, "contig string, measure string, value double")).collect()}
    assert got["c0", "flat"] == 0 and got["c0", "one"] == pytest.approx(100 / (1.253314 * 20)) and got["c1", "one"] == 0


def test_ranking_prefers_less_trimming_within_the_band(spark):
    rows = [("c", "R", "a", 10, 142, 129, "A" * 142), ("c", "R", "b", 10, 128, 128, "CG" * 64)]
    df = spark.createDataFrame(rows, "contig string, end string, qname string, pos int, clip_length long, net_gain long, clip_seq string")
    assert X.best(df).first().qname == "b"
    assert X.best(df, max_homopolymer=143).first().qname == "b" and X.best(df.where("qname = 'a'"), max_homopolymer=142).count() == 0


def test_extension_invariants(spark):
    rows = catalogue.applied(spark, SF).collect()
    assert rows and all(r.final_length == r.original_length + r.net_gain >= r.original_length == catalogue_length(r.contig) for r in rows)


def catalogue_length(contig):
    return 500 + 37 * int(contig[3:])


def test_buckets_sum_to_rows(spark):
    assert sum(r.n for r in catalogue.QUERIES["filter_buckets"](spark, SF).collect()) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_model(spark):
    lengths, cutoff = decay.Lognormal(8000.0, 4000.0), 5000.0
    points = spark.createDataFrame([(float(x),) for x in (0, 1, 17.5, 4095, 4999, 5000, 8000, 30_000, 1e6)], "x double")
    grid = decay.quadrature_coverage(points, lengths, cutoff)
    exact = decay.relative_coverage(grid.select("x", F.col("c").alias("q")), lengths, cutoff)
    assert exact.where(F.abs(F.col("q") - F.col("c")) < 2e-5).count() == 9
    fixed = decay.relative_coverage(decay.quadrature_coverage(spark.range(1200).withColumnRenamed("id", "x"), decay.Fixed(1000.0), nodes=3001, upper=1500.0).withColumnRenamed("c", "q"), decay.Fixed(1000.0))
    assert fixed.where(F.abs(F.col("q") - F.col("c")) < 1e-3).count() == 1200
    z = [k / 4 for k in range(-60, 61)]
    found = spark.createDataFrame([(v,) for v in z], "z double").select("z", decay.normal_cdf_column(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(decay.normal_cdf(r.z), abs=2e-15) for r in found)
    with pytest.raises(decay.CutoffError):
        decay.relative_coverage(grid, decay.Fixed(100.0), 200.0)
    band = decay.bootstrap(spark, 100_000, 30.0, decay.Fixed(1000.0), 1500, reps=8, seed=3).where("x between 200 and 1200").agg(F.avg(F.abs(F.col("mean") - F.col("analytic")))).first()[0]
    assert band < 0.1


SAM = "@HD\tVN:1.6\n" + "\n".join(["r1\t0\tc1\t1\t60\t9S120M\t*\t0\t0\t" + "A" * 129 + "\t*", "", "bad\tx\tc1", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*", "r3\t0\tc1\tx\t0\t9S120M\t*\t0\t0\tA\t*"]) + "\n"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.fai").write_text("c1\t1000\t3\t60\t61\nc2 200\n")
    (tmp_path / "a.fasta").write_text(">c1 first\nACGT\nacgt\n>c2\nGG\n")
    headers, rows = text.read_sam(spark, str(tmp_path / "a.sam"))
    assert headers.count() == 1 and {r.qname: r.malformed for r in rows.collect()} == {"r1": False, "bad": True, "r2": False, "r3": False}
    contigs = text.read_fai(spark, str(tmp_path / "a.fai"))
    assert [tuple(r) for r in contigs.orderBy("contig_ord").collect()] == [("c1", 1000, 1), ("c2", 200, 2)]
    fasta = text.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert {r.contig: r.seq for r in fasta.collect()} == {"c1": "ACGTacgt", "c2": "GG"}
    assert files.write_fasta(fasta.join(contigs, "contig"), str(tmp_path / "out.fasta")) == 2
    assert (tmp_path / "out.fasta").read_text() == ">c1\nACGTacgt\n>c2\nGG\n"
    reads = spark.createDataFrame([("c1", "L", "r1 x", "ACGT" * 25)], "contig string, end string, header string, seq string")
    assert files.write_sequences(reads, str(tmp_path / "ends")) == {("c1", "L"): 1}
    assert (tmp_path / "ends/c1_L.fasta").read_text() == ">r1 x\n" + "ACGT" * 20 + "\n" + "ACGT" * 5 + "\n"
    with pytest.raises(text.ExclusionError):
        text.exclusions(spark, contigs, "nope")
    assert formats.sniff(SAM.encode()) == "sam" and formats.sniff(b"\x1f\x8b\x08") == "gzip" and formats.sniff(b"CRAM") == "cram"


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sam").write_text(SAM)
    contigs = spark.createDataFrame([("c1", 1000, 0)], "contig string, contig_length long, contig_ord int")
    query = stream_classified(stream_lines(spark, str(folder)), contigs).select("qname", "bucket").writeStream.format("memory").queryName("out").start()
    query.processAllAvailable()
    query.stop()
    assert {r.qname: r.bucket for r in spark.sql("select * from out").collect()} == {"r1": "kept", "r2": "unmapped", "r3": "malformed"}


def bam(path, reads):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    codes = "=ACMGRSVTWYHKDBN"
    for name, flag, pos, ops, seq in reads:
        packed = bytes((codes.index(seq[k]) << 4) | (codes.index(seq[k + 1]) if k + 1 < len(seq) else 0) for k in range(0, len(seq), 2))
        record = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", (n << 4) | "MIDNSHP=X".index(o)) for n, o in ops) + packed + b"\xff" * len(seq)
        body += struct.pack("<i", len(record)) + record
    out = b""
    for k in range(0, len(body), 50):
        squeeze = zlib.compressobj(wbits=31)
        out += squeeze.compress(body[k : k + 50]) + squeeze.flush()
    path.write_bytes(out)


def test_bam(spark, tmp_path):
    from termini.sources.bam import BamSource

    bam(tmp_path / "a.bam", [("r1", 0, 5, [(9, "S"), (5, "M")], "ACGTACGTACGTAC"), ("r2", 16, 7, [(3, "M")], "GGT")])
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").load(str(tmp_path / "a.bam")).orderBy("line_no").collect()
    assert [tuple(r)[:7] for r in rows] == [("r1", 0, "c1", 5, 60, "9S5M", "ACGTACGTACGTAC"), ("r2", 16, "c1", 7, 60, "3M", "GGT")]


def test_entry_without_the_corpus_part():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["filter_kept", "filter_buckets", "run_counters", "motif_presence_exact", "motif_presence_fuzzy", "motif_anywhere", "contig_end_counts", "extract_overhangs", "contig_stats", "best_overhang", "placed_bases", "coverage_tally"])
def test_a_cigar_is_taken_apart_once_for_each_scan(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("l_partkey#") and plan.count("Relation [")
    assert 1 <= plan.count("regexp_extract_all(") <= max(2, scans) and plan.count("regexp_extract_all(") <= 2


def test_ranking_and_quantiles_of_ties_and_hot_ends(spark):
    rows = [("c", "R", f"r{k % 3}", 10, 50, 40, "ACGT" * 12) for k in range(3000)] + [("c", "L", "one", 5, 9, 9, "ACGTACGTA")]
    df = spark.createDataFrame(rows, "contig string, end string, qname string, pos int, clip_length long, net_gain long, clip_seq string").repartition(7)
    assert {(r.end, r.qname, r.net_gain) for r in X.best(df).collect()} == {("R", "r0", 40), ("L", "one", 9)}
    assert {(r.end, r.depth, r.q2, r.longest, r.best_gain) for r in S.quantiles(df).collect()} == {("R", 3000, 50.0, 50, 40), ("L", 1, 9.0, 9, 9)}
    assert X.best(df.limit(0)).count() == 0 and S.quantiles(df.limit(0)).count() == 0


def test_coverage_across_bins(spark):
    intervals = [("c", 1, 10), ("c", 5, 25), ("c", 8, 8), ("d", 100, 300), ("c", 64, 64)]
    df = spark.createDataFrame(intervals, "contig string, first long, last long")
    for width in (1, 7, 65_536):
        for r in S.coverage(df, width).collect():
            assert r.depth == sum(c == r.contig and a <= r.pos <= b for c, a, b in intervals)


def test_extensions_are_validated(spark):
    size = "ACGTACGTAC"
    planned = [("a", 0, 10, "r", "TTTT", 4, 2, 2, None, "", 0, 0, 0), ("b", 1, 10, "r", "T", 1, -1, 2, "q", "GG", 2, 0, 2), ("c", 2, 10, None, "", 0, 0, 0, "q", "GGG", 3, 2, 1)]
    schema = "contig string, contig_ord int, contig_length long, left_read string, left_clip string, left_clip_length long, left_net_gain long, left_trim long, right_read string, right_clip string, right_clip_length long, right_net_gain long, right_trim long"
    plan = spark.createDataFrame(planned, schema)
    seqs = spark.createDataFrame([(c, size) for c in "abc"], "contig string, seq string")
    done = {r.contig: (r.extended, r.status) for r in X.apply_extensions(plan, seqs).collect()}
    assert done == {"a": ("TTTT" + size[2:], "left"), "b": (size, "no"), "c": (size[:-1] + "GGG", "right")}
    said = sorted(r.warning for r in X.extension_warnings(plan, seqs).collect())
    assert [w[:18] for w in said] == ["the left end of b ", "the right end of b"]
    check = lambda *a: spark.range(1).select(X.validated(*[F.lit(x) for x in a[:-1]], a[-1])).first()[0]
    assert check("ACGT", "GGACGT", "GG", 0, True) and not check("ACGT", "GGACG", "GG", 0, True) and not check("ACGT", "CGACGT", "GG", 0, True)
    assert check("ACGT", "ACGGGG", "GGG", 1, False) and not check("ACGT", "ACGG", "G", 1, False)


def test_read_slices(spark):
    df = spark.createDataFrame([("L", "ACGTAC"), ("R", "ACGTAC"), ("R", None), ("L", "A")], "end string, seq string")
    assert [tuple(r) for r in df.select(*K.read_slice(4)).collect()] == [("ACGT", 0), ("GTAC", 2), ("", 0), ("A", 0)]
    assert all(tuple(r) == ("", 0) for r in df.select(*K.read_slice(0)).collect())


def test_run_counters_sum_up(spark):
    rows = catalogue.calls(spark, SF)
    bad = spark.range(3)
    for patterns in (None, catalogue.EXACT):
        r = K.counters(rows, bad, patterns).first()
        gone = sum(r[f"excluded_{b}"] for b in K.BUCKETS) + r.excluded_motifs
        assert r.processed == rows.count() + 3 and r.removed == gone and r.processed == r.output + r.removed and r.excluded_malformed >= 3
        assert r.motif == (r.output if patterns else None)


def test_curves_of_the_figures(spark):
    rows = figures.decay_families(spark, points=71).collect()
    at = {(r.panel, r.series, round(r.x)): r.y for r in rows}
    assert len(rows) == len(at) == 71 * 11
    for c in figures.CUTOFFS:  # panel b is panel a times the share of bases kept
        share = figures.retained(figures.LIBRARY, c)
        assert 0 < share <= 1 and at["b", f"cutoff {c:g}", 9000] == pytest.approx(share * at["a", f"cutoff {c:g}", 9000])
    assert at["c", "fixed 15 Kbp", 7499 + 1] == pytest.approx(7501 / 15_000) and at["c", "fixed 15 Kbp", 20_000] == 1.0
    band = figures.decay_band(spark, reps=4, molecule=200_000, window=300).collect()
    assert len(band) == 300 and all(r.lo <= r.mean <= r.hi for r in band)
