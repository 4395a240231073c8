import pytest
from test_engine import SAM, bam
from test_sources import bai

from termini import cli
from termini.report import extraction, html, layout, markdown, words
from termini.report.facts import Facts, Panel


def test_words():
    assert (words.integer(45120), words.delta(180), words.delta(0), words.delta(-12), words.decimal(1234.56)) == ("45,120", "+180", "-", "-12", "1,234.6")
    assert words.table(["a", "long"], [["1", "2"]], "rl") == "|   a | long |\n| --: | :--- |\n|   1 | 2    |"
    assert words.table(["a"], []) == ""
    with pytest.raises(ValueError):
        words.table(["a"], [["1", "2"]])
    with pytest.raises(ValueError):
        words.table(["a"], [["1"]], "x")
    assert words.bars([(0, 1, 4), (2, 3, 2)], 4) == "  0-1 | #### 4\n  2-3 | ##   2" and words.bars([]) == ""


READ = "contig string, end string, qname string, pos int, aln_end long, contig_length long, contig_ord int, anchor long, cigar string, seq string, clip_seq string, clip_length long, net_gain long, mapq int"


def test_cells(spark):
    rows = [("c", "L", "r", 2, 6, 10, 0, 4, "3S2M2I1D2M", "AAACCGGTT", "AAA", 3, 2, 60), ("c", "R", "q", 9, 10, 10, 0, 2, "2M2S", "TTAC", "AC", 2, 2, 60), ("c", "R", "empty", 9, 10, 10, 0, 2, "2M2S", "", "", 2, 2, 60)]
    placed = layout.cells(spark.createDataFrame(rows, READ), least=3, most_clip=1)
    got = {(r.qname, r.off, r.ins): r.base for r in placed.collect()}
    assert {k: v for k, v in got.items() if k[0] == "q"} == {("q", -1, 0): "T", ("q", 0, 0): "T", ("q", 1, 0): "A"}
    shared = [(r.off, r.ins) for r in layout.columns(placed).where("end = 'L'").orderBy("off", "ins").collect()]
    assert shared == sorted(shared) and (2, 2) in shared
    assert layout.ticks([(-20, 0), (0, 0), (0, 1), (20, 0)]) == [(0, "-20"), (1, "0"), (3, "+20")]
    assert layout.cells(spark.createDataFrame([], READ)).count() == 0


def test_runs_mark_motifs_and_escape():
    panel = Panel("c", "L", [(-3, 0), (-2, 0), (-1, 0), (0, 0), (0, 1), (1, 0)], [])
    bases = {(-3, 0): ("T", "clip"), (-2, 0): ("a", "clip"), (-1, 0): ("<", "clip"), (0, 0): ("G", "anchor"), (1, 0): ("G", "anchor")}
    assert html.runs(panel, bases, html.re.compile("TA", html.re.I)) == '<span class="motif">Ta</span><span class="clip">&lt;</span><span class="anchor">G</span>·<span class="anchor">G</span>'
    assert html.runs(panel, {}, None) == ""


def test_empty_reports():
    page = markdown.render(Facts([], {}, {}, {}, {}, []))
    assert page.startswith("# Contig extension report\n") and "## Extensions" not in page and "polished" not in page
    assert "<h2>Summary</h2>" in html.render(Facts([], {}, {}, {}, {}, [], dry_run=True), [])
    assert "Zero-overhang contigs: b" in extraction.render(4, {"unmapped": 1}, 1, 0, ["b"], 2)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.fasta").write_text(">c1\n" + "ACGT" * 250 + "\n")
    (tmp_path / "a.fasta.fai").write_text("c1\t1000\t3\t60\t61\nc2\t200\n")
    bam(tmp_path / "a.bam", [("r1", 0, 5, [(20, "S"), (120, "M")], "TTAGGG" * 3 + "AC" + "ACGT" * 30), ("r2", 0, 3, [(4, "S"), (110, "M")], "ACGT" + "C" * 110), ("r3", 0, 881, [(120, "M"), (7, "S")], "ACGT" * 30 + "CATCATC")])
    bai(tmp_path / "a.bam.bai", [(0, 1 << 40)], [])
    return tmp_path


def test_filter_command(spark, folder):
    assert cli.main(["filter", f"{folder}/a.sam", f"{folder}/out", "--ref-idx", f"{folder}/a.fasta.fai"], spark) == 0
    assert [r.value[:3] for r in spark.read.text(f"{folder}/out").collect()] == ["@HD", "r1\t"]
    assert cli.main(["filter", f"{folder}/a.bam", f"{folder}/no", "--ref-idx", f"{folder}/a.fasta.fai"], spark) == 1
    (folder / "b.sam").write_text("r1\t0\tnowhere\t1\t60\t9S120M\t*\t0\t0\t" + "A" * 129 + "\t*\n")
    assert cli.main(["filter", f"{folder}/b.sam", f"{folder}/no", "--ref-idx", f"{folder}/a.fasta.fai"], spark) == 1
    (folder / "c.sam").write_text("nothing\tto\tread\n")
    assert cli.main(["filter", f"{folder}/c.sam", f"{folder}/no", "--ref-idx", f"{folder}/a.fasta.fai"], spark) == 1


def test_extract_command(spark, folder):
    args = ["extract", f"{folder}/a.sam", "--ref-idx", f"{folder}/a.fasta.fai", "--extract-dir", f"{folder}/ends", "--report-stats", "--include-stats", "--prefix", "p"]
    assert cli.main(args, spark) == 0
    assert (folder / "ends/p_c1_L.fasta").read_text().splitlines()[:2] == [">r1 overhang_left_c1 mapq=60 clip_length=9 overhang_length=9", "a" * 9 + "A" * 71]
    assert "Zero-overhang contigs: c2" in (folder / "ends/p_stats.txt").read_text()


def test_extend_command(spark, folder):
    args = ["extend", f"{folder}/a.bam", f"{folder}/a.fasta", "--output-fasta", f"{folder}/new/x.fasta", "--stats-report", f"{folder}/x.md", "--html-report", f"{folder}/x.html", "--overhang-log", f"{folder}/log", "--count-motifs", "TTAGGG", "--screen-terminal-bases", "30"]
    assert cli.main(args, spark) == 0
    made = "".join((folder / "new/x.fasta").read_text().splitlines()[1:])
    assert made == "TTAGGG" * 3 + "AC" + ("ACGT" * 250)[4:] + "CATCATC"
    page = (folder / "x.md").read_text()
    assert "| c1     |       1,000 |    1,023 |      +16 |        +7 |       +23 | r1" in page and "c2 is in the index" in page
    assert "| c1     | left  | TTAGGG |        46 |   0 |    3 |   +3 |" in page
    shown = (folder / "x.html").read_text()
    assert '<span class="motif">TTAGGGTTAGGGTTAGGG</span>' in shown and shown.count("<svg") == 3
    assert len(spark.read.csv(f"{folder}/log", sep="\t", header=True).columns) == 10
    assert cli.main([*args[:3], "--dry-run", "--stats-report", f"{folder}/d.md", "--exclude-contigs", "c1"], spark) == 0
    dry = (folder / "d.md").read_text()
    assert "(dry run)" in dry and "user exclusion list" in dry and "Extensions That" not in dry
    assert cli.main([*args[:3], "--exclude-contigs", "nope"], spark) == 1
    assert '<span class="reference">' in shown and '<span class="edge">|</span>ACGTACGT' in shown
    (folder / "a.bam.bai").unlink()
    assert cli.main([*args[:3], "--dry-run"], spark) == 1


def test_flag_words():
    from termini.report.charts import flag_words, stacked

    assert flag_words("left_count", 4.25) == "left: more reads than other ends (score 4.2)"
    assert [y for _, y, _ in stacked([(0, 30, "aa"), (1, 30, "bb")])] == [22, 11]


def test_filter_from_standard_input_to_standard_output(spark, folder, monkeypatch, capsys, caplog):
    import io

    class Input:
        buffer = io.BytesIO(SAM.encode())

    monkeypatch.setattr("sys.stdin", Input)
    assert cli.main(["filter", "--ref-idx", f"{folder}/a.fasta.fai"], spark) == 0
    assert [line[:3] for line in capsys.readouterr().out.splitlines()] == ["@HD", "r1\t"]


def test_filter_tells_of_bad_lines_and_refuses_bytes_that_are_no_text(spark, folder, caplog):
    lines = ["r1\t0\tc1\t1\t60\t9S120M\t*\t0\t0\t" + "A" * 129 + "\t*", *[f"bad{k}\tx\tc1" + "\tz" * 60 for k in range(7)], "few\t0", "p\t0\tc1\tx\t60\t9S120M\t*\t0\t0\tA\t*"]
    (folder / "d.sam").write_text("\n".join(lines) + "\n")
    log = folder / "log.txt"
    assert cli.main(["filter", f"{folder}/d.sam", f"{folder}/d", "--ref-idx", f"{folder}/a.fasta.fai", "--logfile", str(log)], spark) == 0
    said = log.read_text()
    assert said.count("a line is skipped") == 5 and "FLAG is not an integer: x" in said and "not listed" in said and "alignments read: 10" in said and "removed, malformed: 9" in said
    assert all(len(x) < 250 for x in said.splitlines()) and "c1: 1 left, 0 right" in said
    (folder / "e.sam").write_bytes(b"@HD\tVN:1.6\n" + lines[0].encode() + b"\nr2\t\xff\xfe\x80\tc1\n")
    assert cli.main(["filter", f"{folder}/e.sam", f"{folder}/e", "--ref-idx", f"{folder}/a.fasta.fai"], spark) == 1
    assert not (folder / "e").exists()


def test_reference_row_and_terminus():
    shared = [(-2, 0), (-1, 0), (0, 0), (0, 1), (1, 0), (2, 0)]
    assert layout.reference_row("ACG", "L", shared) == "  A-CG" and layout.terminus("L", shared) == 2
    assert layout.reference_row("ACG", "R", shared) == "ACG-  " and layout.terminus("R", shared) == 4
    assert layout.reference_row("", "R", shared) == " " * 6 and layout.terminus("L", [(5, 0)]) == 0


def test_output_folder_that_cannot_be_made(spark, folder):
    (folder / "file").write_text("x")
    assert cli.main(["extend", f"{folder}/a.bam", f"{folder}/a.fasta", "--output-fasta", f"{folder}/file/x.fasta"], spark) == 1
