import struct
import zlib

import pytest
from test_engine import bam

from termini.sinks import files
from termini.sources import formats
from termini.sources import bam as B


def bai(path, chunks, linear, empty=0):
    """An index of one contig with one bin, and `empty` contigs without alignments behind it."""
    body = b"BAI\1" + struct.pack("<i", 1 + empty) + struct.pack("<i", 2)
    body += struct.pack("<Ii", 4681, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    body += struct.pack("<Ii", B.STATISTICS_BIN, 2) + struct.pack("<QQQQ", 1, 2, 3, 4)
    body += struct.pack("<i", len(linear)) + b"".join(struct.pack("<Q", x) for x in linear)
    path.write_bytes(body + struct.pack("<ii", 0, 0) * empty)


@pytest.fixture
def many(tmp_path):
    reads = [(f"r{k}", 0, k + 1, [(5, "S"), (30, "M")], ("ACGT" * 9)[k % 4 : k % 4 + 35]) for k in range(200)]
    bam(tmp_path / "m.bam", reads)
    return tmp_path / "m.bam", reads


def rows(spark, path, **options):
    spark.dataSource.register(B.BamSource)
    return spark.read.format("bam").options(**options).load(str(path))


def test_splits_give_every_record_once(spark, many):
    path, reads = many
    whole = rows(spark, path)
    assert whole.rdd.getNumPartitions() == 1
    want = sorted(tuple(r) for r in whole.collect())
    starts = [r[-1] for r in sorted(want, key=lambda r: r[-1])]
    assert len(want) == 200 and len(set(starts)) == 200 and [r[0] for r in sorted(want, key=lambda r: r[-1])] == [r[0] for r in reads]
    bai(path.with_suffix(".bam.bai"), [(starts[0], starts[90]), (starts[90], 1 << 45)], [0, *starts[10:200:10]], empty=1)
    for size in (1, 500, 3000):
        found = rows(spark, path, split_bytes=size)
        assert found.rdd.getNumPartitions() > (1 if size < 3000 else 0) and sorted(tuple(r) for r in found.collect()) == want
    assert len(B.splits(str(path), 1)) >= 15


def test_contigs_read_their_part_only(spark, many):
    path, _ = many
    starts = sorted(r.line_no for r in rows(spark, path).collect())
    bai(path.with_suffix(".bam.bai"), [(starts[20], starts[60])], [], empty=1)
    part = B.splits(str(path), 1, ["c1"])
    assert part[0].start == starts[20] and part[-1].stop == starts[60]
    assert sorted(r.line_no for r in rows(spark, path, contigs="c1").collect()) == starts[20:60]
    assert rows(spark, path, contigs="nowhere").count() == 0


def test_cut_files_are_errors(spark, many):
    path, _ = many
    data = path.read_bytes()
    (path.parent / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside"):
        rows(spark, path.parent / "cut.bam").count()
    plain = zlib.compressobj(wbits=31)
    (path.parent / "no.bam").write_bytes(plain.compress(b"nothing of the kind") + plain.flush())
    with pytest.raises(Exception, match="is not BAM"):
        rows(spark, path.parent / "no.bam").count()


def test_indexed_files_are_checked_in_order(tmp_path):
    fasta, path = tmp_path / "a.fasta", tmp_path / "a.bam"

    def said():
        with pytest.raises(formats.InputFormatError) as e:
            formats.require_indexed(str(fasta), str(path))
        return str(e.value)

    assert said() == f"{fasta} does not exist"
    fasta.write_text(">c1\nACGT\n")
    assert said() == f"{path} does not exist"
    path.write_text("@HD\tVN:1.6\n")
    assert ".fai does not exist" in said()
    (tmp_path / "a.fasta.fai").write_text("c1\t4\n")
    assert "is not BAM but sam" in said()
    bam(path, [])
    assert ".bai does not exist" in said()
    bai(tmp_path / "a.bai", [], [])
    formats.require_indexed(str(fasta), str(path))


def test_sequences_stream_into_a_file_for_each_end(spark, tmp_path):
    data = [(f"c{k % 3}", "LR"[k % 2], f"r{k}", "ACGT" * (k % 30 + 1), k) for k in range(500)]
    df = spark.createDataFrame(data, "contig string, end string, header string, seq string, line_no long").repartition(5)
    counts = files.write_sequences(df, str(tmp_path / "out"), fastq=True, prefix="p")
    assert sum(counts.values()) == 500 and sorted(x.name for x in (tmp_path / "out").iterdir()) == sorted(f"p_{c}_{e}.fastq" for c, e in counts)
    want = [f"r{k}" for k in range(500) if k % 3 == 1 and k % 2 == 0]
    assert [x[1:] for x in (tmp_path / "out/p_c1_L.fastq").read_text().splitlines()[::4]] == want
    bad = spark.createDataFrame([("c9", "L", "r", "", 0)], df.schema)
    with pytest.raises(Exception, match="empty sequence"):
        files.write_sequences(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").iterdir()) and files.write_sequences(df.limit(0), str(tmp_path / "none")) == {}
