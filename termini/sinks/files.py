"""Files in exact formats: SAM passthrough, FASTA, FASTQ for each contig end, the overhang log."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 80


def sam_lines(headers: DataFrame, kept: DataFrame) -> DataFrame:
    """value: headers, then kept lines, in input order."""
    rows = headers.select("line_no", "value", F.lit(0).alias("part")).unionByName(kept.select("line_no", "value", F.lit(1).alias("part")))
    return rows.orderBy("part", "line_no").select("value")


def write_sam(headers: DataFrame, kept: DataFrame, path: str) -> None:
    """The folder's part files read in name order."""
    sam_lines(headers, kept).write.text(path)


def print_sam(headers: DataFrame, kept: DataFrame, out: TextIO) -> None:
    """The lines to a stream, a partition at a time."""
    for row in sam_lines(headers, kept).toLocalIterator():
        out.write(row.value + "\n")


def wrapped(seq: str, width: int = WIDTH) -> str:
    return "\n".join(seq[k : k + width] for k in range(0, len(seq), width))


def write_fasta(assembly: DataFrame, path: str, width: int = 60) -> int:
    """contig, contig_ord, seq as one file in contig order, one contig in memory at a time; the number written."""
    n = 0
    with open(path, "w", buffering=1 << 20) as out:
        for row in assembly.select("contig", "seq", "contig_ord").orderBy("contig_ord").toLocalIterator():
            out.write(f">{row.contig}\n{wrapped(row.seq, width)}\n")
            n += 1
    return n


def sequence_file(folder: str, contig: str, end: str, fastq: bool = False, prefix: str | None = None) -> str:
    return os.path.join(folder, f"{prefix + '_' if prefix else ''}{contig}_{end}.{'fastq' if fastq else 'fasta'}")


def write_sequences(rows: DataFrame, folder: str, fastq: bool = False, prefix: str | None = None) -> dict[tuple[str, str], int]:
    """rows (contig, end, header, seq) as a file for each contig end; counts for each. Executors write, so the folder is a
    shared one. Rows are dealt by contig and end and stream from sorted partitions into one open file; a file is written
    under another name and put in place when complete, so a task that runs again does no harm."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, n, draft = None, None, 0, ""

        def done() -> pa.RecordBatch:
            out.close()
            os.replace(draft, sequence_file(folder, *now, fastq, prefix))
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([n], pa.int64())], ["contig", "end", "n"])

        os.makedirs(folder, exist_ok=True)
        try:
            for batch in batches:
                for contig, end, header, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (contig, end) != now:
                        if out:
                            yield done()
                        now, n = (contig, end), 0
                        draft = sequence_file(folder, contig, end, fastq, prefix) + f".{uuid.uuid4().hex}"
                        out = open(draft, "w")
                    if not seq or not header:
                        raise ValueError("empty sequence or name")
                    out.write(f"@{header}\n{seq}\n+\n{'I' * len(seq)}\n" if fastq else f">{header}\n{wrapped(seq)}\n")
                    n += 1
            if out:
                yield done()
        except BaseException:
            if out:
                out.close()
                if os.path.exists(draft):
                    os.remove(draft)
            raise

    order = ["line_no"] if "line_no" in rows.columns else []
    dealt = rows.repartition("contig", "end").sortWithinPartitions("contig", "end", *order).select("contig", "end", "header", "seq")
    done = dealt.mapInArrow(written, "contig string, end string, n long")
    return {(r.contig, r.end): r.n for r in done.collect()}  # a row for each contig end


def write_log(log: DataFrame, path: str) -> None:
    log.write.csv(path, sep="\t", header=True)
