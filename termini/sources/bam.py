"""BAM as a Python data source: `spark.dataSource.register(BamSource)`, then `spark.read.format("bam").load(path)`.

With an index beside the file (x.bam.bai or x.bai) a file is read in splits of about `split_bytes`: the index names places
where records begin, and these are where splits begin. The option `contigs` (a comma list) then reads only the parts of the
file that hold alignments of these contigs. Without an index a file is one partition, and `contigs` filters rows only.
Records stream, so memory is bounded by one compressed block and one record.

line_no is a record's virtual offset, which rises in file order. Paths may be URIs that pyarrow knows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, line_no long"
SPLIT_BYTES, READ_BYTES, BLOCK_MOST = 64 << 20, 1 << 20, 65_536
STATISTICS_BIN = 37_450  # holds counts, no places


def opened(path: str) -> BinaryIO:
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def exists(path: str) -> bool:
    try:
        opened(path).close()
    except OSError:
        return False
    return True


def index_of(path: str) -> str | None:
    """The index beside a BAM file."""
    return next((p for p in (f"{path}.bai", path.removesuffix(".bam") + ".bai") if exists(p)), None)


class Blocks:
    """The uncompressed stream of a BGZF file from a virtual offset on; knows the virtual offset of its next byte."""

    def __init__(self, file: BinaryIO, start: int = 0) -> None:
        self.file, self.block, self.next_block = file, start >> 16, start >> 16
        self.data, self.at, self.raw = b"", 0, b""
        file.seek(start >> 16)
        if start & 0xFFFF:
            self._load()
            self.at = start & 0xFFFF

    def _load(self) -> bool:
        """Inflates the next block that is not empty."""
        while True:
            if len(self.raw) < BLOCK_MOST:
                self.raw += self.file.read(READ_BYTES)
            if not self.raw:
                return False
            unpack = zlib.decompressobj(31)
            data = unpack.decompress(self.raw)
            if not unpack.eof:
                raise ValueError("the file ends inside a block")
            size = len(self.raw) - len(unpack.unused_data)
            self.raw = unpack.unused_data
            self.block, self.next_block = self.next_block, self.next_block + size
            if data:
                self.data, self.at = data, 0
                return True

    def tell(self) -> int:
        return self.next_block << 16 if self.at >= len(self.data) else self.block << 16 | self.at

    def take(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        if self.at + n <= len(self.data):
            self.at += n
            return self.data[self.at - n : self.at]
        parts = [self.data[self.at :]]
        n -= len(parts[0])
        self.at = len(self.data)
        while n and self._load():
            parts.append(self.data[:n])
            self.at = len(parts[-1])
            n -= self.at
        return b"".join(parts)

    def integer(self) -> int | None:
        data = self.take(4)
        return struct.unpack("<i", data)[0] if len(data) == 4 else None


def header(source: Blocks, path: str) -> list[str]:
    """The contigs' names; the source then stands at the first record."""
    if source.take(4) != b"BAM\1":
        raise ValueError(f"{path} is not BAM")
    source.take(source.integer() or 0)
    names = []
    for _ in range(source.integer() or 0):
        names.append(source.take(source.integer() or 0)[:-1].decode())
        source.take(4)
    return names


@dataclass
class Index:
    """Places of a BAM index: where records begin, and each contig's first and last place (None: no alignment)."""

    starts: list[int]
    ranges: list[tuple[int, int] | None]


def read_index(path: str) -> Index:
    with opened(path) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path} is not a BAM index")
    at = 4

    def numbers(form: str) -> tuple:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))

    starts: set[int] = set()
    ranges: list[tuple[int, int] | None] = []
    for _ in range(numbers("<i")[0]):
        low, high = None, 0
        for _ in range(numbers("<i")[0]):
            number, n = numbers("<Ii")
            places = numbers(f"<{2 * n}Q")
            if number != STATISTICS_BIN and n:
                starts.update(places[::2])
                low, high = min(places[::2]) if low is None else min(low, *places[::2]), max(high, *places[1::2])
        starts.update(x for x in numbers(f"<{numbers('<i')[0]}Q") if x)
        ranges.append(None if low is None else (low, high))
    return Index(sorted(starts), ranges)


@dataclass
class Split(InputPartition):
    """Records that begin at virtual offsets from `start` (None: behind the header) up to `stop` (None: the end)."""

    path: str
    start: int | None
    stop: int | None


def splits(path: str, split_bytes: int = SPLIT_BYTES, contigs: list[str] | None = None) -> list[Split]:
    found = index_of(path)
    if found is None:
        return [Split(path, None, None)]
    index = read_index(found)
    with opened(path) as f:
        source = Blocks(f)
        names = header(source, path)
        first = source.tell()
    spans: list[tuple[int, int | None]] = [(first, None)]
    if contigs is not None:  # a contig without alignments has no place
        spans = sorted(r for name, r in zip(names, index.ranges, strict=False) if name in contigs and r)
    out = []
    for low, high in spans:
        at = low
        for start in index.starts:
            if low < start and (high is None or start < high) and (start >> 16) - (at >> 16) >= split_bytes:
                out.append(Split(path, at, start))
                at = start
        out.append(Split(path, at, high))
    return out


def records(split: Split) -> Iterator[tuple]:
    with opened(split.path) as f:
        source = Blocks(f)
        names = header(source, split.path)
        if split.start is not None:
            source = Blocks(f, split.start)
        while True:
            place = source.tell()
            if split.stop is not None and place >= split.stop:
                return
            size = source.integer()
            if size is None:
                return
            data = source.take(size)
            if len(data) < size:
                raise ValueError(f"{split.path} ends inside a record")
            ref, pos, name, mapq, _, n_ops, flag, length = struct.unpack_from("<iiBBHHHi", data)
            at = 32 + name
            ops = struct.unpack_from(f"<{n_ops}I", data, at)
            at += 4 * n_ops
            seq = data[at : at + (length + 1) // 2].hex().translate(_LETTERS)[:length]
            cigar = "".join([f"{x >> 4}{OPS[x & 15]}" for x in ops if x & 15 < len(OPS)])
            yield (data[32 : 32 + name - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", seq, place)


_LETTERS = str.maketrans("0123456789abcdef", BASES)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        wanted = self.options.get("contigs")
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), None if wanted is None else wanted.split(","))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, contigs: list[str] | None) -> None:
        self.paths = [path] if "://" in path else sorted(glob(path)) or [path]
        self.split_bytes, self.contigs = split_bytes, contigs

    def partitions(self) -> list[InputPartition]:
        found = [s for p in self.paths for s in splits(p, self.split_bytes, self.contigs)]
        return found or [Split(self.paths[0], 0, 0)]  # no place at all: a split without records

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = records(partition)
        return rows if self.contigs is None else (r for r in rows if r[2] in self.contigs)
