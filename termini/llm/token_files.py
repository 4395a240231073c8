"""Token-id files: each document's ids are one zstandard frame, compressed with a dictionary that all documents share.

A folder holds `dictionary` (may be empty), one shard file for each task, in the order of doc_id, and `manifest.json`
with the dictionary's SHA-256, the end id and for each shard its file, rows, the ids before it and its first and last doc_id
(null: only documents without one). A shard is

    "TIDS" | width 2 or 4 | dictionary SHA-256 (32 bytes) | frames | index | index offset u64 | rows u64 | "TIDS"

where the index has doc_id i64, known u8 (0: doc_id is null), n_tokens u32 and the frame's offset u64 (rows + 1 of them),
each an array. A frame holds the ids as little-endian unsigned integers of the width. One document costs the index of the
shard whose range it falls in, and one frame (read_one). The folder is a URI that pyarrow knows; s3a:// is read as s3://.

Null text: empty, so its ids are the end id alone. doc_id must cast to long; null doc_id: sorted first, kept. Rows with equal doc_id: in the order
of their frames' hash. An empty table gives a folder without shards and no rows. Other columns are not written.

Tasks write under names of their own attempt and report them; only reported files enter the manifest, so a task that is
run again does no harm."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunks
from .common import delete, fresh_path, whole_text

MAGIC, HEADER, FOOTER = b"TIDS", 4 + 1 + 32, 8 + 8 + 4
END_ID = 2
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 512, 16_384, 65_536, 3
KEPT, LONG = 1_500_000, 64  # encodings kept in a worker; longer parts are not kept
BLOCK, LOT = 512, 16_384  # documents encoded at a time, characters of new parts in one text

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """ids of whole texts by the tokenizers library. Parts that recur are encoded once in a worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), "i8")  # the bytes that each id spells
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[number] = len(token)  # byte-level: a letter for each byte
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.sizes[number] = len(token.content.encode())
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [chunks(text) for text in texts]
        found = [list(map(self.known.get, x)) for x in parts]
        gaps = [not all(x) for x in found]  # a part has one id at least
        fresh = list({p for x, y, gap in zip(parts, found, gaps, strict=True) if gap for p, ids in zip(x, y, strict=True) if ids is None})
        learnt = self._ids(fresh)
        out = [b"".join([ids or learnt[p] for p, ids in zip(x, y, strict=True)] if gap else y) for x, y, gap in zip(parts, found, gaps, strict=True)]
        if len(self.known) + len(learnt) > KEPT:
            self.known.clear()
        self.known.update(learnt)
        for part in fresh:
            if len(part) > LONG:
                del self.known[part]
        return out

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part. Parts that chunks() would cut from one text are encoded as one text, whose ids fall to the
        parts by the bytes that they spell; should these not meet the parts' ends, each part is encoded alone."""
        out: dict[str, bytes] = {}
        lots, lot, size = [], [], 0
        for part in parts:
            if part[0] in " \n" and not part[-1].isspace():
                lot.append(part)
                size += len(part)
                if size > LOT:
                    lots.append(lot)
                    lot, size = [], 0
        lots.append(lot)
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast(list(map("".join, lots)), add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in lot], dtype="i8")
            reached = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[last] == ends).all():
                data, cuts = ids.tobytes(), [0, *((last + 1) * self.kind.itemsize).tolist()]
                out.update(zip(lot, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        rest = [p for p in parts if p not in out]
        for part, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[part] = np.array(found.ids, self.kind).tobytes()
        return out


def train_dictionary(documents: DataFrame, path: str) -> bytes:
    """A dictionary from about SAMPLE_DOCS documents, chosen by hash; of a text over SAMPLE_CHARS a piece of that length from
    a place chosen by hash, so that no more than these reach the driver. It only affects the size of the files. Empty where
    there is too little to train on."""
    import zstandard

    chance = min(1.0, SAMPLE_DOCS / max(documents.count(), 1))
    rows = documents.select(whole_text().alias("text"), F.xxhash64("doc_id", "text").alias("h")).where(F.pmod("h", F.lit(1 << 32)) < chance * (1 << 32))
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    rows = rows.select(F.substring("text", (F.pmod(F.shiftrightunsigned("h", 32), spare + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, Encoder.at(path).encode(sorted(r.text for r in rows.collect())), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _where(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> dict:
    """Writes all documents (doc_id, text) to folder; returns the manifest."""
    spark = documents.sparkSession
    dictionary = train_dictionary(documents, tokenizer_path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        pack = _codec(dictionary)[0]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
                frames = [pack.compress(x) for x in ids]
                size = encoder.kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // size for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in frames], pa.int64()), pa.array(frames, pa.binary())],
                    ["doc_id", "n_tokens", "tie", "frame"],
                )

    staged = fresh_path(spark, "frames")
    rows = documents.select("doc_id", whole_text().alias("text"))
    rows.mapInArrow(encoded, "doc_id long, n_tokens long, tie long, frame binary").write.parquet(staged)

    digest = hashlib.sha256(dictionary).digest()
    wide = Encoder.at(tokenizer_path).wide

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _where(folder)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        ids, known, counts, sizes = [], [], [], []
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/{name}") as out:
            out.write(MAGIC + bytes([4 if wide else 2]) + digest)
            for batch in batches:
                column = batch.column("doc_id")
                known.append(column.is_valid().to_numpy(zero_copy_only=False).astype("u1"))
                ids.append(column.fill_null(0).to_numpy().astype("<i8"))
                counts.append(batch.column("n_tokens").to_numpy().astype("<u4"))
                frames = batch.column("frame").to_pylist()
                sizes.append(np.array([len(x) for x in frames], "<u8"))
                out.write(b"".join(frames))
            if ids:
                offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(sizes), dtype="<u8")]) + np.uint64(HEADER)
                counts = np.concatenate(counts)
                for array in (np.concatenate(ids), np.concatenate(known), counts, offsets):
                    out.write(array.tobytes())
                out.write(struct.pack("<QQ", int(offsets[-1]), len(counts)) + MAGIC)
        if ids:
            mine = np.concatenate(ids)[np.concatenate(known).astype(bool)]
            ends = [pa.array([int(mine[k])] if len(mine) else [None], pa.int64()) for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([len(counts)]), pa.array([int(counts.sum(dtype="u8"))]), *ends], ["number", "file", "rows", "tokens", "first", "last"])
        else:
            files.delete_file(f"{top}/{name}")

    ordered = spark.read.parquet(staged).repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "frame").select("doc_id", "n_tokens", "frame")
    shards = ordered.mapInArrow(shard, "number long, file string, rows long, tokens long, first long, last long").collect()  # a row for each shard
    delete(spark, staged)
    before, entries = 0, []
    for row in sorted(shards, key=lambda r: r.number):
        entries.append({"file": row.file, "rows": row.rows, "before": before, "first": row["first"], "last": row["last"]})
        before += row.tokens
    manifest = {"dictionary": digest.hex(), "end_id": end_id, "tokens": before, "shards": entries}
    files, top = _where(folder)
    files.create_dir(top, recursive=True)
    for name, data in (("dictionary", dictionary), ("manifest.json", json.dumps(manifest).encode())):
        with files.open_output_stream(f"{top}/{name}") as out:
            out.write(data)
    return manifest


class Shard:
    """One open shard file."""

    def __init__(self, folder: str, entry: dict, dictionary: bytes) -> None:
        files, top = _where(folder)
        self.file = files.open_input_file(f"{top}/{entry['file']}")
        head = self.file.read_at(HEADER, 0)
        if head[:4] != MAGIC or head[5:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{entry['file']} was not written with this dictionary")
        self.kind = np.dtype(f"<u{head[4]}")
        at, n, magic = struct.unpack("<QQ4s", self.file.read_at(FOOTER, self.file.size() - FOOTER))
        if magic != MAGIC:
            raise ValueError(f"{entry['file']} is cut off")
        index = self.file.read_at(n * 21 + 8, at)
        self.doc_id = np.frombuffer(index, "<i8", n)
        self.known = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.n_tokens = np.frombuffer(index, "<u4", n, 9 * n)
        self.offset = np.frombuffer(index, "<u8", n + 1, 13 * n)
        self.start = entry["before"] + np.concatenate([[0], np.cumsum(self.n_tokens[:-1], dtype="i8")]) if n else self.doc_id
        self.unpack = _codec(dictionary)[1]

    def ids(self, k: int, frame: bytes | None = None) -> np.ndarray:
        """The ids of the k-th document of this shard."""
        a, b = int(self.offset[k]), int(self.offset[k + 1])
        frame = self.file.read_at(b - a, a) if frame is None else frame
        return np.frombuffer(self.unpack.decompress(frame), self.kind)


def _dictionary(folder: str) -> bytes:
    files, top = _where(folder)
    with files.open_input_stream(f"{top}/dictionary") as f:
        return f.read()


def read_manifest(folder: str) -> dict:
    files, top = _where(folder)
    with files.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def read_one(folder: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, end id included (of the first one with this id; None if there is none)."""
    dictionary = None
    for entry in read_manifest(folder)["shards"]:
        if entry["first"] is None or not entry["first"] <= doc_id <= entry["last"]:
            continue
        dictionary = _dictionary(folder) if dictionary is None else dictionary
        shard = Shard(folder, entry, dictionary)
        found = np.flatnonzero((shard.doc_id == doc_id) & shard.known)
        if len(found):
            return shard.ids(int(found[0]))
    return None


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    manifest, dictionary = read_manifest(folder), _dictionary(folder)
    entries = manifest["shards"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                shard = Shard(folder, entries[number], dictionary)
                n = len(shard.doc_id)
                for low in range(0, n, BLOCK):
                    high = min(n, low + BLOCK)
                    first = int(shard.offset[low])
                    block = memoryview(shard.file.read_at(int(shard.offset[high]) - first, first))
                    cut = [int(x) - first for x in shard.offset[low : high + 1]]
                    sums = [zlib.crc32(shard.ids(k, block[cut[k - low] : cut[k - low + 1]]).astype("<u4").tobytes()) for k in range(low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_id[low:high], mask=~shard.known[low:high]), pa.array(shard.start[low:high], pa.int64()), pa.array(shard.n_tokens[low:high].astype("i8")), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = len(entries)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = documents.sparkSession
    folder = fresh_path(spark, "token-files")
    write_token_files(documents, folder, tokenizer_path)
    return read_token_files(spark, folder)
