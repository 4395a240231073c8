"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words: only its positions are hashed, the others may be substituted. The hashes of all
windows of the benchmark items under all seeds, sorted, are broadcast; every task joins the hashes of all windows of its
documents with them (a bitmap of their upper bits first, then a search). Each hit fixes an item, a document and their
alignment; the aligned words are then compared one by one, and the overlap counts if some PASSAGE consecutive words (the
whole item, if shorter) agree in SHARE of their places.

Nothing that qualifies is missed: a passage of PASSAGE words with as many differing words as SHARE allows has a window of
some seed of SEEDS that misses them all, whatever their places. Items shorter than PASSAGE have seeds of their own
(short_seeds): their words fall into blocks, and for each choice of as many blocks as words may differ, a seed leaves these
out. Items under FEWEST words may differ nowhere: they are found where all their words stand in a row. tests/llm enumerate
all places and compare with brute force.

Items are worked through in blocks of BLOCK_WORDS words (about 100 MB, on the driver and in each worker), one pass over the
documents for each, so a benchmark of any size is searched whole with bounded memory. Hits are verified PAIRS at a time, so
repetitive texts take bounded memory too. Words are runs of letters, digits and _, in lower case.

Null or empty text: no words, no overlap, on either side. Repeated documents each give their rows; repeated items count
under each item_id. Empty tables give no rows; without items, decontaminated() keeps all documents. Extra columns are not
carried by overlaps() and all kept by decontaminated()."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, give_back, whole_text

SEEDS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 6, 9, 10))
PASSAGE, SHARE, FEWEST = 13, 0.8, 5
BLOCK_WORDS, BITS, PAIRS = 2_000_000, 22, 1_000_000

_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """The 64-bit hash of each word; forgets when it has grown large."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word.encode())
        return value


_hashes = _Hashes()


def _ids(text: str) -> np.ndarray:
    found = _WORD.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, found), "u8", len(found))


def _windows(ids: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The hash of the seed's positions in each window, a window for each place of the seed's first position."""
    n = len(ids) - (seed[-1] - seed[0])
    out = np.full(max(n, 0), np.uint64(0x9E3779B97F4A7C15 * (len(seed) + 16 * (seed[-1] - seed[0])) % (1 << 64)))
    for k, offset in enumerate(x - seed[0] for x in seed):
        out += ids[offset : offset + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64) | 1) if n > 0 else np.uint64(0)
    return out ^ (out >> np.uint64(29))


def short_seeds(n: int) -> list[tuple[int, ...]]:
    """Seeds for an item of n words, n < PASSAGE: any n - ceil(SHARE n) differing words (none under FEWEST) are in no place
    of some seed. The fewest blocks are taken that leave a seed as many places as those of SEEDS have, or all it can have."""
    spare = 0 if n < FEWEST else n - math.ceil(SHARE * n - 1e-9)
    for count in range(spare + 1, n + 1):
        cut = [n * k // count for k in range(count + 1)]
        left_out = [{x for k in chosen for x in range(cut[k], cut[k + 1])} for chosen in combinations(range(count), spare)]
        if n - max(map(len, left_out)) >= min(len(SEEDS[0]), n - spare):
            break
    return [tuple(x for x in range(n) if x not in out) for out in left_out]


class Items:
    """A block of benchmark items, their words in one line, and the sorted hashes of their windows with each window's place."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]) -> None:
        self.item_id = [i for i, _ in items]
        sizes = np.array([len(w) for _, w in items])
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype("i8")
        self.line = np.concatenate([*(w for _, w in items), np.zeros(0, "u8")])
        groups: dict[tuple[tuple[int, ...], bool], list[int]] = {}  # seed, short -> lengths of the items that it is for
        for n in sorted(set(sizes.tolist())):
            for seed in SEEDS if n >= PASSAGE else short_seeds(n):
                groups.setdefault((seed, n < PASSAGE), []).append(n)
        hashes, places = [np.zeros(0, "u8")], [np.zeros(0, "u4")]
        for (seed, short), lengths in groups.items():
            h = _windows(self.line, seed)
            place = np.arange(len(h))  # of the seed's first word
            item = np.searchsorted(self.first, place, "right") - 1
            fits = (place + seed[-1] - seed[0] < self.first[item + 1]) & np.isin(sizes[item], lengths)
            if short:  # a short item's seed stands at one place of its item
                fits &= place == self.first[item] + seed[0]
            hashes.append(h[fits])
            places.append(place[fits].astype("u4"))
        order = np.argsort(whole := np.concatenate(hashes), kind="stable")
        self.hash, self.place = whole[order], np.concatenate(places)[order]
        self.seeds = sorted({tuple(x - s[0] for x in s) for s, _ in groups})
        self.there = np.zeros(1 << BITS, bool)
        self.there[(self.hash >> np.uint64(64 - BITS)).astype("i8")] = True

    def overlaps(self, texts: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, share of equal words) of the best overlap of each pair that has one: the one of
        most words, then of most equal ones, then the first."""
        ids = [_ids(t) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i8")
        line = np.concatenate([*ids, np.zeros(0, "u8")])
        best: dict[tuple[int, int], tuple[int, float, int]] = {}
        held: list[np.ndarray] = []  # alignments: text, item, where the item's first word falls in line
        size = 0
        for seed in self.seeds:
            h = _windows(line, seed)
            place = np.flatnonzero(self.there[(h >> np.uint64(64 - BITS)).astype("i8")])
            low = np.searchsorted(self.hash, h[place])
            count = np.searchsorted(self.hash, h[place], "right") - low
            place, low, count = place[count > 0], low[count > 0], count[count > 0]
            upto = np.cumsum(count)
            at = 0
            while at < len(place):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                n = count[at:stop]
                for begin in range(0, int(n.max()), PAIRS):  # one window may have any number of items
                    part = np.minimum(n - begin, PAIRS).clip(0)
                    inner = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                    there = self.place[np.repeat(low[at:stop] + begin, part) + inner].astype("i8")
                    here = np.repeat(place[at:stop], part)
                    item = np.searchsorted(self.first, there, "right") - 1
                    held.append(np.unique(np.stack([np.searchsorted(first, here, "right") - 1, item, here - (there - self.first[item])]), axis=1))
                    size += held[-1].shape[1]
                    if size > PAIRS:
                        self._verify(held, line, first, best)
                        size = 0
                at = stop
        self._verify(held, line, first, best)
        return [(*k, -v[2], v[0], v[1]) for k, v in sorted(best.items())]

    def _verify(self, held: list[np.ndarray], line: np.ndarray, first: np.ndarray, best: dict[tuple[int, int], tuple[int, float, int]]) -> None:
        """Compares the aligned words of the held alignments and keeps the best overlaps."""
        found = np.unique(np.concatenate(held, axis=1), axis=1) if held else np.zeros((3, 0), "i8")
        held.clear()
        for text, item, start in found.T.tolist():
            w = self.line[self.first[item] : self.first[item + 1]]
            low, high = max(start, int(first[text])), min(start + len(w), int(first[text + 1]))
            size = min(PASSAGE, len(w))
            if high - low < size:
                continue
            need = size if size < FEWEST else math.ceil(SHARE * size - 1e-9)
            equal = (line[low:high] == w[low - start : high - start]).astype("i8")
            sums = np.concatenate([[0], np.cumsum(equal)])
            runs = np.flatnonzero(sums[size:] - sums[:-size] >= need)
            if len(runs):
                a, b = int(runs[0]), int(runs[-1]) + size
                value = (b - a, float(equal[a:b].mean()), int(first[text]) - low - a)
                if (text, item) not in best or value > best[text, item]:
                    best[text, item] = value


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, BLOCK_WORDS words at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", whole_text().alias("text")).toLocalIterator():
        words = _ids(row.text)
        if not len(words):
            continue
        held.append((row.item_id, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, matched: a row for each document row and item with an overlap."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, first_word long, n_words long, matched double"
    path = fresh_path(spark, "overlaps")
    out = None
    for number, block in enumerate(blocks(benchmark)):
        sent = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    found = items.overlaps(batch.column("text").to_pylist())
                    columns = list(zip(*found, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array([items.item_id[k] for k in columns[1]], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64())],
                        ["doc_id", "item_id", "first_word", "n_words", "matched"],
                    )

        found = documents.select("doc_id", whole_text().alias("text")).mapInArrow(searched, schema)
        if number:  # the block before waits to be written only if it was not the last
            out.write.mode("append").parquet(path)
        out = found
        written = number
    if out is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).union(out) if written else out


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows whose text overlaps an item; no row is shuffled."""
    for block in blocks(benchmark):
        documents = documents.where(_free_of(documents.sparkSession.sparkContext.broadcast(block))("text"))
    return documents


def _free_of(sent: Broadcast) -> Callable[..., Column]:
    """A predicate on texts: no overlap with the block of items."""

    @F.arrow_udf("boolean")
    def free(texts: pa.Array) -> pa.Array:
        ok = np.ones(len(texts), bool)
        for at in range(0, len(texts), 256):
            some = [t or "" for t in texts.slice(at, 256).to_pylist()]
            ok[[at + f[0] for f in sent.value.overlaps(some)]] = False
        give_back()
        return pa.array(ok)

    return free


op10 = overlaps
