"""SimHash near-duplicates by a Gray-order hierarchical index.

1. Fingerprints: XXH64 of all word shingles, repeats included, then a majority for each bit.
2. Equal fingerprints collapse to one row before anything is compared, so copies cost nothing more.
3. Two fingerprints with at most D differing bits agree wholly on B - D of B blocks of bits. For each choice of such blocks
   (a table), fingerprints meet those with equal bits there. Any link is found in some table, whatever B: with more
   fingerprints B grows (blocks_for), since wider keys hold fewer chance neighbours; the links are the same.
4. Inside a task, the fingerprints of a key are sorted by Gray rank, so neighbours share many bits. Each FAN of them become
   a node: the bits they all share (mask and pattern); nodes form upper nodes in the same way. The index is joined with
   itself from the top: the bits in which two nodes' shared patterns differ are differences of all pairs below them, so a
   pair of whole groups goes as soon as they add up to more than D. Pairs of groups that are already known to be one
   component go too: a task gives a spanning forest, not all pairs.
5. A key with more than HOT fingerprints is dealt to several tasks: its fingerprints fall into tiles, and each pair of
   tiles is a key of its own. No pair is lost.
6. Components: large-star and small-star rounds on the distributed edges until nothing changes.

Null or empty text: no words, fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is
the shingle. Null doc_id: the row has a fingerprint and component; null only becomes a component_id where no other id is in
the component. Repeated rows: each keeps its row. An empty table gives no rows. Extra columns are not carried."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, fresh_path, give_back, made, same, stored, unused, whole_text

WORDS, D, FAN, HOT, SEED = 4, 4, 8, 4096, 42
PAIR_COST = 1 / 32  # of a pair under one key, whole groups of which are pruned, against a row dealt to its key
FLUSH, FRONTIER = 100_000, 400_000
SMALL = 1_000_000  # rows of two numbers: 16 MB sent, some 60 MB as a hash table


def _majorities(hashes: list[int], ends: list[int]) -> np.ndarray:
    """The fingerprint of each run of hashes (runs end at ends, none is empty)."""
    sums, sizes, low = [], np.diff([0, *ends]), 0
    bits = np.unpackbits(np.array(hashes, ">u8").view("u1").reshape(-1, 8), axis=1)
    for high in ends:
        sums.append(bits[low:high].sum(axis=0, dtype="u4"))
        low = high
    return np.packbits(2 * np.array(sums) > sizes[:, None], axis=1).view(">u8").ravel().astype("u8")


def fingerprints_of(texts: list[str], words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each whole text."""
    from xxhash import xxh64_intdigest as digest

    out, owner, hashes, ends = np.zeros(len(texts), "u8"), [], [], []
    for k, text in enumerate(texts):
        found = text.encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
        if not found:
            continue
        line = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(line, SEED))
        else:
            stops = np.cumsum([len(w) + 1 for w in found])
            starts = [0, *stops[:-words].tolist()]
            hashes += [digest(line[a:b], SEED) for a, b in zip(starts, (stops[words - 1 :] - 1).tolist(), strict=True)]
        owner.append(k)
        ends.append(len(hashes))
        if len(hashes) > FLUSH:
            out[owner] = _majorities(hashes, ends)
            owner, hashes, ends = [], [], []
    if owner:
        out[owner] = _majorities(hashes, ends)
    return out


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fp (the 64 bits as a signed long) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                fp = fingerprints_of(batch.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp.view("i8"))], ["doc_id", "text_hash", "fp"])
        give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_hash")).mapInArrow(hashed, f"doc_id {kind}, text_hash long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code's order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _runs(key: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


class _Forest:
    """Component labels of rows, as links become known."""

    def __init__(self, label: np.ndarray) -> None:
        self.label = label

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins rows a with rows b; the places of the links that joined two components."""
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        used = []
        for k, (x, y) in enumerate(zip(self.label[a].tolist(), self.label[b].tolist(), strict=True)):
            x, y = top(x), top(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                used.append(k)
        if parent:
            change = np.arange(self.label.max() + 1)
            for x in parent:
                change[x] = top(x)
            self.label = change[self.label]
        return np.array(used, "i8")


def linked(key: np.ndarray, fp: np.ndarray, most: int = D) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: fingerprint pairs within most bits that connect, for each key, all that such pairs connect."""
    first = _runs(key) if len(key) else np.zeros(0, "i8")
    size = np.diff(np.append(first, len(key)))
    keep = np.repeat(size > 1, size)
    key, fp = key[keep], fp[keep]
    if not len(key):
        return fp, fp
    order = np.lexsort((gray_rank(fp), key))
    key, fp = key[order], fp[order]

    near = (key[1:] == key[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= most)  # neighbours in the Gray order
    forest = _Forest(np.concatenate([[0], np.cumsum(~near)]))
    out = [(fp[:-1][near], fp[1:][near])]

    # levels of the index, the fingerprints themselves first
    levels = [(key, fp, np.full(len(fp), ~np.uint64(0)), np.arange(len(fp) + 1))]
    while True:
        k, pattern, mask, _ = levels[-1]
        first = _runs(k)
        size = np.diff(np.append(first, len(k)))
        if (size == 1).all() and len(levels) > 1:
            break
        begin = np.flatnonzero((np.arange(len(k)) - np.repeat(first, size)) % FAN == 0)
        every, some = np.bitwise_and.reduceat(pattern, begin), np.bitwise_or.reduceat(pattern, begin)
        shared = np.bitwise_and.reduceat(mask, begin) & ~(every ^ some)
        levels.append((k[begin], every & shared, shared, np.append(begin, len(k))))

    def spans() -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and the greatest label below each node of each level."""
        lows = [(forest.label, forest.label)]
        for *_, begin in levels[1:]:
            a, b = lows[-1]
            lows.append((np.minimum.reduceat(a, begin[:-1]), np.maximum.reduceat(b, begin[:-1])))
        return lows

    known = spans()
    tops = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, tops, tops)]
    while stack:
        at, a, b = stack.pop()
        low, high = known[at]
        alive = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[alive], b[alive]
        if len(a) > FRONTIER // FAN:
            half = len(a) // 2
            stack += [(at, a[half:], b[half:]), (at, a[:half], b[:half])]
            continue
        if not len(a):
            continue
        begin = levels[at][3]
        na, nb = begin[a + 1] - begin[a], begin[b + 1] - begin[b]
        total = na * nb
        which = np.repeat(np.arange(len(a)), total)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
        x, y = begin[a][which] + inner // nb[which], begin[b][which] + inner % nb[which]
        at -= 1
        keep = (x < y) if at == 0 else (x <= y)
        x, y = x[keep], y[keep]
        _, pattern, mask, _ = levels[at]
        near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= most
        x, y = x[near], y[near]
        if at:
            stack.append((at, x, y))
        elif len(x):
            used = forest.add(x, y)
            if len(used):
                out.append((fp[x[used]], fp[y[used]]))
                known = spans()
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


def blocks_for(n: int, most: int = D) -> int:
    """The number of blocks that costs least for n fingerprints: rows dealt to keys, and pairs that agree on a key by chance."""
    cost = lambda b: comb(b, most) * (n + PAIR_COST * n * n / 2.0 ** (64 * (b - most) // b) / 2)
    return min(range(most + 2, most + 9), key=cost)


def _tables(most: int, blocks: int) -> list[int]:
    """The bit masks: for each choice of blocks - most blocks, their bits."""
    cut = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]
    masks = [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, most: int = D, blocks: int | None = None) -> DataFrame:
    """Edges (u, v), u < v, between the distinct fingerprints (column fp): they connect what links within most bits do."""
    tables = _tables(most, blocks or blocks_for(distinct.count(), most))
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(tables)])
    keyed = distinct.select(F.explode(keys).alias("key"), "fp")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    counted = stored(counted, "hot-keys")
    small = counted.count() <= 100_000  # checked before it is broadcast; else an ordinary join
    tiled = keyed.join(F.broadcast(counted) if small else counted, "key", "left")
    tiles = F.ceil(F.col("n") / (HOT // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), tiles).cast("int")
    other = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.xxhash64("key", F.least(t, mine), F.greatest(t, mine)))
    # a tile meets itself wherever it meets another one
    keys = F.when(F.col("n").isNull(), F.array("key")).otherwise(F.array_except(other, F.array(F.xxhash64("key", mine, mine))))
    tiled = tiled.select(F.explode(keys).alias("key"), "fp")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, "i8"), np.zeros(0, "u8")
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view("u8")])
            done = int(_runs(key)[-1]) if len(key) else 0  # the last key may go on
            u, v = linked(key[:done], fp[:done], most)
            key, fp = key[done:], fp[done:]
            yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], ["u", "v"])
        u, v = linked(key, fp, most)
        yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], ["u", "v"])

    edges = tiled.repartition("key").sortWithinPartitions("key").mapInArrow(joined, "u long, v long")
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for each node of the edges (u, v), u < v. Alternating star rounds;
    each is stored in the shared folder, and what the round before stored is deleted."""
    spark = edges.sparkSession
    size = None
    now = edges
    since = made()
    while True:
        path = fresh_path(spark, "edges")
        now.write.parquet(path)
        clear(spark, since, (path,))
        now = spark.read.parquet(path)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == size:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        size = sign
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b")
        now = small.select(F.col("a").alias("u"), F.col("b").alias("v")).union(least.select(F.col("m").alias("u"), "v")).distinct()


def clustered(documents: DataFrame, words: int = WORDS, most: int = D) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint of the component, the same for all its rows) and component_id of each row."""
    spark = documents.sparkSession
    hashed = stored(fingerprints(documents, words), "fingerprints")
    path, since = fresh_path(spark, "places"), made()
    reps = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(reps.select("fp"), most))
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked_reps = stored(roots.join(reps, roots["node"] == reps["fp"]).select("fp", "root", "rep"), "linked")
    least = stored(linked_reps.groupBy("root").agg(F.min("rep").alias("component_id")), "roots")
    moved = linked_reps.join(least, "root").select("fp", "root", "component_id")
    reps.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id")).write.parquet(path)
    clear(spark, since)
    return hashed.join(spark.read.parquet(path), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def op6(documents: DataFrame) -> DataFrame:
    rows = clustered(documents)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, words: int = WORDS, most: int = D) -> DataFrame:
    """documents without all but one row of each component: a row with the smallest doc_id (null last), of those the one with
    the smallest text hash. All columns stay. Only rows that fingerprints link are copies: different texts stay under one
    doc_id, and without one, unless their component has another row to stay."""
    rows = stored(clustered(documents, words, most).select("root", "doc_id", "text_hash"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    keep = stored(rows.groupBy("root").agg(first), "kept")
    chosen = same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = rows.join(keep, "root").withColumn("chosen", chosen)
    gone, text = unused(documents, "__drop"), unused(documents, "__text")
    # the rows to drop: copies are fewer than documents
    drop = stored(marked.where(~F.col("chosen")).select(F.col("doc_id").alias(gone), F.col("text_hash").alias(text)).distinct(), "dropped")
    if drop.count() <= SMALL:  # checked before it is broadcast; else an ordinary join, which shuffles the texts once
        drop = F.broadcast(drop)
    key = F.xxhash64(whole_text())
    kept = documents.join(drop, same(F.col("doc_id"), F.col(gone)) & (key == F.col(text)), "left_anti")
    if marked.where("chosen").groupBy("root").count().where("count > 1").limit(1).count():  # the chosen row itself is repeated
        kept = kept.withColumn(text, key).dropDuplicates(["doc_id", text]).drop(text)
    return kept
