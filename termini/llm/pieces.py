"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

A word is a run of U+2581 (the library's mark for a space) and what follows it; no piece holds a mark behind another
character, so no piece crosses words. Words of equal length advance together, one row each of a matrix. At each end
position, for each piece length, the rolling hash of the substring probes the sorted hashes of the pieces of that length
(found characters are compared, so a chance hit does no harm); scores of the ways to arrive there are compared by a
vectorised maximum, and its argument is the backpointer.

Unigram models add the pieces' log probabilities. For BPE models (the file at hand) a sum of scores is not what the library
maximises: there a piece may only follow another if merging the two strings together leaves both whole. That is a
condition on neighbours, so the same search finds the library's result, as the one path whose steps are all allowed.
Characters without a piece become byte pieces, as in the library.

Null text: empty, no ids, decodes to the empty text. A text's own U+2581 decodes to a space, as in the library. Repeated
rows are encoded each. Extra columns are not carried by op8. Normalisation other than identity is refused."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, whole_text

MARK = "▁"
KEPT, LONG, BLOCK, ROWS = 800_000, 64, 512, 4096  # KEPT: words in each of a worker's two generations, 160 MB each at most
KEPT_BESIDE_OTHERS = 200_000  # where a worker also holds what other operators keep
PAIRS, NEW = 2_000_000, 16_384  # verdicts kept in a worker, 9 bytes each; of them, in a dict until they are sorted in
FACTOR = 0x9E3779B97F4A7C15
NONE = -1

_models: dict[str, "Pieces"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """The pieces of a model file and the search over them."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, path: str) -> None:
        pieces, unigram, prefix, squeeze, rule = [], True, True, True, "identity"
        for field, value in _fields(open(path, "rb").read()):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0, piece.get(3, self.NORMAL)))
            elif field == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                spec = dict(_fields(value))
                rule, prefix, squeeze = spec.get(1, b"identity").decode(), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if rule != "identity" or squeeze:
            raise ValueError(f"normalisation {rule} is not supported")
        self._setup(pieces, unigram, prefix)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], unigram: bool, prefix: bool = True) -> "Pieces":
        """From (piece, score, type) rows; types as in the model file."""
        self = cls.__new__(cls)
        self._setup(pieces, unigram, prefix)
        return self

    @classmethod
    def at(cls, path: str, kept: int = KEPT) -> "Pieces":
        if path not in _models:
            _models[path] = cls(path)
        _models[path].kept = kept
        return _models[path]

    def _setup(self, pieces: list[tuple[str, float, int]], unigram: bool, prefix: bool) -> None:
        self.pieces, self.unigram, self.prefix = pieces, unigram, prefix
        self.score = {p: s for p, s, kind in pieces if kind == self.NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == self.BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == self.UNKNOWN)
        self.scores = np.array([s for _, s, _ in pieces])
        self.worst = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10.0
        by_size: dict[int, list[tuple[str, int]]] = {}
        for i, (p, _, kind) in enumerate(pieces):
            if kind == self.NORMAL:
                by_size.setdefault(len(p), []).append((p, i))
        self.tables = {}
        for size, rows in by_size.items():
            letters = np.array([[ord(c) for c in p] for p, _ in rows], "u8")
            key = self._prefixes(letters)[:, -1]
            order = np.argsort(key, kind="stable")
            self.tables[size] = (key[order], letters[order], np.array([i for _, i in rows])[order])
        self.power = np.array([pow(FACTOR, k, 1 << 64) for k in range(max(self.tables) + 1)], "u8")
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.pair, self.verdict = np.zeros(0, "i8"), np.zeros(0, bool)  # by pair
        self.new: dict[int, bool] = {}
        self.kept = KEPT
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _prefixes(letters: np.ndarray) -> np.ndarray:
        """Rolling hashes of all prefixes, the empty one first."""
        out = np.zeros((letters.shape[0], letters.shape[1] + 1), "u8")
        for k in range(letters.shape[1]):
            out[:, k + 1] = out[:, k] * np.uint64(FACTOR) + letters[:, k]
        return out

    def _merged(self, text: str, border: int) -> bool:
        """Does merging text, best score first, then leftmost, end with a symbol on either side of border and no other?"""
        score, symbols = self.score, list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        begin = list(range(len(text)))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            if 0 <= a and after[a] < len(text) and (s := symbols[a] + symbols[after[a]]) in score:
                heapq.heappush(queue, (-score[s], a, after[a], s))

        for k in range(len(text) - 1):
            offer(k)
        while queue:
            _, a, b, s = heapq.heappop(queue)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != s:
                continue
            if begin[a] < border <= begin[b]:
                return False  # a merge across the border
            symbols[a], symbols[b] = s, ""
            after[a] = after[b]
            if after[b] < len(text):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return sum(map(bool, symbols)) == 1 + (0 < border < len(text))

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """BPE: whether piece b may stand behind piece a, elementwise; a is NONE at a word's begin."""
        key = (a.astype("i8") + 1) * len(self.pieces) + b
        distinct, back = np.unique(key, return_inverse=True)
        found = np.zeros(len(distinct), bool)
        at = np.searchsorted(self.pair, distinct)
        seen = at < len(self.pair)
        seen[seen] = self.pair[at[seen]] == distinct[seen]
        found[seen] = self.verdict[at[seen]]
        for k in np.flatnonzero(~seen).tolist():
            x = int(distinct[k])
            ok = self.new.get(x)
            if ok is None:
                left, right = x // len(self.pieces) - 1, x % len(self.pieces)
                if self.unknown in (left, right):
                    ok = True  # characters without a piece never merge
                else:
                    head = self.pieces[left][0] if left >= 0 else ""
                    ok = self._merged(head + self.pieces[right][0], len(head))
                self.new[x] = ok
            found[k] = ok
        if len(self.new) > NEW:
            self._sort_in()
        return found[back]

    def _sort_in(self) -> None:
        """Moves new verdicts into the sorted arrays, which start afresh when full."""
        pair, verdict = np.fromiter(self.new, "i8", len(self.new)), np.fromiter(self.new.values(), bool, len(self.new))
        if len(self.pair) + len(pair) <= PAIRS:
            pair, verdict = np.concatenate([self.pair, pair]), np.concatenate([self.verdict, verdict])
        order = np.argsort(pair, kind="stable")
        self.pair, self.verdict, self.new = pair[order], verdict[order], {}

    def _search(self, words: list[str]) -> list[list[int]]:
        """The best pieces of words of one length, `unknown` for a character without a piece."""
        n, size = len(words), len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype("u8")
        hashes = self._prefixes(letters)
        score = np.full((size + 1, n), -np.inf)
        score[0] = 0.0
        piece, back = np.full((size + 1, n), NONE), np.zeros((size + 1, n), "i8")
        for end in range(1, size + 1):
            for length, (keys, spelt, ids) in self.tables.items():
                if length > end:
                    continue
                start = end - length
                part = hashes[:, end] - hashes[:, start] * self.power[length]
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                row = np.flatnonzero((keys[at] == part) & (score[start] > -np.inf))
                if length == 1:
                    alone = np.flatnonzero((keys[at] != part) & (score[start] > -np.inf))
                    self._arrive(score, piece, back, alone, start, end, np.full(len(alone), self.unknown))
                row = row[(spelt[at[row]] == letters[row, start:end]).all(axis=1)]
                if len(row):
                    self._arrive(score, piece, back, row, start, end, ids[at[row]])
        steps, place, word = [], np.full(n, size), np.arange(n)
        while place.any():  # all words walk back together; at place 0 a word stays there, without a piece
            steps.append(piece[place, word])
            place = back[place, word]
        return [[i for i in x if i != NONE] for x in np.array(steps[::-1]).T.tolist()]

    def _arrive(self, score: np.ndarray, piece: np.ndarray, back: np.ndarray, row: np.ndarray, start: int, end: int, ids: np.ndarray) -> None:
        """Takes the step to end where it is allowed and better than what is known."""
        if not self.unigram:
            ok = self._may_follow(piece[start, row], ids)
            row, ids = row[ok], ids[ok]
            value = np.zeros(len(row))  # one path only is allowed
        else:
            value = score[start, row] + np.where(ids == self.unknown, self.worst, self.scores[ids])
        better = value > score[end, row]
        row = row[better]
        score[end, row], piece[end, row], back[end, row] = value[better], ids[better], start

    def _parts(self, word: str) -> list[str]:
        """A long word, cut between characters that no piece joins."""
        if len(word) <= 24:
            return [word]
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: list[str]) -> None:
        parts = [self._parts(w) for w in words]
        by_size: dict[int, list[str]] = {}
        for part in set().union(*parts):
            by_size.setdefault(len(part), []).append(part)
        found: dict[str, bytes] = {}
        for group in by_size.values():
            for at in range(0, len(group), ROWS):
                some = group[at : at + ROWS]
                for part, ids in zip(some, self._search(some), strict=True):
                    out, k = [], 0
                    for i in ids:
                        if i == self.unknown:
                            out += [self.bytes[b] for b in part[k].encode()] if self.bytes else [i]
                            k += 1
                        else:
                            out.append(i)
                            k += len(self.pieces[i][0])
                    found[part] = array("I", out).tobytes()
        for word, cut in zip(words, parts, strict=True):
            self.words[word] = b"".join(map(found.__getitem__, cut))

    def split(self, text: str) -> list[str]:
        """The words of a text."""
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if MARK * 2 in text or "\0" in text:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)
        if "\n" not in self.score and not any("\n" in p for p in self.inside):
            text = text.replace("\n", "\0\n\0")
        return [w for w in text.replace(MARK, f"\0{MARK}").split("\0") if w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        split = [self.split(t) for t in texts]
        if len(self.words) > self.kept:  # words that do not come again are forgotten
            self.older, self.words = self.words, {}
        fresh = set().union(*split).difference(self.words)
        again = fresh.intersection(self.older)
        self.words.update((w, self.older[w]) for w in again)
        fresh = list(fresh - again)
        if fresh:
            self._learn(fresh)
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, x)), "<u4") for x in split]
        for word in fresh:
            if len(word) > LONG:
                del self.words[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become spaces, byte pieces bytes, and the prefix's space goes."""
        if not hasattr(self, "_spelt"):
            self._spelt = [bytes([int(p[3:5], 16)]) if kind == self.BYTE else p.replace(MARK, " ").encode() if kind == self.NORMAL else b"" for p, _, kind in self.pieces]
        text = b"".join(map(self._spelt.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encoded(documents: DataFrame, model_path: str, kept: int = KEPT_BESIDE_OTHERS) -> DataFrame:
    """doc_id, ids (array) and decoded (the text read back from the ids) of each row. A worker keeps the ids of `kept` words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.at(model_path, kept)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids = model.encode(batch.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                values = np.concatenate([*ids, np.zeros(0, "<u4")]).astype("i4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole_text().alias("text")).mapInArrow(rows, f"doc_id {kind}, ids array<int>, decoded string")


def op8(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian u32), n_decoded (code points) and round_trip: whether decoding
    gives the text back (its own U+2581 read as spaces)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.at(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                texts = batch.column("text").to_pylist()
                ids = model.encode(texts)
                back = [model.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        pa.array([len(x) for x in back], pa.int64()),
                        pa.array([a.replace(MARK, " ") == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "n_decoded", "round_trip"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole_text().alias("text")).mapInArrow(rows, f"doc_id {kind}, n_ids long, ids_crc32 long, n_decoded long, round_trip boolean")
