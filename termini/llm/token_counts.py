"""Exact token counts of every prefix by dynamic programming over byte-level BPE.

For BPE the encoding of a prefix is the encoding of a shorter prefix plus one last token, and which token is last is
unique: a token may follow another if merging the two strings together would leave both whole. So one pass over a
pre-token gives, for each end i, the last token and count[i] = count[i - len(token)] + 1. Whether a may precede b follows
from the symbols that stand at a's right edge and b's left edge while each is being merged: no pair of them may have a
merge that comes before either symbol is merged away.

A text is cut into parts whose encoding does not depend on their left (chunks.py); counts of parts add up, and the prefix
that ends inside a part is that part's own prefix. Inside a part only three things change when a prefix ends: a run of
white space is one pre-token as long as nothing follows it, a contraction is cut into its letters, and the beginning of a
special string is ordinary text. Each has its own step; every other prefix takes its count from its pre-token's one pass,
so the table of a text costs time linear in its length. Truncation and budget questions are look-ups in a stored table
(fits, truncate, chars_within): nothing is encoded again.

Null text: 0 bytes, 0 tokens. Empty text: 0. Repeated rows: counted each. An empty table gives no rows. Extra columns are
not carried."""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import chunks
from .common import whole_text

LIMIT = 1024
KEPT, LONG, BLOCK = 800_000, 63, 512  # LONG characters have 252 tokens at most, so their counts fit in bytes
# Fixed value: the public pre-tokenization pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 62

_counters: dict[str, "PrefixCounter"] = {}


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 characters stand for themselves, the others follow
    from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        tokens = [plain(t) for t in spec["model"]["vocab"] if t not in set(self.special)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(plain(a), plain(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = tokens
        self.ends = ahocorasick.Automaton()  # which tokens end at a place; bytes as the letters of the same numbers
        for number, token in enumerate(tokens):
            self.ends.add_word(token.decode("latin-1"), (number, len(token)))
        self.ends.make_automaton()
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}  # first token's number * tokens + second's
        self.pieces: dict[str, bytes] = {}
        self.tables: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "PrefixCounter":
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def _edge(self, number: int) -> tuple | None:
        """The symbols at the left and the right edge while a token is merged, each with the rank of the merge that ends it;
        None if merging the token's bytes does not give the token."""
        if number in self.edges:
            return self.edges[number]
        token = self.tokens[number]
        symbols, left, right = [token[i : i + 1] for i in range(len(token))], [], []
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == NEVER:
                break
            if at == 0:
                left.append((symbols[0], best))
            if at == len(symbols) - 2:
                right.append((symbols[-1], best))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        found = (left + [(token, NEVER)], right + [(token, NEVER)]) if symbols == [token] else None
        self.edges[number] = found
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        """Do the tokens a and b, side by side, encode as these two? Of equal merges the left one comes first."""
        right = self._edge(b)
        known = right is not None
        if known:
            for x, x_end in self._edge(a)[1]:
                for y, y_end in right[0]:
                    r = self.rank.get((x, y), NEVER)
                    if r < x_end and r <= y_end and r != NEVER:
                        known = False
        if len(self.pairs) > 4 * KEPT:
            self.pairs.clear()
        self.pairs[a * len(self.tokens) + b] = known
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """The token count of every prefix (in bytes) of one pre-token, the empty one first."""
        count, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        pairs, size = self.pairs, len(self.tokens)
        for at, (token, length) in self.ends.iter(piece.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue  # the last token is known; there is only one
            start = end - length
            if start:
                a = last[start]
                ok = pairs.get(a * size + token)
                if not (self._may_follow(a, token) if ok is None else ok):
                    continue
            elif not self._edge(token):
                continue
            count[end], last[end] = count[start] + 1, token
        if -1 in last[1:]:
            raise ValueError(f"no token ends at a byte of {piece[:80]!r}")
        return count

    def _piece(self, piece: str) -> bytes | list[int]:
        """The token count of every prefix (in characters) of one pre-token, the empty one left out."""
        known = self.pieces.get(piece)
        if known is None:
            data = piece.encode()
            counts = self.piece_counts(data)
            known = counts[1:] if len(data) == len(piece) else [counts[k] for k in np.cumsum([len(c.encode()) for c in piece]).tolist()]
            if len(piece) <= LONG:
                known = bytes(known)
                if len(self.pieces) >= KEPT:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _plain(self, part: str) -> list[int]:
        """The counts of all prefixes but the empty one of a part that holds no special string."""
        out: list[int] = []
        base = 0
        run, run_base = "", 0  # the white space just before, and the count before it
        for piece in self.split.findall(part):
            counts = self._piece(piece)
            first = piece[0]
            white = 0
            if first.isspace():  # white space at a prefix's end is one pre-token with all white space before it
                white = len(piece) - len(piece.lstrip())
                if not run:
                    run_base = base
                run += piece[:white]
                out += [run_base + n for n in self._piece(run)[len(run) - white :]]
            if white < len(piece):
                run = ""
                if first == "'" and len(piece) > 1 and piece[1].isalpha():  # a contraction, not whole before its end
                    out += [base + sum(self._piece(x)[-1] for x in self.split.findall(piece[:k])) for k in range(1, len(piece))]
                    out.append(base + counts[-1])
                elif base:
                    out += [base + n for n in counts[white:]]
                else:
                    out += counts[white:]
            base += counts[-1]
        return out

    def _part(self, part: str) -> list[int]:
        """The counts of all prefixes of a part but the empty one."""
        if not self.cut or not self.cut.search(part):
            return self._plain(part)
        out: list[int] = []
        base, bits = 0, self.cut.split(part)
        for k in range(0, len(bits), 2):
            special = bits[k + 1] if k + 1 < len(bits) else ""
            counts = self._plain(bits[k] + special[:-1])  # a special string counts as one only when it is whole
            out += [base + n for n in counts]
            base += counts[len(bits[k]) - 1] if bits[k] else 0
            if special:
                base += 1
                out.append(base)
        return out

    def _table(self, part: str) -> bytes:
        """_part as bytes, kept; for parts of LONG characters at most."""
        known = self.tables.get(part)
        if known is None:
            known = bytes(self._part(part))
            if len(self.tables) >= KEPT:
                self.tables.clear()
            self.tables[part] = known
        return known

    def prefix_table(self, text: str) -> np.ndarray:
        """table[i] is the exact token count of text[:i], for every i from 0 to len(text)."""
        parts = chunks(text)
        if not parts or max(map(len, parts)) <= LONG:
            tables = self.tables
            found = [tables.get(p) or self._table(p) for p in parts]
            inside = np.frombuffer(b"".join(found), "u1")
            totals, sizes = [x[-1] for x in found], list(map(len, found))
        else:
            arrays = [np.frombuffer(self._table(p), "u1") if len(p) <= LONG else np.array(self._part(p), "i8") for p in parts]
            inside = np.concatenate(arrays)
            totals, sizes = [int(x[-1]) for x in arrays], [len(x) for x in arrays]
        table = np.zeros(len(text) + 1, "i8")
        if parts:
            before = np.concatenate([[0], np.cumsum(totals[:-1], dtype="i8")])
            np.add(inside, np.repeat(before, sizes), out=table[1:])
        return table

    def count(self, text: str) -> int:
        return int(self.prefix_table(text)[-1])


def chars_within(table: np.ndarray, budget: int) -> int:
    """The length of the longest prefix with a count of budget at most; a longer prefix may have fewer tokens."""
    return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


def fits(table: np.ndarray, budget: int) -> bool:
    return int(table[-1]) <= budget


def truncate(text: str, table: np.ndarray, budget: int) -> str:
    """The longest prefix of the text with a count of budget at most."""
    return text[: chars_within(table, budget)]


def packed(table: np.ndarray) -> bytes:
    """A table as bytes: the steps from prefix to prefix, as one signed byte each where they fit."""
    steps = np.diff(table)
    kind = "<i1" if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else "<i8"
    return kind[1:].encode() + steps.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The inverse of packed."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(data, f"<{data[:2].decode()}", offset=2), dtype="i8")])


def prefix_tables(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and prefix_table (packed) of each row: stored once, it answers every later budget."""

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.at(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                tables = [packed(counter.prefix_table(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tables, pa.binary())], ["doc_id", "prefix_table"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole_text().alias("text")).mapInArrow(tabled, f"doc_id {kind}, prefix_table binary")


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and chars_within_limit (the code points of the longest prefix within the limit)
    of each row's whole text, all from its prefix table."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.at(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n, within, size = [], [], []
                for text in batch.column("text").to_pylist():
                    table = counter.prefix_table(text)
                    n.append(int(table[-1]))
                    within.append(chars_within(table, limit))
                    size.append(len(text.encode()))
                columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(within, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole_text().alias("text")).mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, chars_within_limit long")


op7 = token_counts
