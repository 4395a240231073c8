"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is only observed: every turn prefix is rendered and
compared with the output of the prefix before it; what the longer output adds is the new turn's span. Where in its span a
turn's own text lies is observed too, by rendering the turn with two one-letter texts, which differ in that place only. A
template that changes earlier output when a turn is added (rewrites history) shows as an output that does not continue the
one before, whatever the turn. Places in what was rewritten are lost; those of the turns from the last rewriting turn on
are certain, and the loss mask holds the trained ones among them.

All prefixes are rendered whole, since a template may look back as far as it likes: a conversation costs the square of its
turns in characters copied. It is the unit that a template reads, so it stands in one task's memory.

Null text and null role are empty. Turns are ordered by turn (null first), then role, then text; repeated rows are turns of
their own. A row with a null conv_id belongs to no other row: it is a conversation of one turn, so that rows without an id
never meet in one task. An empty table gives no conversation but the probe's. Extra columns are not carried."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
LOST = (-1, -1)

# The control strings of public chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>")


def escaped(text: str) -> str:
    """text with each backslash doubled and a backslash inside each control string."""
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescaped(text: str) -> str:
    """The inverse of escaped: a backslash stands for the character behind it."""
    if "\\" not in text:
        return text
    out, k = [], 0
    while k < len(text):
        k += text[k] == "\\"
        out.append(text[k : k + 1])
        k += 1
    return "".join(out)


@lru_cache(maxsize=4096)
def _turn(role: str, text: str) -> str:
    return f"<|im_start|>{escaped(role)}\n{escaped(text)}<|im_end|>\n"


def turn_markup(turns: list[Turn]) -> str:
    """The template of the query: each turn as <|im_start|>role, line feed, text, <|im_end|>, line feed; contents escaped."""
    return "".join([_turn(role, text) for role, text in turns])


@dataclass
class Formatted:
    """The output, each turn's span and text span in it (code points; (-1, -1) where rewriting lost it), and the numbers of
    the turns whose arrival rewrote earlier output."""

    output: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewriting: list[int]

    @property
    def rewrites(self) -> bool:
        return bool(self.rewriting)

    def mask(self, roles: list[str], trained: str = "assistant") -> list[tuple[int, int]]:
        """The places under the loss mask."""
        return [t for t, role in zip(self.texts, roles, strict=True) if role == trained and t != LOST]


def _differ(a: str, b: str, low: int = 0) -> int:
    """The first place from low on where two strings differ."""
    high = min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.startswith(b[low:middle], low) else (low, middle - 1)
    return low


def formatted(turns: list[Turn], template: Template = turn_markup) -> Formatted:
    """Renders every prefix of a conversation and finds every turn's place in the whole."""
    spans: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    rewriting: list[int] = []
    before = template([])
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        # a text of one letter, rendered twice: head is what stands before the turn's text, tail what stands behind
        a, b = (template([*turns[:k], (role, letter)]) for letter in "ab")
        grows = after.startswith(before)
        head = _differ(a, b, len(before) if a.startswith(before) and b.startswith(before) else 0)
        text = (head, len(after) - (len(a) - head - 1))
        if not grows:
            rewriting.append(k)
            spans, texts = [LOST] * k, [LOST] * k
        spans.append((len(before), len(after)) if grows else text)
        # a text that the template does not show, or shows in several places, has no place of its own
        texts.append(text if len(a) == len(b) and a[head + 1 :] == b[head + 1 :] and head < len(a) and text[0] <= text[1] else LOST)
        before = after
    return Formatted(before, spans, texts, rewriting)


def parsed(output: str) -> list[Turn]:
    """The turns of an output of turn_markup; control strings only stand where the template put them."""
    turns = []
    for block in output.split("<|im_start|>")[1:]:
        role, _, text = block.removesuffix("<|im_end|>\n").partition("\n")
        turns.append((unescaped(role), unescaped(text)))
    return turns


def conversations_in_order(conversations: DataFrame) -> DataFrame:
    """The rows dealt by conversation and sorted by turn within it. `own` tells the rows without conv_id from each other."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
    rows = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    return rows.repartition("conv_id", "own").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def each_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Whole conversations from sorted batches, one in memory at a time; a row without conv_id is one by itself."""
    now, turns = None, []
    for batch in batches:
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if turns and (conv is None or conv != now):
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def op9(conversations: DataFrame) -> DataFrame:
    """The contract's digest, over all conversations and conversation -1."""
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = conversations_in_order(conversations.select("conv_id", "turn", "role", "text").union(extra))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return batch

        for conv, turns in each_conversation(batches):
            done = formatted(turns)
            back = parsed(done.output)
            digest = hashlib.sha256()
            for role, text in back:
                digest.update(f"{role}\n{text}\n".encode())
            loss = "".join(unescaped(done.output[a:b]) for a, b in done.mask([role for role, _ in back]))
            out.append((conv, len(back), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(done.output), done.rewrites))
            if len(out) >= 1000:
                yield packed()
        if out:
            yield packed()

    return rows.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
