import random
import time

import numpy as np
from tokenizers import Tokenizer

from termini.llm import token_counts as T
from termini.llm.queries import BYTE_BPE, tokenizer_path

PATH = tokenizer_path(BYTE_BPE)
LIB = Tokenizer.from_file(PATH)


def brute(text):
    return [len(LIB.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_every_prefix_of_random_texts():
    draw, counter = random.Random(5), T.PrefixCounter.at(PATH)
    bits = [" ", "  ", "\n", "\t", "\r", "　", "\x85", "\x1c", "'", "'s", "'ll", "'re", "'x", "don't", "word", "Zebra", "12", "7", "!?", "--", "é", "日本", "🙂", "<|endoftext|>", "<|endo", "|>", "\x00", "_", "a" * 20, "़", "²", "ⅷ"]
    for _ in range(150):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 14)))
        assert counter.prefix_table(text).tolist() == brute(text), repr(text)


def test_long_texts_take_linear_time():
    counter = T.PrefixCounter.at(PATH)
    draw = np.random.default_rng(1)
    for letters in (b"a", b"abcdefghijklmnopqrstuvwxyz", b" ", b"\n", b"!"):
        text = bytes(draw.choice(list(letters), 100_000).tolist()).decode()
        began = time.time()
        table = counter.prefix_table(text)
        assert time.time() - began < 20 and len(table) == 100_001
        assert table[-1] == len(LIB.encode(text, add_special_tokens=False).ids)
        for k in draw.integers(0, 100_000, 3).tolist():
            assert table[k] == len(LIB.encode(text[:k], add_special_tokens=False).ids)


def test_limits_come_from_the_table(spark):
    schema = "doc_id long, text string, n_tokens string, prefix_table string"
    rows = [(1, "one two three four five " * 50, "x", "y"), (1, "one two three four five " * 50, "x", "y"), (None, None, "x", "y"), (2, "", "x", "y"), (3, "a b", "x", "y")]
    df = spark.createDataFrame(rows, schema)
    for r in T.token_counts(df, PATH, 20).collect():
        text = next(t or "" for i, t, *_ in rows if i == r.doc_id)
        want = brute(text)
        assert r.n_tokens == want[-1] and r.over_limit == (want[-1] > 20) and r.chars_within_limit == max(k for k, n in enumerate(want) if n <= 20)
    tables = T.prefix_tables(df, PATH)
    assert sorted(len(T.unpacked(bytes(r.prefix_table))) for r in tables.collect()) == sorted(len(t or "") + 1 for _, t, *_ in rows)
    assert T.prefix_tables(df.limit(0), PATH).count() == 0 and T.token_counts(df.limit(0), PATH).count() == 0
