import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from termini.llm import fingerprint as M

TEXTS = ["Hello, world. Bye.", "Hello,  world. Bye.", "Hello,\tworld. Bye.", "Hello, world.\x01Bye.", "Hello, world. \x01Bye.", "Hello, world.\nBye.", "Hello, world. \nBye.", "Hello, world. Bye. ", "", " ", "\n", "\n\n", "\x01", "a.\x01b", "a. b", "a.b"]


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.fingerprint for r in M.fingerprints(rows).collect()}


def tree(text):
    """The tree as nested lists of full SHA-256 leaves, and its root, by plain Python."""
    sections, now = [], []
    for line in text.split("\n"):
        leaves, clause, k = [], "", 0
        while k < len(line):
            clause += line[k]
            k += 1
            if line[k - 1] in ".!?;:,":
                white = len(line[k:]) - len(line[k:].lstrip(" \t"))
                if white:
                    clause, k = clause + line[k : k + white], k + white
                    leaves.append(clause)
                    clause = ""
            if line[k - 1 : k] == "\x01":
                leaves.append(clause[:-1])
                clause = ""
        leaves.append(clause)
        now.append(",".join(base64.b64encode(hashlib.sha256(c.encode()).digest()[:16]).decode()[:22] for c in leaves))
        if hashlib.sha256(now[-1].encode()).hexdigest()[0] in "0123":
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return hexed("".join(hexed("".join(map(hexed, s))) for s in sections)) + "#" + "#".join(";".join(s) for s in sections)


def test_roots_test_equality(spark):
    got = prints(spark, TEXTS)
    assert len({fp[:64] for fp in got.values()}) == len(TEXTS)
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab.,! \t\n\x01") for _ in range(draw.randint(0, 40))) for _ in range(300)]
    got = prints(spark, texts)
    assert [got[k] for k in range(300)] == [tree(t) for t in texts]
    assert len({t for t in texts}) == len({got[k][:64] for k in range(300)})


def slow_likeness(a, b):
    """Shared clauses by sets, level by level."""
    shared, x, y = 0, set(a[65:].split("#")), set(b[65:].split("#"))
    for mark in (";", ","):
        shared += sum(len(s.replace(";", ",").split(",")) for s in x & y)
        x, y = {p for s in x - y for p in s.split(mark)}, {p for s in y - x for p in s.split(mark)}
    return 1.0 if a[:64] == b[:64] else (shared + len(x & y)) / (shared + len(x | y))


def test_likeness_and_edits_against_plain_python(spark):
    draw = random.Random(8)
    lines = [f"Line {k}, with a clause; and one more {k % 5}." for k in range(60)]
    pairs = []
    for _ in range(60):
        a = [draw.choice(lines) for _ in range(draw.randint(1, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(len(b) + 1)
            kind = draw.choice(["delete", "move", "repeat", "change", "add"])
            if kind == "delete":
                del b[at : at + 2]
            elif kind == "move" and b:
                b.insert(at, b.pop(draw.randrange(len(b))))
            elif kind == "repeat":
                b[at:at] = b[at : at + 1]
            elif kind == "change" and at < len(b):
                b[at] = b[at].replace("clause", "CLAUSE")
            else:
                b.insert(at, "something new. here")
        pairs.append((a, b or [""]))
    pairs += [(["x"] * 30, ["x"] * 31), (["x"] * 30, ["x"] * 29), (["a"], ["a"]), ([f"p {k}" for k in range(9)], [f"p {k}" for k in (0, 5, 1, 2, 3, 4, 6, 7, 8)])]
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b), "near") for k, (a, b) in enumerate(pairs)], "k long, a string, b string, source string")
    df = df.withColumns({"a": M.fingerprint(F.col("a")), "b": M.fingerprint(F.col("b"))})
    found = M.compared(df, "a", "b", "near", "edit")
    assert found.columns == ["k", "a", "b", "source", "near", "edit_first", "edit_removed", "edit_added"]
    for r in found.collect():
        a, b = pairs[r.k]
        assert r.near == pytest.approx(slow_likeness(r.a, r.b))
        # what the edit says turns a into b, and it begins and ends at paragraphs that differ
        if a == b:
            assert (r.edit_first, r.edit_removed, r.edit_added) == (None, 0, 0)
            continue
        first, gone, come = r.edit_first, r.edit_removed, r.edit_added
        assert a[:first] + b[first : first + come] + a[first + gone :] == b
        assert a[first : first + 1] != b[first : first + 1]
        assert not (gone and come) or a[first + gone - 1] != b[first + come - 1]


def test_clashing_names_and_long_texts(spark):
    rows = [(1, "long. " * 100_000, "x", "y", "z"), (1, "long. " * 100_000, "x", "y", "z"), (None, None, None, None, None), (2, "", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, i string, fingerprint string")
    got = M.op2(df).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 600_000), ("1", 600_000), ("2", 0), ("None", 0)]
    assert M.op2(df.limit(0)).count() == 0
    only = M.op2(df.where("doc_id = 2")).first()
    assert only.near_edited == only.near_next == 1.0 and only.edit_first is None
