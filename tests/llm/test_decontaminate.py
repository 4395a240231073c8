import math
import random
from itertools import combinations

import pytest

from termini.llm import decontaminate as D


def words(text):
    return D._WORD.findall(text.lower())


def brute(text, item):
    """Does any alignment agree in SHARE of PASSAGE consecutive words, or of the whole shorter item?"""
    a, b = words(text), words(item)
    size = min(D.PASSAGE, len(b))
    need = size if size < D.FEWEST else math.ceil(D.SHARE * size - 1e-9)
    if not size:
        return False
    for start in range(-len(b) + 1, len(a)):
        equal = [0 <= start + k < len(a) and a[start + k] == b[k] for k in range(len(b))]
        inside = [0 <= start + k < len(a) for k in range(len(b))]
        if any(all(inside[k : k + size]) and sum(equal[k : k + size]) >= need for k in range(len(b) - size + 1)):
            return True
    return False


def tables(draw):
    vocabulary = [f"w{k}" for k in range(6)] + [f"rare{k}" for k in range(300)]
    pick = lambda n: [draw.choice(vocabulary[:6] if draw.random() < 0.3 else vocabulary) for _ in range(n)]
    items = [pick(draw.choice([1, 2, 4, 5, 6, 7, 9, 11, 12, 13, 14, 20, 40])) for _ in range(40)] + [["w0"] * 13, ["w0"] * 30, ["w1", "w2"] * 8]
    docs = [["w0"] * 400, ["w1", "w2"] * 50, [], ["w3"]]
    for _ in range(120):
        doc = pick(draw.randint(0, 40))
        for _ in range(draw.randint(0, 2)):
            item = list(draw.choice(items))
            for k in draw.sample(range(len(item)), min(len(item), draw.randint(0, 4))):
                item[k] = draw.choice(vocabulary)
            at = draw.randint(0, len(doc))
            cut = draw.randint(0, max(0, len(item) - 11))
            doc[at:at] = item[cut:]
        docs.append(doc)
    return [" ".join(x) for x in docs], [" ".join(x) for x in items]


@pytest.mark.parametrize(("pairs", "block"), [(1_000_000, 2_000_000), (7, 2_000_000), (1_000_000, 60)])
def test_against_brute_force(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(D, "PAIRS", pairs)
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = tables(random.Random(11))
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if brute(text, item)}
    df = spark.createDataFrame([(d, t, "x") for d, t in enumerate(docs)], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string").coalesce(1)
    rows = D.op10(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 60
    for r in rows:  # what is reported is there
        assert 0 <= r.first_word and r.first_word + r.n_words <= len(words(docs[r.doc_id])) and 0 < r.matched <= 1
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_seeds_find_every_allowed_substitution_of_a_passage():
    spare = D.PASSAGE - math.ceil(D.SHARE * D.PASSAGE - 1e-9)
    for out in combinations(range(D.PASSAGE), spare):
        assert any(not set(out) & {at + k for k in seed} for seed in D.SEEDS for at in range(D.PASSAGE - seed[-1]))
    for n in range(1, D.PASSAGE):
        spare = 0 if n < D.FEWEST else n - math.ceil(D.SHARE * n - 1e-9)
        assert all(any(not set(out) & set(seed) for seed in D.short_seeds(n)) for out in combinations(range(n), spare))


def test_empty_sides_nulls_and_long_texts(spark):
    schema = "doc_id long, text string, item_id string, matched string"
    item = " ".join(f"b{k}" for k in range(20))
    df = spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y"), (2, "z " * 200_000 + item, "x", "y"), (2, "z " * 200_000 + item, "x", "y"), (None, item, "x", "y")], schema)
    bench = spark.createDataFrame([(None, item, "x"), (4, item, "x"), (5, None, "x"), (6, " ?! ", "x")], "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), str(r.item_id), r.first_word, r.n_words, r.matched) for r in D.op10(df, bench).collect())
    assert got == sorted([("2", i, 200_000, 20, 1.0) for i in ("4", "None")] * 2 + [("None", i, 0, 20, 1.0) for i in ("4", "None")])
    assert sorted(str(r.doc_id) for r in D.decontaminated(df, bench).collect()) == ["1", "None"]
    for none in (bench.limit(0), bench.where("item_id in (5, 6)")):
        assert D.op10(df, none).count() == 0 and D.decontaminated(df, none).count() == 5
    assert D.op10(df.limit(0), bench).count() == 0 and D.decontaminated(df.limit(0), bench).count() == 0
