import math
import random
import re

import pytest
from test_operators import base

from termini.llm import pii


def brute(rows):
    """{(doc_id, text): (spans, sanitised text)} of (doc_id, text) rows by the definitions, one document after another."""
    rows = [(i, t or "") for i, t in rows]
    n = len(rows)
    spans, entities, words = [], [], []
    for _, text in rows:
        found = [(kind, int(a), int(b)) for kind, a, b in (s.split(":") for s in base(text).split(",") if s)]
        spans.append(found)
        entities.append({(k, text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for k, a, b in found})
        blank = list(text)
        for _, a, b in found:
            blank[a:b] = " " * (b - a)
        words.append([(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])", "".join(blank))])
    have = [{w for w, *_ in ws} for ws in words]
    count = lambda test: sum(1 for k in range(n) if test(k))
    n_entity = {c: count(lambda k, c=c: c in entities[k]) for c in set().union(*entities)}
    n_entity = {c: x for c, x in n_entity.items() if x < n}
    n_term = {w: count(lambda k, w=w: w in have[k]) for w in set().union(*have)}
    both = {(c, w): count(lambda k, c=c, w=w: c in entities[k] and w in have[k]) for c in n_entity for w in n_term}
    most = lambda c: n * (n_entity[c] / n) ** pii.GENERALISE * (1 + 1e-9)

    def disclosed(c, w, less=0):
        k = both[c, w] - less
        return math.log2(n * k / (n_term[w] * n_entity[c])) / math.log2(n / n_entity[c]) if k > 0 else -1e9

    own = []
    for k in range(n):
        mine = [c for c in entities[k] if c in n_entity]
        safe = [(n_term[w], w) for w in have[k] if mine and n_term[w] > max(map(most, mine))]
        own.append(min(safe) if safe else None)
    rules = {}  # (entity, term): here, elsewhere, broader
    for (c, w), k in both.items():
        if k and n_term[w] <= most(c) and disclosed(c, w) >= pii.GENERALISE:
            known = [own[d] for d in range(n) if c in entities[d] and w in have[d] and own[d]]
            rules[c, w] = (disclosed(c, w) >= pii.REMOVE, disclosed(c, w, 1) >= pii.REMOVE, min(known) if known else None)
    top = lambda xs: max([x for x in xs if x], default=None)
    elsewhere = {w: top([b for (_, x), (_, e, b) in rules.items() if x == w and e]) for (_, w), (_, e, _) in rules.items() if e}
    out = {}
    for k, (i, text) in enumerate(rows):
        verdict = {}
        for w in have[k]:
            mine = [rules[c, w] for c in entities[k] if (c, w) in rules]
            words_for = [b for *_, b in mine] + ([elsewhere[w]] if w in elsewhere else [])
            if mine or w in elsewhere:
                verdict[w] = None if any(r for r, *_ in mine) else (top(words_for) or (0, "[TERM]"))[1]
        places = [(a, pii.KINDS.index(kind), b, pii.TAGS[pii.KINDS.index(kind)]) for kind, a, b in spans[k]]
        places += [(a, 5 if verdict[w] is None else 4, b, verdict[w] or "") for w, a, b in words[k] if w in verdict]
        at, parts = 0, []
        for a, _, b, tag in sorted(places, key=lambda p: p[:3]):
            if a >= at:
                parts += [text[at:a], tag]
            at = max(at, b)
        out[i, text] = (",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(places, key=lambda p: p[:3])), "".join(parts) + text[at:])
    return out


def corpus(seed):
    draw = random.Random(seed)
    common, rare = [f"{a}{b}mon" for a in "abcdef" for b in "aeiou"], [f"rare{a}{b}é" for a in "klmnpqrs" for b in "aeiou"]
    people = ["ann@x.org", "Bob@y.org", "10.1.2.3", "+1 (626) 555-5759", "4111 1111 1111 1111", "hot@corp.com"]
    rows = []
    for k in range(160):
        words = [draw.choice(common) for _ in range(draw.randint(0, 25))]
        if draw.random() < 0.35:
            who = draw.randrange(5)
            words += [people[who], *(rare[(who * 7 + j) % 40] for j in range(draw.randint(0, 6)))]
        if k % 3 == 0:
            words += ["hot@corp.com", draw.choice(rare)]
        if draw.random() < 0.1:
            words += [draw.choice(rare), draw.choice(rare).upper()]
        draw.shuffle(words)
        rows.append((None if k % 50 == 7 else k - k % 40 // 39, " ".join(words)))
    return rows + [(500, None), (501, ""), rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_and_texts_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "x", "y", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, spans string, term string, n_chars int").repartition(3)
    got = pii.op1(df).collect()
    kinds = "".join(r.spans for r in got)
    assert "generalise" in kinds and "remove" in kinds
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), want[i, t or ""][0]) for i, t in rows)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.schema == df.schema
    shown = clean.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in shown) == sorted((str(i), "None" if t is None else want[i, t][1]) for i, t in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in shown)
    assert any(word in r.text.split() for r in shown if r.text for word in [w for w in r.text.split() if w.endswith("mon")])


def test_a_term_in_a_document_without_the_entity(spark):
    rows = [(k, f"ordinary words and zebrafish write to z@corp.org about matter{'x' * k}") for k in range(12)]
    rows += [(50, "here zebrafish alone, ordinary words"), (51, "single quagga pair q@x.org ordinary words"), (52, "quagga ordinary words")]
    rows += [(k, "ordinary words and nothing else to say") for k in range(100, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert texts == {i: shown for (i, _), (_, shown) in brute(rows).items()}
    assert "zebrafish" not in texts[50] and texts[50].endswith("alone, ordinary words") and texts[52] == "quagga ordinary words" and texts[100] == rows[-1][1]


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string, verdicts string")
    assert pii.sanitise(none).count() == 0 and pii.op1(none).count() == 0
    long = "word " * 200_000 + "me@here.org"
    df = spark.createDataFrame([(1, long), (1, long), (2, "word")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in pii.sanitise(df).collect()}
    assert got == {(1, long.replace("me@here.org", "[EMAIL]")), (2, "word")}
