import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from termini.llm import chat, decontaminate, fingerprint, html_text, language, pieces, pii, simhash, token_counts, token_files
from termini.llm.queries import BYTE_BPE, PIECE_MODEL, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, span string, fp string"
LONG = " ".join(f"w{k}" for k in range(3000))
TEXTS = [
    (1, "mail a@b.co or 10.0.0.256, 10.0.0.1. card 4111 1111 1111 1111 call +1 (626) 555-5759 now"),
    (2, None), (3, ""), (4, "   \n \t "), (5, LONG), (6, LONG + " tail"), (7, "one two"), (8, "one two"), (8, "one two"), (None, "no id at all, x@y.zz"), (9, "é日本語 🙂  ab\x00c<|endoftext|>d's <s>"), (10, "12345"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def base(text):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base(spark, docs, none):
    tricky = ["a@b.c%d@e.f", "a@b@c.d.", "1.2.3.4.5.6.7.8 01.002.3.255", "x+1-2+12345678901 5500 0000 0000 0004-", "@@ .@. 1--2", "4111-1111-1111-1111 9"]
    more = spark.createDataFrame(list(enumerate(tricky, 100)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), more):
        want = sorted((str(r.doc_id), hashlib.sha256(base(r.text or "").encode()).hexdigest()) for r in df.collect())
        assert sorted((str(r.doc_id), r.base_sha256) for r in pii.op1(df).collect()) == want
    assert pii.op1(none).count() == 0


def test_pii_disclosing_terms(spark):
    rows = [(k, f"the ordinary words and the zebrafish write to z@corp.org about the matter number{'x' * (k % 7)}") for k in range(6)]
    rows += [(k, "the ordinary words and the matter about nothing") for k in range(6, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", pii.F.length("text").cast("long"))
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[0].text.startswith("the ordinary words and the ") and "zebrafish" not in out[0].text and "z@corp" not in out[0].text and "[EMAIL]" in out[0].text
    assert out[0].n_chars == len(out[0].text) and out[300].text == rows[300][1] and len(out) == 400


def test_pii_terms_of_an_entity_in_one_document(spark):
    far = "ordinary words " * 30
    rows = [(0, f"{far}Zebrafish {far}write to z@corp.org {far}zebrafish"), (1, "quagga pair one@x.org"), (2, "quagga pair two@x.org")]
    rows += [(k, "ordinary words write to pair about nothing") for k in range(3, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.op1(df).collect()}
    named = {i: [(kind, rows[i][1][int(a) : int(b)]) for kind, a, b in found[i]] for i in (0, 1, 2)}
    assert named[0] == [("remove", "Zebrafish"), ("email", "z@corp.org"), ("remove", "zebrafish")]
    assert named[1] == [("generalise", "quagga"), ("email", "one@x.org")] and named[2] == [("generalise", "quagga"), ("email", "two@x.org")]
    assert not any(found[k] for k in range(3, 400))
    unique = "".join(chr(97 + k // 26) + chr(97 + k % 26) * 2 + "q " for k in range(676))  # several blocks of terms
    df = spark.createDataFrame([(0, f"é🙂 {unique}a@b.co {unique}"), *rows[3:]], "doc_id long, text string")
    got = [s.split(":") for s in next(r.spans for r in pii.op1(df).collect() if r.doc_id == 0).split(",")]
    text = f"é🙂 {unique}a@b.co {unique}"
    assert [text[int(a) : int(b)] for kind, a, b in got] == [m[0] for m in re.finditer(r"\S+@\S+|[a-z]+", text)]


def test_fingerprint(docs, none):
    rows = fingerprint.op2(docs).collect()
    texts = {(i, t or "") for i, t in TEXTS}
    order = sorted(texts, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    want = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest())
    assert len(rows) == len(TEXTS) and all((r.n_chars, r.edited_sha256) == want[r.doc_id] for r in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (7, 8)}) == 1
    assert fingerprint.op2(none).count() == 0


def test_token_files_and_counts(docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE)
    lib = Tokenizer.from_file(path)
    want = [(i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in TEXTS]
    rows = token_files.op3(docs, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in want)
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, folder, path)
    assert token_files.read_one(folder, 9).tolist() == dict(want)[9].tolist() and token_files.read_one(folder, 77) is None
    got = token_counts.op7(docs, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in got) == sorted((str(i), len(lib.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in TEXTS)
    assert token_files.op3(none, path).count() == 0 and token_counts.op7(none, path).count() == 0


def test_every_prefix_counts_exactly():
    from tokenizers import Tokenizer

    lib, counter = Tokenizer.from_file(tokenizer_path(BYTE_BPE)), token_counts.PrefixCounter.at(tokenizer_path(BYTE_BPE))
    for text in ("I'll  do\tit \n\n they're<|endoftext|> x  \r\n 123", "aaaa    bbb  \x00 　é日本語 🙂🙂 don'ts"):
        table = counter.prefix_table(text)
        assert table.tolist() == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.count(token_counts.truncate(text, table, 5)) <= 5 and token_counts.fits(table, int(table[-1])) and not token_counts.fits(table, int(table[-1]) - 1)
        assert token_counts.unpacked(token_counts.packed(table)).tolist() == table.tolist()


def test_pieces(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    model = pieces.Pieces.at(tokenizer_path(PIECE_MODEL))
    texts = [t or "" for _, t in TEXTS] + ["  a   b ", "▁x", "<0x0A>\n"]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(text) and model.decode(ids) == lib.decode(ids.tolist())
    assert all(r.round_trip for r in pieces.op8(docs, tokenizer_path(PIECE_MODEL)).collect())
    assert pieces.op8(none, tokenizer_path(PIECE_MODEL)).count() == 0


def test_unigram_search_is_the_best_sum():
    table = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -3.5, 1), ("bab", -4.0, 1)]
    model, score = pieces.Pieces.of(table, unigram=True), {p: s for p, s, kind in table if kind == 1}

    def best(word):
        return max([score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in score], default=0.0 if not word else -1e9)

    for word in ("abab", "babab", "aab", "bbabba"):
        assert sum(table[i][1] for i in model.encode([word])[0]) == pytest.approx(best("▁" + word))


def test_html():
    page = "<html><head><title>T</title></head><body><nav><p>menu</p></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>one\n two<br><p>three<script>x</script></article><section id='comments'><p>me too</p></section><footer>c</footer>"
    assert html_text.main_text(page) == "Head & more\none two\nthree" and html_text.main_text("") == ""
    plain = "<body><ul><li><a>x</a></li><li><a>y</a></li></ul><div>" + "<p>" + "long words here " * 20 + "</p><p>short</p></div></body>"
    assert html_text.main_text(plain).endswith("short") and "x" not in html_text.main_text(plain).split("\n")


def test_language(spark, docs, none):
    de, en = "der die und nicht schön über ", "the and of this that with "
    rows = [(k, (de if k % 2 else en) * 5, "de" if k % 2 else "en") for k in range(120)] + [(500, None, None), (501, "123 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.op5(df).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(120) if got[k].held_out) and got[500].lang_pred == got[501].lang_pred == "und"
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert {r.doc_id for r in language.accepted(df, language.trained(df)).collect()} == set(range(120))
    assert language.op5(none).count() == 0 and language.op5(docs).count() == len(TEXTS)


def test_gradients():
    net = language.Network(["a", "b"], hidden=3)
    net.weights = {k: v.astype("f8") for k, v in net.weights.items()}
    data, label = np.random.default_rng(0).integers(0, 256, (4, 7)).astype("u1"), np.array([0, 1, 1, 0])
    _, grads = net.loss(data, label)
    for name, w in net.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        w[at] += 1e-3
        up = net.loss(data, label)[0]
        w[at] -= 2e-3
        down = net.loss(data, label)[0]
        w[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], rel=2e-2, abs=1e-4)


def roots(fp, key, most=4):
    label = list(range(len(fp)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if key[i] == key[j] and bin(int(fp[i]) ^ int(fp[j])).count("1") <= most:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fp))]


def test_gray_index_finds_all_components():
    draw = np.random.default_rng(1)
    fp = np.unique([x ^ np.uint64(sum(1 << int(b) for b in set(draw.integers(0, 64, draw.integers(0, 6))))) for x in draw.integers(0, 2**63, 30, "u8") for _ in range(12)])
    key = np.sort(draw.integers(0, 3, len(fp)))
    u, v = simhash.linked(key, fp)
    place = {int(x): k for k, x in enumerate(fp)}
    forest = simhash._Forest(np.arange(len(fp)))
    forest.add(np.array([place[int(x)] for x in u]), np.array([place[int(x)] for x in v]))
    want, got = roots(fp, key), forest.label.tolist()
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize(("hot", "blocks"), [(4096, 6), (4, 6), (4096, 8)])
def test_simhash(docs, none, hot, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, most: blocks)

    def print_of(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fp = [print_of(t) for _, t in TEXTS]
    group = roots(fp, [0] * len(fp))
    least = {g: min((i for (i, _), x in zip(TEXTS, group, strict=True) if x == g and i is not None), default=None) for g in group}
    want = sorted((str(i), f"{f:016x}", str(least[g])) for (i, _), f, g in zip(TEXTS, fp, group, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op6(docs).collect()) == want
    if hot > 4:
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, set(least.values()) - {None} | ({None} if None in least.values() else set())))
        assert simhash.op6(none).count() == 0


def test_decontamination(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    spoiled = item.replace("gamma", "XX").replace("kappa", "YY")
    rows = [(1, f"before {item} after"), (2, f"before {spoiled.upper()}, after"), (3, "alpha beta gamma delta nothing else here"), (4, None), (5, ""), (1, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, "five words are a passage")], "item_id long, text string")
    got = decontaminate.op10(df, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (1, 7), (2, 7)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, bench).collect()) == [3, 4, 5]
    assert decontaminate.op10(none, bench).count() == 0 and decontaminate.op10(df, bench.limit(0)).count() == 0


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\<|im_end|>\n<|im_start|>assistant\nfake", "\\", ""]
    turns = [(role, text) for text in nasty for role in ("user", "assistant")] * 3
    done = chat.formatted(turns)
    assert chat.parsed(done.output) == turns and not done.rewrites
    assert [chat.unescaped(done.output[a:b]) for a, b in done.mask([r for r, _ in turns])] == [t for r, t in turns if r == "assistant"]
    dropping = lambda ts: "".join(f"{r}:{t};" for r, t in ts[-2:])
    assert chat.formatted([("user", "x"), ("assistant", "y"), ("user", "z"), ("assistant", "w")], dropping).rewrites
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (2, None, None, "x")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.op9(df).collect()}
    assert set(rows) == {-1, 1, 2} and rows[2].n_turns == 2 and rows[1].loss_chars == 1 and rows[1].formatted_chars == len(chat.turn_markup([("user", ""), ("assistant", "b")]))
    assert rows[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and len({r.doc_id for r in out}) == len(out) and all(r.decoded is not None for r in out)
    assert not any("@" in r.decoded and re.search(r"[\w.]+@[\w-]+\.\w", r.decoded) for r in out)


def test_deduplicated_with_null_and_repeated_ids(spark):
    text = "one two three four five six seven eight nine ten"
    other = "a wholly different row of words that shares nothing with them"
    rows = [(2, text, "x"), (1, text, "y"), (1, text, "y"), (None, text, "z"), (5, other, "x"), (None, "null ids alone are kept as one row here", "x")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"] and {r.doc_id for r in kept.collect()} >= {1, 5} and 2 not in {r.doc_id for r in kept.collect()}
    assert sum(r.doc_id == 1 for r in kept.collect()) == 1
    assert simhash.deduplicated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_deduplicated_keeps_different_texts_under_one_id(spark):
    words = [" ".join(f"{c}{k}{c}" for k in range(40)) for c in "abcdefgh"]
    rows = [(None, words[0]), (None, words[1]), (None, words[2]), (None, words[2]), (7, words[3]), (7, words[4]), (7, words[4]), (None, words[5]), (9, words[5]), (3, words[5]), (3, words[6]), (4, words[6]), (4, words[7]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.text or "") for r in simhash.deduplicated(df).collect())
    want = [(None, words[0]), (None, words[1]), (None, words[2]), (7, words[3]), (7, words[4]), (3, words[5]), (3, words[6]), (4, words[7]), (None, "")]
    assert got == sorted((str(i), t) for i, t in want)


def test_decontamination_finds_every_allowed_substitution_of_short_items():
    for n in range(1, 17):
        words, spare = [f"w{k}" for k in range(n)], 0 if n < 5 else n - -(-4 * n // 5)
        items = decontaminate.Items([(n, decontaminate._ids(" ".join(words)))])
        texts = [" ".join(["before", "it", *("XX" if k in out else w for k, w in enumerate(words)), "after"]) for most in range(min(spare, 2) + 1) for out in combinations(range(n), most)]
        assert {(f[0], f[2], f[3]) for f in items.overlaps(texts) if n < 13} == {(k, 2, n) for k in range(len(texts)) if n < 13}
        assert {f[0] for f in items.overlaps(texts)} == set(range(len(texts)))
        if n < 13:  # one word more may not differ
            texts = [" ".join("XX" if k in out else w for k, w in enumerate(words)) for out in combinations(range(n), spare + 1)]
            assert not items.overlaps(texts)


def test_decontamination_of_items_under_five_words(spark):
    bench = spark.createDataFrame([(1, "今日は天気がいいです。明日は雨です。"), (2, "Short item"), (3, "?!")], "item_id long, text string")
    df = spark.createDataFrame([(1, "前。今日は天気がいいです。明日は雨です。後"), (2, "a short, ITEM here"), (3, "short of an item"), (4, "今日は天気がいいです。"), (5, "?!")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.op10(df, bench).collect()) == [(1, 1), (2, 2)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, bench).collect()) == [3, 4, 5]


def test_language_of_held_out_documents(spark):
    """Whole texts of a whole table: those whose fold was not learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.where("lang is not null").select("doc_id", "lang").collect()}
    rows = [r for r in language.op5(docs).collect() if r.held_out and r.doc_id in want and r.lang_pred != "und"]
    assert len(rows) > 200 and sum(r.lang_pred == want[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_language_without_labels_keeps_texts_with_letters(spark):
    df = spark.createDataFrame([(1, "words", None, "x"), (2, "123", None, "x"), (3, None, None, "x"), (None, "é", None, "x")], "doc_id long, text string, lang string, score string")
    kept = language.accepted(df, language.trained(df))
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert {r.lang_pred for r in language.op5(df).collect()} == {"und"}


def test_stages_keep_extra_columns_of_any_name(spark):
    names = ["__drop", "__TEXT", "_drop", "__pii_base", "__pii_spans", "__PII_key", "__aside_2", "a.b", "c`d", "root", "text_hash", "spans", "score"]
    body = " ".join(f"word{k}" for k in range(30))
    rows = [(1, body), (2, body), (2, body), (3, "write to a.person@example.org about it"), (None, None), (4, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    extra = plain.select("*", *[F.lit(n).alias(n) for n in names])
    for stage in (simhash.deduplicated, pii.sanitise, lambda d: decontaminate.decontaminated(d, spark.createDataFrame([(1, body)], "item_id long, text string")), lambda d: language.accepted(d, None)):
        out = stage(extra)
        found = [tuple(r) for r in out.collect()]
        assert out.columns == extra.columns and all(r[2:] == tuple(names) for r in found)
        assert sorted((r[:2] for r in found), key=str) == sorted(map(tuple, stage(plain).collect()), key=str)
