import numpy as np
import pytest
from tokenizers import Tokenizer

from termini.llm import token_files as T
from termini.llm.queries import BYTE_BPE, tokenizer_path

PATH = tokenizer_path(BYTE_BPE)


def test_one_document_opens_the_shards_of_its_range(spark, tmp_path, monkeypatch):
    lib = Tokenizer.from_file(PATH)
    rows = [(k, f"document {k} " * (k % 50), "x", "y") for k in range(0, 400, 2)] + [(None, "none", "x", "y"), (100, "again", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tie string, frame string").repartition(5)
    folder = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one shard
    try:
        manifest = T.write_token_files(df, folder, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = manifest["shards"]
    assert len(shards) > 1 and all(a["last"] <= b["first"] for a, b in zip(shards, shards[1:], strict=False) if a["last"] is not None)
    opened = []
    monkeypatch.setattr(T, "Shard", lambda folder, entry, d, real=T.Shard: opened.append(entry["file"]) or real(folder, entry, d))
    for k in (0, 198, 398):
        opened.clear()
        assert T.read_one(folder, k).tolist() == [*lib.encode(rows[k // 2][1], add_special_tokens=False).ids, 2] and len(opened) <= 2
    opened.clear()
    assert T.read_one(folder, 1001) is None and not opened
    assert T.read_one(folder, 3) is None


def test_another_dictionary_or_a_cut_file_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = T.write_token_files(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), folder, PATH)
    with pytest.raises(ValueError):
        T.Shard(folder, manifest["shards"][0], b"other")
    path = tmp_path / "ids" / manifest["shards"][0]["file"]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        T.Shard(folder, manifest["shards"][0], T._dictionary(folder))


def test_the_dictionary_is_trained_on_pieces_of_long_texts_too(spark):
    draw = np.random.default_rng(0)
    words = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(draw.choice(words, 8000).tolist())) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for _, t in rows) > T.SAMPLE_CHARS and T.train_dictionary(df, PATH)


def test_joined_parts_encode_as_whole_texts():
    lib = Tokenizer.from_file(PATH)
    encoder = T.Encoder(PATH)
    odd = ["", " ", "a", " a b", "x<|endoftext|>y", " <|endoftext|>", "a  b\n\n c", "a\tb 　c", "\0 a", "tail ", "中文 été", "it's 'll", " a   b", "\n", " \n a\r\n b", "w" * 300 + " " + "w" * 300]
    draw = np.random.default_rng(1)
    bits = [" ", "\n", "\t", "\r", " ", "a", "Z9", "'s", "中", "\U0001f600", "<|endoftext|>", "<|endof", ".", "\0"]
    texts = odd + ["".join(draw.choice(bits, 30).tolist()) for _ in range(2000)]
    for _ in range(2):  # new parts, then known ones
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, encoder.kind).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_parts_whose_bytes_do_not_meet_are_encoded_alone():
    lib, encoder = Tokenizer.from_file(PATH), T.Encoder(PATH)
    encoder.sizes[:] = 3
    assert np.frombuffer(encoder.encode(["one two three"])[0], encoder.kind).tolist() == lib.encode("one two three", add_special_tokens=False).ids
