from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from termini.llm import common, simhash


def test_more_fingerprints_take_wider_keys():
    assert [simhash.blocks_for(n) for n in (0, 1000, 10**6, 10**7)] == [6, 6, 6, 6]
    assert [simhash.blocks_for(n) for n in (10**9, 10**10, 10**11, 10**12)] == [7, 8, 8, 9]
    for blocks in range(6, 13):  # any four bits leave blocks - 4 blocks untouched, so some table holds the pair
        masks = [m % (1 << 64) for m in simhash._tables(4, blocks)]
        draw = np.random.default_rng(blocks)
        for bits in [draw.choice(64, 4, replace=False).tolist() for _ in range(200)]:
            assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_links_are_the_same_whatever_the_blocks(spark):
    draw = np.random.default_rng(6)
    fp = {int(x) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)) for x in draw.integers(0, 2**62, 40) for _ in range(8)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fp)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = {(x, y) for x, y in combinations(signed, 2) if bin((x ^ y) & (2**64 - 1)).count("1") <= 4}
    found = []
    for blocks in (6, 7, 9):
        edges = {(r.u, r.v) for r in simhash.links(df, blocks=blocks).collect()}
        assert edges <= near
        roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(edges), "u long, v long")).collect()}
        found.append({x: roots.get(x, x) for x in signed})
    label = {x: x for x in signed}
    for _ in signed:
        for x, y in near:
            label[x] = label[y] = min(label[x], label[y])
    assert found[0] == found[1] == found[2] == label


def test_only_results_stay_in_the_shared_folder(spark):
    df = spark.createDataFrame([(k, f"a b c d e f {k // 2}", "x", "y") for k in range(20)], "doc_id long, text string, root string, fp string")
    since = common.made()
    rows = simhash.op6(df)
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in common._made[since:]} == {"fingerprints", "places"}
    assert rows.count() == 20
    common.clear(spark, since)
    assert common.made() == since
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and kept.agg(F.count("*")).first()[0] == 10


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_rows_to_drop_beyond_the_broadcast_bound(spark, monkeypatch):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    rows = [(k, words[k % 5], "x") for k in range(40)] + [(None, words[0], "x"), (0, words[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __source string")
    kept = sorted(r.doc_id for r in simhash.deduplicated(df).collect())
    monkeypatch.setattr(simhash, "SMALL", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == kept == [0, 1, 2, 3, 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
