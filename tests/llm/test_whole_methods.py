"""Secrets whatever stands around them, and grammars without a frequent pair left."""

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repair_store, secret_scan

BASE36, BASE32 = "k3v9q0z7x1m5w8b2n6j4h0t7r3p9d5f1gs", "MZXW6YTBOI5GC3DPNQ2HK7TEOJUV4LQF"


@pytest.mark.parametrize("key", [BASE36, BASE32])
def test_a_secret_is_found_whatever_surrounds_it(spark, key):
    around = [("", ""), ("the key ", " is in use."), ("the key ", " is in use. Now"), ("THE KEY ", " IS IN USE"), ("x" * 500 + " ", " " + "y" * 500 + " Z")]
    df = spark.createDataFrame([(k, a + key + b) for k, (a, b) in enumerate(around)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    assert got == {k: f"entropy_base64:{len(a)}:{len(a) + len(key)}" for k, (a, _) in enumerate(around)}


@pytest.mark.parametrize("spread", [1, 997])
def test_no_frequent_pair_is_left(spread):
    r = np.random.default_rng(4)
    passage = r.integers(1, 60, 700)
    docs = [np.concatenate((r.integers(1, 60, r.integers(0, 90)), passage, [0])) * spread for _ in range(40)]
    docs = [d.astype(np.uint32).tobytes() for d in docs]
    shard = repair_store.Shard(repair_store.write_shard(docs, 60 * spread, 0))
    assert shard.all().tobytes() == b"".join(docs)
    assert all(shard.document(k).tobytes() == d for k, d in enumerate(docs))
    s = shard.symbols
    pairs = Counter(p for p in zip(s[:-1].tolist(), s[1:].tolist()) if 0 not in p)
    assert max(pairs.values()) < repair_store.LEAST and shard.size.max() > 256


def test_pairs_that_share_a_place_in_the_table_are_all_replaced():
    a = np.arange(1, 20001, dtype=np.uint32)
    ids = np.concatenate([np.column_stack((a, a + 20000, np.zeros_like(a))).ravel()] * 12)
    seq, left, right = repair_store.compress(ids, 40001, 0, rounds=1, rules_a_round=20000)
    assert len(left) == 20000 and len(seq) == len(ids) * 2 // 3
