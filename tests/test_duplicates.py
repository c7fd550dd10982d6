"""Near-duplicate pairs and groups against brute force over random texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import duplicates as D


def grams(t):
    return {t[k : k + 3] for k in range(len(t) - 2)} or {t}


def near(s, t):
    a, b = grams(s), grams(t)
    return min(len(s), len(t)) >= 20 and (s in t or t in s) or 100 * len(a & b) >= 92 * len(a | b)


def texts(seed):
    """Bare texts of many sizes, with parts of one another, small changes and repeats."""
    r = random.Random(seed)
    letters = "abcdefghij日本é\U0001f600"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    out = [make(r.choice([1, 2, 3, 4, 12, 19, 20, 21, 40, 150, 600])) for _ in range(60)]
    for t in list(out):
        for _ in range(3):
            k = r.randrange(len(t))
            out.append(t[:k] + r.choice(letters) * r.randrange(0, 3) + t[k + r.randrange(0, 2) :])
        a = r.randrange(len(t))
        out.append(t[a : a + r.choice([10, 19, 20, 25, 300])])
        out.append(make(5) + t + make(3))
    out += ["ab" * 300, "ab" * 301, "ab" * 10, "a" * 25, "a" * 26, "x" * 3] + out[:20]
    return [t for t in out if t]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_groups_equal_brute_force(spark, seed):
    rows = [(k, t, k % 50 if k % 3 else None) for k, t in enumerate(texts(seed))] + [(9000, None, 1), (9001, " .,", 2), (9002, "", 3)]
    df = spark.createDataFrame(rows, "id long, s string, g int").repartition(5)
    bare = {k: t for k, t, _ in rows if k < 9000}
    first, want = {}, set()
    for k, t in bare.items():
        if t in first:
            want.add((first[t], k))
        else:
            want |= {(j, k) for s, j in first.items() if near(s, t)}
            first[t] = k
    assert {tuple(p) for p in D.near_pairs(df, "id", "s").collect()} == want

    by_group, edges = {}, set(want)
    for k, _, g in rows:
        if g is not None:
            edges.add((by_group.setdefault(g, k), k))
    root = {k: k for k, *_ in rows}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    own = {k: (g, t) for k, t, g in rows}
    label = lambda k: "grp_" + hashlib.sha1(f"{k}:{'' if own[k][0] is None else own[k][0]}:{(own[k][1] or '').strip(' .,')[:80]}".encode()).hexdigest()[:12]
    assert {r.id: (r.root, r.group_label) for r in D.duplicate_groups(df, "id", "s", "g").collect()} == {k: (v, label(v)) for k, v in root.items()}


def test_features_lose_no_partner():
    """A contained text has no minimizer of its own, and alike sets share a key, at any size."""
    r = random.Random(5)
    for n in (20, 33, 100, 1000, 20_000):
        t = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        for _ in range(10):
            a = r.randrange(0, n - 19)
            owner, h = D.minimizers([t, t[a : a + r.randrange(20, n + 1)], "short"])
            assert set(h[owner == 1]) <= set(h[owner == 0]) and (owner == 1).any() and not (owner == 2).any()
    for n in (1, 5, 11, 12, 13, 24, 25, 100, 999, 5000):
        for _ in range(30):
            one = np.arange(n, dtype=np.uint64) * np.uint64(7919)
            cut = r.randrange(0, n // 12 + 1)
            two = np.concatenate((one[cut:], np.arange(r.randrange(0, n // 12 - cut + 1), dtype=np.uint64) + np.uint64(1 << 50)))
            common, union = len(np.intersect1d(one, two)), len(np.union1d(one, two))
            text, key = D.set_parts(np.repeat([0, 1], [len(one), len(two)]), np.concatenate((one, two)), 2)
            if 100 * common >= 92 * union:
                assert set(key[text == 0]) & set(key[text == 1])
    assert [len(x) for x in D.minimizers(["", "x"])] == [0, 0]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, s string, g int")
    assert D.near_pairs(empty, "id", "s").count() == 0 and D.duplicate_groups(empty, "id", "s", "g").count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_texts_of_common_parts_are_not_compared_in_pairs(monkeypatch, block):
    """Texts of one set of syllables agree in parts of their gram sets by chance; their sketches part them, before any text is sent."""
    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(9)
    syllables = ["the", "tion", "ing", "er", "on", "at", "re", "nd", "ha", "es", "or", "an", "ou", "ea", "st", "en", "ti", "is", "in", "he", "al", "le", "wh", "ly", "ed"]
    made = ["".join(r.choices(syllables, k=400)) for _ in range(250)]
    made += [t[:500] + "qq" + t[500:] for t in made[:20]]
    table = lambda f: pa.Table.from_batches(f([pa.record_batch({"id": list(range(len(made))), "t": made})]))
    keys, found, met = table(D._keys), set(), 0
    sketches = {(x["id"], x["level"]): x for x in table(D._sketches).to_pylist()}
    for bucket in keys.column("bucket").unique().to_pylist():
        rivals = D._rivals(keys.filter(pa.array([x == bucket for x in keys.column("bucket").to_pylist()])))
        met += rivals.num_rows
        own = [sketches[x["id"], x["level"]] for x in rivals.to_pylist()]
        found |= {(x["s"], x["id"]) for x in D._compared(rivals.append_column("size", pa.array([x["size"] for x in own], pa.int32())).append_column("sketch", pa.array([x["sketch"] for x in own], pa.binary()))).to_pylist()}
    want = {(i, j) for j in range(len(made)) for i in range(j) if near(made[i], made[j])}
    assert met > 10 * len(want) and want <= found and len(found) <= len(want) + 5 and {(k, 250 + k) for k in range(20)} <= want
