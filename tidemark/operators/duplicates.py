"""Near-equal texts and the groups they form, by equi-joins on minimizers and on parts of gram sets, and by label propagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.scratch import materialize

JACCARD_PERCENT = 92
CONTAINED = 20
#: A minimizer is the smallest hash of ANCHOR characters in any CONTAINED characters.
ANCHOR = 10
#: Sizes of one level differ by less than this factor.
LEVEL = 1.4
#: Characters that are compared before and behind a minimizer, 4 bits of each.
REACH = 8
#: Parts by hash of features, and of what shares them; texts of one key that are compared with one another at once.
BUCKETS, GROUPS, BLOCK = 512, 2048, 1024
#: Bits of a sketch at most.
BITS = 2048
#: Characters whose features a task finds at once, and labels that are broadcast at most, two numbers each.
CHARACTERS, SENT = 2_000_000, 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points (from 1) one after the other, each one's text, and each text's length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    return codes, np.repeat(np.arange(len(texts)), sizes), sizes


def _different(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), by owner."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[first], value[first]


def placed_minimizers(texts: list[str], anchor: int = ANCHOR, window: int = CONTAINED) -> dict[str, np.ndarray]:
    """For any `window` characters of a text the first smallest hash h of `anchor` characters in them, each place once: text, h, near (4 bits of each of
    the REACH characters before and behind it) and room (how many of those the text has, before and behind)."""
    codes, owner, sizes = _codes(texts)
    n = len(codes) - window + 1
    if n <= 0:
        return {"text": np.empty(0, np.int64), "h": np.empty(0, np.uint64), "near": np.empty(0, np.uint64), "room": np.empty(0, np.uint8)}
    h = np.zeros(len(codes) - anchor + 1, np.uint64)
    for k in range(anchor):
        h = h * _MIX[0] + codes[k : k + len(h)]
    h = _mixed(h)
    first = np.lib.stride_tricks.sliding_window_view(h, window - anchor + 1).argmin(axis=1) + np.arange(n)
    at = np.unique(first[owner[:n] == owner[window - 1 :]])
    starts, text = np.cumsum(sizes) - sizes, owner[at]
    before, behind = np.minimum(at - starts[text], REACH), np.minimum((starts + sizes)[text] - at - anchor, REACH)
    nibbles, near = np.pad(_mixed(codes) & np.uint64(15), REACH), np.zeros(len(at), np.uint64)
    for k in range(REACH):
        near |= np.where(k < before, nibbles[at + REACH - 1 - k], np.uint64(0)) << np.uint64(4 * k)
        near |= np.where(k < behind, nibbles[at + REACH + anchor + k], np.uint64(0)) << np.uint64(4 * (REACH + k))
    return {"text": text, "h": h[at], "near": near, "room": (before * 16 + behind).astype(np.uint8)}


def minimizers(texts: list[str], anchor: int = ANCHOR, window: int = CONTAINED) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): for any `window` characters of a text the smallest hash of `anchor` characters in them. A text that is contained in another
    one has none that the other one has not."""
    found = placed_minimizers(texts, anchor, window)
    return _different(found["text"], found["h"])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): the distinct 3-grams of each text as numbers; a text of up to 3 characters is one gram."""
    codes, owner, sizes = _codes(texts)
    ends = np.cumsum(sizes)
    near = lambda k: np.where(np.arange(len(codes)) + k < ends[owner], np.concatenate((codes[k:], np.zeros(k, np.uint64)))[: len(codes)], np.uint64(0))
    second, third = near(1), near(2)
    place = np.arange(len(codes)) - (ends - sizes)[owner]
    use = (third > 0) | (place == 0)
    return _different(owner[use], (codes << np.uint64(42) | second << np.uint64(21) | third)[use])


def _levels(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each size's level, and whether a larger partner may be in the next one."""
    level = np.floor(np.log(sizes) / np.log(LEVEL)).astype(np.int64)
    return level, np.floor(np.log(sizes * (100.01 / JACCARD_PERCENT)) / np.log(LEVEL)).astype(np.int64) > level


def _most(level: np.ndarray) -> np.ndarray:
    """How many grams two alike sets of a level differ in at most."""
    return (np.floor(LEVEL ** (level + 1)).astype(np.int64) + 1) * 2 * (100 - JACCARD_PERCENT) // (100 + JACCARD_PERCENT)


def set_parts(owner: np.ndarray, gram: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): equal for two texts at least once if the Jaccard of their gram sets is JACCARD_PERCENT or more.

    Sets of such a Jaccard differ in at most a 24th of their sizes' sum, d grams. Dealt by hash to d + 1 parts, they agree in a whole part.
    d is that of the largest size of a level; a text has the parts of its own level, and of the next one if a larger partner may be there."""
    return levelled_parts(owner, gram, n_texts)[:2]


def levelled_parts(owner: np.ndarray, gram: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """set_parts, and the level of each key."""
    level, beyond = _levels(np.maximum(np.bincount(owner, minlength=n_texts), 1))
    mixed, texts, keys, levels = _mixed(gram), [], [], []
    for step, has in ((0, np.ones(n_texts, bool)), (1, beyond)):
        parts = np.where(has, _most(level + step) + 1, 0)
        starts, own = np.cumsum(parts) - parts, has[owner]
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, starts[owner[own]] + (mixed[own] % parts[owner[own]].astype(np.uint64)).astype(np.int64), _mixed(mixed[own]))
        text = np.repeat(np.arange(n_texts), parts)
        part = np.arange(len(text)) - starts[text]
        texts.append(text)
        keys.append(_mixed(sums ^ _mixed(((level + step)[text].astype(np.uint64) << np.uint64(40)) | part.astype(np.uint64))))
        levels.append((level + step)[text])
    return np.concatenate(texts), np.concatenate(keys), np.concatenate(levels)


def _by_size(texts: list[str]):
    """Ranges of texts of about CHARACTERS characters."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHARACTERS):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


#: Features of many texts are one row a bucket; each column holds one kind of number of all of them.
_INDEX = {"h": np.uint64, "id": np.int64, "near": np.uint64, "n": np.int32, "m": np.int32, "room": np.uint8}
_KEYS = {"h": np.uint64, "id": np.int64, "level": np.uint8}
_SHARED = _INDEX | {"f": np.int32}


def _schema(kinds: dict) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in kinds)


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray], kinds: dict) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*firsts[1:], len(bucket)]
    data = {c: columns[c].astype(t)[order] for c, t in kinds.items()}
    cells = [pa.array([data[c][i:j].tobytes() for i, j in zip(firsts, ends)], pa.binary()) for c in kinds]
    return pa.RecordBatch.from_arrays([pa.array(bucket[firsts], pa.int32()), *cells], ["bucket", *kinds])


def _opened(table: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in kinds.items()}


def _index(batches):
    """The minimizers of each (id, t), with the text's length n and how many different ones it has, m."""
    for b in batches:
        ids, all_texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        for i, j in _by_size(all_texts):
            found = placed_minimizers(all_texts[i:j])
            text = found.pop("text")
            many, sizes = np.bincount(_different(text, found["h"])[0], minlength=j - i), np.array([len(t) for t in all_texts[i:j]])
            if len(text):
                yield _packed((found["h"] % np.uint64(BUCKETS)).astype(np.int32), found | {"id": ids[i:j][text], "n": sizes[text], "m": many[text]}, _INDEX)


def _keys(batches):
    """The keys of each (id, t)'s parts."""
    for b in batches:
        ids, all_texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        for i, j in _by_size(all_texts):
            text, key, level = levelled_parts(*grams(all_texts[i:j]), j - i)
            if len(text):
                yield _packed((key % np.uint64(BUCKETS)).astype(np.int32), {"h": key, "id": ids[i:j][text], "level": level}, _KEYS)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's minimizers those that two texts or more have, with their number of texts f."""
    own = _opened(table, _INDEX)
    order = np.lexsort((own["id"], own["h"]))
    own = {c: v[order] for c, v in own.items()}
    starts, sizes = _runs(own["h"])
    new = np.concatenate(([1], (own["id"][1:] != own["id"][:-1]) | (own["h"][1:] != own["h"][:-1]))) if len(order) else np.empty(0, np.int64)
    f = np.repeat(np.add.reduceat(new, starts), sizes) if len(order) else np.empty(0, np.int64)
    own = {c: v[f > 1] for c, v in (own | {"f": f}).items()}
    return pa.Table.from_batches([_packed((own["id"] % BUCKETS).astype(np.int32), own, _SHARED)])


def _by_hash(batches):
    """The same minimizers in buckets by their hash."""
    for b in batches:
        own = _opened(pa.Table.from_batches([b]), _SHARED)
        if len(own["h"]):
            yield _packed((own["h"] % np.uint64(BUCKETS)).astype(np.int32), own, _SHARED)


def _anchors(table: pa.Table) -> pa.Table:
    """Of texts whose minimizers all occur elsewhere the rarest one, at its first place."""
    own = _opened(table, _SHARED)
    order = np.lexsort((own["h"], own["f"], own["id"]))
    own = {c: v[order] for c, v in own.items()}
    starts, sizes = _runs(own["id"])
    new = np.concatenate(([1], (own["id"][1:] != own["id"][:-1]) | (own["h"][1:] != own["h"][:-1]))) if len(order) else np.empty(0, np.int64)
    whole = starts[np.add.reduceat(new, starts) == own["m"][starts]] if len(order) else starts
    own = {c: v[whole] for c, v in own.items()}
    return pa.Table.from_batches([_packed((own["h"] % np.uint64(BUCKETS)).astype(np.int32), own, _SHARED)])


def _met(table: pa.Table, others: pa.Table) -> pa.Table:
    """(id, s): the anchor of s is a minimizer of the longer text id, with the same characters around it as far as s has any."""
    one, own = _opened(table, _SHARED), _opened(others, _SHARED)
    order = np.argsort(own["h"], kind="stable")
    own = {c: v[order] for c, v in own.items()}
    low, high = np.searchsorted(own["h"], one["h"], "left"), np.searchsorted(own["h"], one["h"], "right")
    full = np.array([(1 << 4 * k) - 1 for k in range(REACH + 1)], np.uint64)
    mask = full[one["room"] >> 4] | full[one["room"] & 15] << np.uint64(4 * REACH)
    ids, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(len(one["id"])):
        there = slice(low[k], high[k])
        hit = (own["n"][there] > one["n"][k]) & (((own["near"][there] ^ one["near"][k]) & mask[k]) == 0)
        ids.append(np.unique(own["id"][there][hit]))
        s.append(np.full(len(ids[-1]), one["id"][k]))
    return pa.table({"id": np.concatenate(ids), "s": np.concatenate(s)})


def _rivals(table: pa.Table) -> pa.Table:
    """Of a bucket's keys those of two texts or more, in groups that are compared: a key's texts, or two blocks of them (other: of the second)."""
    own = _opened(table, _KEYS)
    order = np.argsort(own["h"], kind="stable")
    own = {c: v[order] for c, v in own.items()}
    starts, sizes = _runs(own["h"])
    f, place = np.repeat(sizes, sizes), np.arange(len(order)) - np.repeat(starts, sizes)
    take = np.flatnonzero((f > 1) & (f <= BLOCK))
    rows, group, other = [take], [own["h"][take]], [np.zeros(len(take), bool)]
    for at, n in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK]):
        blocks = -(-n // BLOCK)
        for i in range(blocks):
            for j in range(i, blocks):
                both = [np.flatnonzero(place[at : at + n] // BLOCK == k) + at for k in ((i, j) if i < j else (i,))]
                rows += both
                group += [np.full(len(x), _mixed(own["h"][at : at + 1] + np.uint64(i * blocks + j + 1))[0]) for x in both]
                other += [np.full(len(x), k == 1) for k, x in enumerate(both)]
    rows, group = np.concatenate(rows), np.concatenate(group)
    return pa.table({"bucket": (group % np.uint64(GROUPS)).astype(np.int32), "group": group.view(np.int64), "other": np.concatenate(other), "id": own["id"][rows], "level": own["level"][rows].astype(np.int32)})


def _sketches(batches):
    """Of each (id, t) and level: its number of grams, and the parity of the grams in each of as many cells as make unlike sets differ too much."""
    for b in batches:
        ids, all_texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        out: list = [[], [], [], []]
        for i, j in _by_size(all_texts):
            owner, gram = grams(all_texts[i:j])
            sizes = np.bincount(owner, minlength=j - i)
            (level, beyond), ends, mixed = _levels(np.maximum(sizes, 1)), np.cumsum(sizes), _mixed(gram ^ _MIX[1])
            for k in range(j - i):
                for step in range(1 + int(beyond[k])):
                    bits = min(BITS, -(-4 * int(_most(level[k : k + 1] + step)[0] + 1) // 64) * 64)
                    cells = np.bincount((mixed[ends[k] - sizes[k] : ends[k]] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                    for c, v in zip(out, (ids[i + k], level[k] + step, sizes[k], np.packbits(cells.astype(np.uint8)).tobytes())):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["id", "level", "size", "sketch"])


def _compared(table: pa.Table) -> pa.Table:
    """(id, s) with s < id of a group whose sizes and sketches differ by no more than those of alike sets."""
    # a level of its own for each group, even where two keys have one hash
    group = table.column("group").to_numpy() + table.column("level").to_numpy().astype(np.int64) * np.int64(0x9E3779B97F4A7C1)
    order = np.argsort(group, kind="stable")
    ids, sizes, other = (table.column(c).to_numpy()[order] for c in ("id", "size", "other"))
    sketches, a, b = table.column("sketch").take(pa.array(order)).to_pylist(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, n in zip(*_runs(group[order])):
        bits = np.frombuffer(b"".join(sketches[at : at + n]), np.uint64).reshape(n, -1)
        own, size, second = ids[at : at + n], sizes[at : at + n].astype(np.int64), other[at : at + n]
        for k in range(n - 1 if not second.any() else n):
            if second[k]:
                continue
            to = np.flatnonzero(second) if second.any() else np.arange(k + 1, n)
            most = (size[to] + size[k]) * (100 - JACCARD_PERCENT) // (100 + JACCARD_PERCENT)
            near = np.abs(size[to] - size[k]) <= most
            to, most = to[near], most[near]
            hit = to[np.bitwise_count(bits[to] ^ bits[k]).sum(axis=1, dtype=np.int64) <= most]
            hit = hit[own[hit] != own[k]]
            a.append(np.maximum(own[hit], own[k]))
            b.append(np.minimum(own[hit], own[k]))
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
    return pa.table({"id": np.ascontiguousarray(pairs[:, 0]), "s": np.ascontiguousarray(pairs[:, 1])})


def _alike(batches):
    """The (a, b) whose texts have a Jaccard of JACCARD_PERCENT."""
    for b in batches:
        pairs = []
        for i, j, s, t in zip(*(c.to_pylist() for c in b.columns)):
            one, two = ({x[k : k + 3] for k in range(len(x) - 2)} or {x} for x in (s, t))
            common = len(one & two)
            if 100 * common >= JACCARD_PERCENT * (len(one) + len(two) - common):
                pairs.append((min(i, j), max(i, j)))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_pairs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b) with a < b for near-duplicate texts: equal without spaces and marks, one of 20 and more characters contained in
    the other, or character 3-gram Jaccard of at least 0.92. Empty and null texts pair with nothing.

    Equal texts are linked to the smallest id only. Of distinct texts, a contained one meets the others at its rarest minimizer and the characters
    around it, and is left out if any of its minimizers occurs nowhere else; alike ones meet where they agree in a part of their gram sets, and
    are left out where their sizes or the parities of their grams differ by more than alike sets' can. Both are checked on the texts. Equal texts
    are told from others by SHA-256."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), T.bare(F.lower(F.col(text_col))).alias("t")).where("length(t) > 0").withColumn("k", F.unhex(F.sha2("t", 256)))
    classes = materialize(base.groupBy("k").agg(F.min("id").alias("id"), F.first("t").alias("t")), "classes")
    equal = base.select("k", "id").join(classes.select("k", F.col("id").alias("a")), "k").where("a < id").select("a", F.col("id").alias("b"))
    texts = classes.select("id", "t")

    # only minimizers of two texts or more are kept; they go by text to find the anchors, which come back to the minimizers
    shared = texts.mapInArrow(_index, _schema(_INDEX)).groupBy("bucket").applyInArrow(_shared, _schema(_SHARED))
    shared = materialize(shared, "shared")
    anchors = shared.groupBy("bucket").applyInArrow(_anchors, _schema(_SHARED))
    again = shared.mapInArrow(_by_hash, _schema(_SHARED))
    met = materialize(anchors.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(_met, "id long, s long"), "met")
    short, long = texts.select(F.col("id").alias("s"), F.col("t").alias("st")), texts
    inside = met.join(short, "s").join(long, "id").where(F.contains("t", F.col("st"))).select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b"))

    rivals = texts.mapInArrow(_keys, _schema(_KEYS)).groupBy("bucket").applyInArrow(_rivals, "bucket int, group long, other boolean, id long, level int")
    rivals = materialize(rivals, "rivals")
    sketches = texts.join(rivals.select("id").distinct(), "id", "left_semi").mapInArrow(_sketches, "id long, level int, size int, sketch binary")
    cand = rivals.join(sketches, ["id", "level"]).groupBy("bucket").applyInArrow(_compared, "id long, s long").distinct()
    alike = materialize(cand, "alike").join(short, "s").join(long, "id").select("id", "s", "t", "st").mapInArrow(_alike, "a long, b long")
    return equal.unionByName(inside).unionByName(alike).distinct()


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, root) with root the smallest id reachable over edges (a, b); nodes without edges are their own root.

    Labels go over edges and then to the label's own label, so a chain of n takes about log n rounds. Only nodes with edges take part."""
    one = edges.select("a", "b").where("a <> b")
    both = materialize(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("m"))
        low = materialize(labels.join(near, labels["id"] == near["a"]).select("id", "root", F.least("root", "m").alias("low")), "low")
        up = low.select(F.col("id").alias("low"), F.col("low").alias("up"))
        used = low.select("low").distinct()
        # the label of a huge component is one key of this join; few labels are sent to all tasks instead, many are a key a row
        up = F.broadcast(up.join(used, "low")) if used.limit(SENT + 1).count() <= SENT else up
        new = materialize(low.join(up, "low").select("id", F.least("low", "up").alias("root"), (F.least("low", "up") < F.col("root")).alias("moved")), "labels")
        labels = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            own = nodes.select(F.col(id_col).alias("id")).distinct()
            return own.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def duplicate_groups(rows: DataFrame, id_col: str, text_col: str, group_col: str | None = None) -> DataFrame:
    """(id, root, group_label): rows of one group_col value and near-duplicate texts share a root.

    The label is a hash of the root, its group_col value (or nothing) and the first 80 characters of its text without spaces and marks."""
    edges = near_pairs(rows, id_col, text_col)
    if group_col:
        first = rows.groupBy(group_col).agg(F.min(id_col).alias("a"))
        edges = edges.unionByName(rows.join(first, group_col).where(F.col("a") < F.col(id_col)).select("a", F.col(id_col).alias("b")))
    group = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
    begin = F.substring(T.bare(F.lower(F.col(text_col))), 1, 80)
    labels = rows.select(F.col(id_col).alias("root"), F.concat(F.lit("grp_"), T.group_label(F.concat_ws(":", F.col(id_col).cast("string"), group, begin))).alias("group_label"))
    found = materialize(components(rows, edges, id_col), "roots")
    labels = labels.join(found.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("group_label").alias("group_label"))
    labels = materialize(labels, "group_labels")
    few = labels.limit(SENT + 1).count() <= SENT
    return found.join(F.broadcast(labels) if few else labels, "root").select("id", "root", "group_label")
