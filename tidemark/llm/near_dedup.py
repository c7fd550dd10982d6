"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes) and a signature of
   COORDINATES minima. Texts with equal sets form a class; only its smallest doc_id goes on.
2. Prefix: two signatures that agree in MATCHES of their coordinates share at least one among the
   COORDINATES - MATCHES + 1 coordinate values that come first in any one order. The order here is
   rarest first, after a table of counts of fixed size, so common passages are skipped.
3. Representatives are posted under those coordinate-value pairs. In each posting list the most
   central document is the pivot, and every other one is paired with it: pairs grow with the
   number of postings, never with the square of a list.
4. A pair is kept when it has MATCHES collisions over the whole signatures, and confirmed on the full sets;
   only the kept pairs' texts are turned into sets again.
5. Lists that still hold more than one component are taken up again: their documents outside the
   pivot's component are compared with all documents of those lists, in blocks, first by collisions and
   then by counting along the inverted lists of the full sets. So no link between different texts that
   share a posting is lost.

A pair of exactly the limit's similarity fails step 2 with a probability of 3e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, marked, materialize, sliced, slots_of, sum_arrays
from .components import connected_components

WORDS = 5
PERCENT = 75
COORDINATES = 64
MATCHES = 28
SLOTS = 1 << 21
Q_BLOCK = 256
D_BLOCK = 1024
WORD_CACHE = 120_000

_MULTIPLIERS = np.random.default_rng(20240607).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased, words split at the six ASCII spaces."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, n)
    width = min(words, n)
    out = h[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = _mixed(out) * _MIX + h[k : n - width + 1 + k]
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima, 32 bits each; long sets are taken in pieces, so memory stays flat."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(best, np.multiply.outer(_MULTIPLIERS, shingles[k : k + 4096]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signed(batches):
    claim("shingles", _words.clear)
    for b in sliced(batches):
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        full = [len(s) > 0 for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full)], pa.binary()),
                pa.array([signature(s).tobytes() if f else None for s, f in zip(sets, full)], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_key", "sig"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _keys(sig: np.ndarray) -> np.ndarray:
    k = sig.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))
    return _mixed(_mixed(k + _MIX))


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def _count_slots(batches) -> np.ndarray:
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        if b.num_rows:
            total += np.bincount(_slots(_keys(_matrix(b.column(0)))).ravel(), minlength=SLOTS)
    return total


def _poster(counts):
    prefix = COORDINATES - MATCHES + 1

    def post(batches):
        common = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.sort(_keys(_matrix(b.column(1))), axis=1)
            seen = common[_slots(keys)]
            first = np.argsort(seen, axis=1, kind="stable")[:, :prefix]
            chosen = np.take_along_axis(keys, first, axis=1).view(np.int64)
            score = (np.log2(seen + 1.0).sum(axis=1) * 100).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, chosen.size + 1, prefix), pa.int32()), pa.array(chosen.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.int64()), lists], ["doc", "score", "keys"])

    return post


def _sets(bitmap):
    def run(batches):
        claim("shingles", _words.clear)
        seen = np.unpackbits(bitmap.value.view(np.uint8), bitorder="little").astype(bool)
        for b in batches:
            b = b.filter(pa.array(seen[slots_of(b.column(0).to_numpy(zero_copy_only=False), len(seen))]))
            for c in sliced([b]):
                sets = [shingle_set(t) for t in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "shingles"])

    return run


def similar(common: int, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _colliding(batches):
    """Keeps pairs with MATCHES collisions over the whole signatures."""
    for b in batches:
        if b.num_rows:
            yield b.filter(pa.array((_matrix(b.column(2)) == _matrix(b.column(3))).sum(axis=1) >= MATCHES)).select([0, 1])


def _confirm(batches):
    """Keeps pairs whose full sets are similar."""
    for b in batches:
        docs, pivots, ta, tb = (b.column(k).to_pylist() for k in range(4))
        keep: list[int] = []
        for i in range(b.num_rows):
            x, y = np.frombuffer(ta[i], np.uint64), np.frombuffer(tb[i], np.uint64)
            if similar(len(x) + len(y) - len(np.unique(np.concatenate((x, y)))), len(x), len(y)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in keep], pa.int64()), pa.array([pivots[i] for i in keep], pa.int64())], ["a", "b"])


def _block_colliding(key, table):
    """One block: the documents of different components that have MATCHES collisions with each other."""
    query = table.column("query").to_numpy()
    doc, comp = table.column("doc").to_numpy(), table.column("comp").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    ds, hit = np.flatnonzero(~query), np.zeros(len(doc), bool)
    for i in np.flatnonzero(query) if len(ds) else ():
        near = ds[((sig[ds] == sig[i]).sum(axis=1) >= MATCHES) & (comp[ds] != comp[i])]
        hit[near] = True
        hit[i] |= len(near) > 0
    out = np.unique(doc[hit])
    return pa.table({"cluster": pa.array(np.full(len(out), key[0].as_py()), pa.int64()), "doc": pa.array(out, pa.int64())})


def _block_links(table: pa.Table) -> pa.Table:
    """One block: queries against documents, by counting along the inverted lists of the full sets."""
    doc, comp, query, sets = (table.column(c).to_pylist() for c in ("doc", "comp", "query", "shingles"))
    ds, qs = [i for i, q in enumerate(query) if not q], [i for i, q in enumerate(query) if q]
    out: list[tuple[int, int]] = []
    if ds and qs:
        member = [np.frombuffer(sets[i], np.uint64) for i in ds]
        sizes = np.array([len(m) for m in member])
        values, owner = np.concatenate(member), np.repeat(np.arange(len(ds)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        comps = np.array([comp[i] for i in ds])
        for i in qs:
            s = np.frombuffer(sets[i], np.uint64)
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(ds))
            hit = (100 * common >= PERCENT * (len(s) + sizes - common)) & (comps != comp[i])
            seen: dict[int, int] = {}
            for j in np.flatnonzero(hit):
                seen.setdefault(int(comps[j]), doc[ds[j]])
            out += [(doc[i], d) for d in seen.values()]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """pairs (doc, pivot) as (of, pivot, own, theirs). A pair takes its pivot's value to the document's own; both joins share one
    exchange of the values, and what a common pivot's pairs weigh is split by the adaptive skew join."""
    theirs = pairs.join(values, pairs["pivot"] == values["doc"]).select(pairs["doc"].alias("of"), "pivot", F.col(name).alias("theirs"))
    return theirs.join(values, theirs["of"] == values["doc"]).select("of", "pivot", F.col(name).alias("own"), "theirs")


def _sets_of(texts: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(doc, shingles) of the documents in docs, and of the few others whose bit is set too."""
    bitmap = texts.sparkSession.sparkContext.broadcast(marked(docs.distinct()))
    return materialize(texts.mapInArrow(_sets(bitmap), "doc long, shingles binary"), name)


def _blocks(rows: DataFrame, value: str) -> DataFrame:
    """rows (cluster, doc, comp, value) dealt to blocks: those outside the cluster's component ask, against all of the cluster."""
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("nd"), F.count_if(F.col("comp") != F.col("cluster")).alias("nq"))
    sizes = materialize(sizes.select("cluster", F.ceil(F.col("nd") / D_BLOCK).cast("int").alias("nd"), F.greatest(F.lit(1), F.ceil(F.col("nq") / Q_BLOCK)).cast("int").alias("nq")), "sizes")
    full = rows.join(sizes, "cluster")
    at = F.xxhash64("doc", F.lit(7))
    asked = full.where("comp <> cluster").withColumns({"query": F.lit(True), "qb": F.pmod(at, F.col("nq")).cast("int"), "db": F.explode(F.sequence(F.lit(0), F.col("nd") - 1))})
    searched = full.withColumns({"query": F.lit(False), "db": F.pmod(at, F.col("nd")).cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.col("nq") - 1))})
    cols = ["cluster", "qb", "db", "doc", "comp", "query", value]
    return asked.select(cols).unionByName(searched.select(cols))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Null, empty and blank texts have no shingles and are linked with nothing; rows whose id is null
    keep a null component and are kept. Repeated rows share their class. Ties between pivots go to
    the smaller id. Other columns of docs are ignored, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = materialize(texts.mapInArrow(_signed, "doc_id long, n_shingles long, set_key binary, sig binary"), "signatures")
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    counts = sum_arrays(classes.select("sig"), _count_slots, SLOTS, kind=np.uint32)
    common = spark.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))
    posted = classes.select("doc", "sig").mapInArrow(_poster(common), "doc long, score long, keys array<bigint>").select("doc", "score", F.explode("keys").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("score", (-F.col("doc")).alias("less"))).alias("top")).where("n > 1")
    lists = materialize(lists.select("key", "n", (-F.col("top.less")).alias("pivot")), "lists")
    members = materialize(posted.select("key", "doc").join(lists, "key"), "members")

    texts = texts.where("doc_id is not null")
    signs = classes.select("doc", "sig")
    pairs = _with_both(members.where("doc <> pivot").select("doc", "pivot").distinct(), signs, "sig")
    pairs = materialize(pairs.mapInArrow(_colliding, "doc long, pivot long"), "pairs")
    sets = _sets_of(texts, pairs.select("doc").union(pairs.select("pivot")), "sets")
    stars = materialize(_with_both(pairs, sets, "shingles").mapInArrow(_confirm, "a long, b long"), "stars")
    first = connected_components(stars)

    # lists of more than a pair that still hold several components
    held = members.where("n > 2").select("key", "doc", "pivot").join(first.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "pivot", F.coalesce("label", "doc").alias("comp"))
    held = materialize(held, "held")
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("doc") == F.col("pivot"), F.col("comp"))).alias("cluster")).where("lo <> hi")
    mixed = materialize(mixed.select("key", "cluster"), "mixed")
    rows = materialize(held.join(mixed, "key").select("cluster", "doc", "comp").distinct(), "rows")
    near = _blocks(rows.join(signs, "doc"), "sig").groupBy("cluster", "qb", "db").applyInArrow(_block_colliding, "cluster long, doc long")
    near = materialize(rows.join(near.distinct(), ["cluster", "doc"]), "near")
    more = _sets_of(texts, near.select("doc"), "more_sets")
    found = _blocks(near.join(more, "doc"), "shingles").groupBy("cluster", "qb", "db").applyInArrow(_block_links, "a long, b long")
    links = materialize(stars.unionByName(found), "links")
    last = connected_components(links)

    labels = classes.select("set_key", "doc").join(last.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.coalesce("label", "doc").alias("component"))
    labels = materialize(labels, "class_labels")
    joined = base.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
