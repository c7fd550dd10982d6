"""Approximate nearest neighbours by largest inner product: inverted lists, scanned dimension block by dimension block.

For dealing, inner products become distances by one more dimension, sqrt(m - |x|^2) with m the largest squared norm (0 for
a query). Vectors are dealt to the nearest of about sqrt(N) centroids, LISTS at most. Within a list, vectors of unit length are rotated by a random
orthogonal matrix and their squared distance is summed over blocks of columns. The null hypothesis is that a candidate's product is
at least the query's K-th best so far, the limit t; its unit vector is then at most 2 - 2 t / (|q| |x|) away, a bound of each pair's own,
so that vectors too short to reach t go at once. After a random rotation the share of the distance that lies in d of D
dimensions has mean d / D and variance 2 d (D - d) / (D^2 (D + 2)), so a candidate is given up when its partial distance
exceeds the bound times that mean plus Z deviations. What is left is ranked by the exact product of the original vectors.

1. Each query scans its nearest list: a few candidates whole, which gives a first limit, then the others by the tests.
2. Its K-th best there is the limit with which it scans the other lists it probes, so that the tests act from the
   first columns on, however short a list is.

How many lists are probed is read off the sample that the centroids are fitted on: as many as its own vectors need to find
TARGET of their neighbours, and in any case so many that they hold K candidates.

Short lists are scanned in groups, long ones in blocks, the queries that ask a group in chunks of that group; all by bounded sizes and hashes
of ids, so a list that holds a third of all vectors is many tasks, and vectors are sent once for each chunk that asks them. Centroids are fitted on at most SAMPLE vectors; every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
#: Vectors that centroids and the number of probes are fitted on, at most; and at most this many bytes of them.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: Vectors up to which there is one list, so that the search is over all; and lists at most.
ONE_LIST, LISTS = 512, 1024
TARGET = 0.965
COLUMNS = 16
#: Deviations beyond which a candidate is given up.
Z = 2.6
#: Bytes of vectors that a task takes up at once, and queries.
BLOCK_BYTES, CHUNK = 8 << 20, 4096
#: Pairs that are scanned at once.
PAIRS = 1 << 21
SEED = 11


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors as little-endian doubles. Null ids, null, empty or zero vectors and those with null or non-finite parts take no part.

    Rows that repeat an id are one vector, the one with the smallest bytes. Vectors of another length than most have
    (of equally many, the longer) take no part."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                a = np.array(v, np.float64)
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")
    rows = materialize(rows, "valid")
    length = rows.groupBy(F.length("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    return rows.where(F.length("v") == (length[0]["n"] if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[k : k + 2048] @ c.T).argmin(axis=1) for k in range(0, len(x), 2048)])


def _centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds if len(c) > 1 else 0):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full]) / n[full, None]
        for empty in np.flatnonzero(n == 0):
            c[empty] = x[rng.integers(len(x))]
    return c


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0, largest - (x * x).sum(axis=1)))[:, None]), axis=1)


def _asking(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.zeros((len(x), 1))), axis=1)


def _rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0]


def _orders(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each query's lists, nearest first."""
    return np.argsort((c * c).sum(axis=1) / 2 - q @ c.T, axis=1, kind="stable")


def probes_needed(x: np.ndarray, largest: float, c: np.ndarray, k: int, target: float = TARGET, queries: int = 400) -> int:
    """How many lists vectors of the sample must probe to find `target` of their k nearest within it. In more vectors
    than the sample neighbours are nearer and lie in fewer lists."""
    if len(c) == 1 or len(x) < 2:
        return 1
    own, lists = x[:queries], _nearest(_lifted(x, largest), c)
    place = np.argsort(_orders(_asking(own), c), axis=1)
    at: list[np.ndarray] = []
    for i, q in enumerate(own):
        s = x @ q
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        at.append(place[i, lists[near]])
    found = np.sort(np.concatenate(at))
    return int(found[min(len(found), math.ceil(target * len(found))) - 1]) + 1


class Counters:
    """Pairs of a query and a candidate that were scanned, those given up before their last column, and column blocks read."""

    def __init__(self):
        self.pairs = self.given_up = self.read = 0


def adaptive_scan(q: np.ndarray, bounds: np.ndarray, blocks: list[np.ndarray], counters: Counters) -> tuple[np.ndarray, np.ndarray]:
    """(query places, candidate places) of the pairs that no test gives up. q: rotated unit queries; blocks: the candidates' rotated
    columns, a block at a time; bounds: each pair's squared distance to beat, infinite where there is none."""
    total, d, partial, alive, qi, ci, early = q.shape[1], 0, None, None, None, None, 0
    n = bounds.size
    counters.pairs += n
    slack = 1e-9 * (1 + np.where(np.isfinite(bounds), np.abs(bounds), 0))
    for c in blocks:
        part = q[:, d : d + c.shape[1]]
        d += c.shape[1]
        share = min(1.0, d / total + Z * math.sqrt(2 * d * (total - d) / (total + 2)) / total)
        if qi is None:  # dense while most pairs are alive
            step = (c * c).sum(axis=1)[None, :] + (part * part).sum(axis=1)[:, None] - 2 * part @ c.T
            partial = step if partial is None else partial + step
            counters.read += n
            near = partial <= bounds * share + slack
            alive = near if alive is None else alive & near
            if np.count_nonzero(alive) * 4 < n:
                qi, ci = np.nonzero(alive)
                partial, bounds, slack = partial[qi, ci], bounds[qi, ci], slack[qi, ci]
        else:
            counters.read += len(qi)
            diff = c[ci] - part[qi]
            partial = partial + np.einsum("ij,ij->i", diff, diff)
            stay = partial <= bounds * share + slack
            qi, ci, partial, bounds, slack = qi[stay], ci[stay], partial[stay], bounds[stay], slack[stay]
        if d < total:
            early = n - (np.count_nonzero(alive) if qi is None else len(qi))
    counters.given_up += early
    return np.nonzero(alive) if qi is None else (qi, ci)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length and the norms, without overflow or underflow on the way."""
    size = np.abs(x).max(axis=1)
    scaled = x / size[:, None]
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / norm[:, None], norm * size


def scan_list(qid: np.ndarray, q: np.ndarray, limits: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, counters: Counters):
    """(query ids, candidate ids, products): each query's k best in one list, by the tests. limits: products to reach; one of minus infinity is first set from a
    few whole candidates."""
    units, norms = _units(x)
    turned = units @ turn
    blocks = [np.ascontiguousarray(turned[:, j : j + COLUMNS]) for j in range(0, turned.shape[1], COLUMNS)]
    out = []
    size = max(1, PAIRS // len(ids))
    for j in range(0, len(q), size):
        own, mine, limit = q[j : j + size], qid[j : j + size], limits[j : j + size].copy()
        free = np.flatnonzero(~np.isfinite(limit))
        few = min(len(ids), 4 * k)
        if len(free) and few > k:
            s = own[free] @ x[:few].T
            s[mine[free][:, None] == ids[None, :few]] = -np.inf
            limit[free] = np.partition(s, few - k, axis=1)[:, few - k]
        asked, lengths = _units(own)
        qi, ci = adaptive_scan(asked @ turn, 2 - 2 * (limit / lengths)[:, None] / norms[None, :], blocks, counters)
        other = ids[ci] != mine[qi]
        qi, ci = qi[other], ci[other]
        s = np.concatenate([np.einsum("ij,ij->i", x[ci[a : a + 65536]], own[qi[a : a + 65536]]) for a in range(0, len(qi), 65536)] or [np.empty(0)])
        order = np.lexsort((ids[ci], -s, qi))
        first = np.searchsorted(qi[order], qi[order], "left")
        order = order[np.arange(len(order)) - first < k]
        out.append((mine[qi[order]], ids[ci[order]], s[order]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def search(vectors: DataFrame, is_query, k: int = K, lists: int | None = None, probed: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", counted: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among all other ids; ties go to the smaller id.

    is_query: a condition on the column id. lists, probed: set the number of lists and of those probed instead of fitting them.
    No valid vectors give no rows; with fewer candidates than k all are returned; up to ONE_LIST vectors the search is over all.
    Rows that repeat an id are one vector; see clean_vectors for what takes no part.
    counted: returns a row a task instead (pairs, given_up, read) with what the tests of the second scan did."""
    spark = vectors.sparkSession
    rows = materialize(clean_vectors(vectors, id_col, vec_col), "vectors")
    out = "query_id long, rank int, vec_id long, score double"

    def largest_norm(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max([0.0, *(float(a @ a) for b in batches for a in map(np.frombuffer, b.column(1).to_pylist()))])], pa.float64())], ["m"])

    total, width = rows.agg(F.count("*"), F.max(F.length("v"))).collect()[0]
    if not total:
        return spark.createDataFrame([], out)
    dim = width // 8
    m = rows.mapInArrow(largest_norm, "m double").agg(F.max("m")).collect()[0][0]
    x = np.stack([np.frombuffer(bytes(r[0])) for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(2, min(SAMPLE, SAMPLE_BYTES // width))).select("v").collect()])
    n_lists = lists or (1 if total <= ONE_LIST else min(LISTS, round(math.sqrt(total)), max(1, len(x) // 16)))
    centroids = _centroids(_lifted(x, m), n_lists)
    probes = min(len(centroids), probed or probes_needed(x, m, centroids, k))
    model = spark.sparkContext.broadcast((centroids, _rotation(dim)))

    def deal(batches):
        for b in batches:
            if b.num_rows:
                v = np.stack(list(map(np.frombuffer, b.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_nearest(_lifted(v, m), model.value[0]), pa.int32())], ["id", "v", "list"])

    base = materialize(rows.mapInArrow(deal, "id long, v binary, list int"), "lists")
    counts = np.zeros(len(centroids), np.int64)
    for r in base.groupBy("list").count().collect():  # a row a list
        counts[r[0]] = r[1]
    # lists in groups of about a block; a longer list is its own group, in blocks
    cap = max(64, BLOCK_BYTES // width)
    block = min(cap, max(1024, total // 48))
    group, filled = np.zeros(len(counts), np.int32), 0
    for i in range(1, len(counts)):
        filled += counts[i - 1]
        group[i] = group[i - 1] + (filled + counts[i] > block)
        filled = 0 if group[i] > group[i - 1] else filled
    places = [(int(i), int(group[i]), max(1, -(-int(counts[i]) // cap))) for i in range(len(counts))]
    blocks_of = np.zeros(int(group[-1]) + 1, np.int32)
    for _, g, nb in places:
        blocks_of[g] = max(blocks_of[g], nb)
    table = F.broadcast(spark.createDataFrame(places, "list int, grp int, nb int"))
    dealt = spark.sparkContext.broadcast((counts, group, blocks_of))

    def ask(first: bool):
        """A row for each group that a query probes: its nearest list's alone, or all the others'."""

        def run(batches):
            counts_, group_, blocks_ = dealt.value
            for b in batches:
                for j in range(0, b.num_rows, 64):
                    c = b.slice(j, 64)
                    orders = _orders(_asking(np.stack(list(map(np.frombuffer, c.column(1).to_pylist())))), model.value[0])
                    at, grp, own = [], [], []
                    for i, order in enumerate(orders):
                        # the lists probed hold at least k other candidates, if there are so many
                        n = max(probes, int(np.searchsorted(np.cumsum(counts_[order]), k + 1)) + 1)
                        near = order[:1] if first else order[1:n]
                        for g in np.unique(group_[near]).tolist():
                            at.append(i)
                            grp.append(g)
                            own.append(near[group_[near] == g].astype(np.int32).tobytes())
                    cols = [col.take(pa.array(at, pa.int64())) for col in c.columns]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(grp, pa.int32()), pa.array(blocks_[grp], pa.int32()), pa.array(own, pa.binary())], ["id", "v", "lim", "grp", "nb", "lists"])

        return run

    def scan(t: pa.Table, counting: bool) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids = t.column("id").to_numpy()
        flat = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(len(ids), dim)
        lim, own = t.column("lim").to_numpy(zero_copy_only=False), t.column("lists").to_pylist()
        cand, qs = np.flatnonzero(~asks), np.flatnonzero(asks)
        of = t.column("list").to_numpy(zero_copy_only=False)[cand]
        cand = cand[np.lexsort((ids[cand], of))]
        of = t.column("list").to_numpy(zero_copy_only=False)[cand]
        wanted = [np.frombuffer(own[j], np.int32) for j in qs]
        w, who = np.concatenate(wanted or [np.empty(0, np.int32)]), np.repeat(qs, [len(x) for x in wanted])
        counters, parts = Counters(), []
        for i in np.unique(of):
            c, q = cand[of == i], who[w == i]
            if len(q):
                parts.append(scan_list(ids[q], flat[q], lim[q], ids[c], flat[c], model.value[1], k, counters))
        if counting:
            return pa.table({"pairs": [counters.pairs], "given_up": [counters.given_up], "read": [counters.read]})
        a, b, s = (np.concatenate(c) for c in zip(*parts)) if parts else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    place = F.xxhash64("id")
    listed = base.join(table, "list").select("grp", F.pmod(place, F.col("nb")).cast("int").alias("block"), "id", "v", F.lit(None).cast("double").alias("lim"), "list", F.lit(None).cast("binary").alias("lists"), F.lit(False).alias("asks"))
    columns = ["grp", "block", "chunk", "id", "v", "lim", "list", "lists", "asks"]

    def scanned(queries: DataFrame, name: str, schema: str, counting: bool = False) -> DataFrame:
        asked = materialize(queries.mapInArrow(ask(name == "near"), "id long, v binary, lim double, grp int, nb int, lists binary"), f"asks_{name}")
        # a group's chunks follow the queries that ask it; nothing is sent for a group that none asks
        size = F.ceil(F.count("*") / F.lit(min(CHUNK, cap))).cast("int").alias("chunks")
        chunks = spark.createDataFrame([tuple(r) for r in asked.groupBy("grp").agg(size).collect()], "grp int, chunks int")  # a row a group
        asked = asked.join(F.broadcast(chunks), "grp").withColumns({"chunk": F.pmod(place, F.col("chunks")).cast("int"), "list": F.lit(None).cast("int"), "asks": F.lit(True)})
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(columns)
        searched = listed.join(F.broadcast(chunks), "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(columns)
        return searched.unionByName(asked).groupBy("grp", "block", "chunk").applyInArrow(lambda t: scan(t, counting), schema)

    found = "query_id long, vec_id long, score double"
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    queries = rows.where(is_query(F.col("id"))).withColumn("lim", F.lit(float("-inf")))
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    seeds = materialize(top(scanned(queries, "near", found)), "seeds")
    far = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))

    lim = F.coalesce("kth", F.lit(float("-inf"))).alias("lim")
    asking = queries.drop("lim").join(far, queries["id"] == far["of"], "left").select("id", "v", lim)
    if counted:
        return scanned(asking, "far", "pairs long, given_up long, read long", True)
    both = seeds.select("query_id", "vec_id", "score").unionByName(scanned(asking, "far", found))
    return top(both).select("query_id", "rank", "vec_id", "score")
