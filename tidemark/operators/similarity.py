"""TF-IDF similarity of neighbouring documents, fitted on all of them or only on those up to each one.

A document and the one before it meet in blocks of positions, each of which also has the last document of the block before. Terms are told apart by
64-bit hashes. Only frequencies of terms (over all documents, or a row a term and block) are shuffled, no row a document and term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block, and terms whose frequencies all tasks get; more of them are joined by block.
BLOCK, TERMS = 512, 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashed_grams(text: str | None, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of a text's character n-grams with multiplicity; a text that is not longer than n is its only n-gram."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = [np.empty(0, np.uint64)]
    for n in sizes:
        own = min(n, len(codes))
        h = np.zeros(len(codes) - own + 1 if own else 0, np.uint64)
        for k in range(own):
            h = h * _MIX[0] + codes[k : k + len(h)]
        out.append(h)
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def blocks(docs: DataFrame, *columns: Column, block: int = BLOCK) -> DataFrame:
    """docs by block (column block): idx and columns; the last position of a block is in the next one too."""
    own = F.floor(F.col("idx") / block)
    both = F.when((F.col("idx") + 1) % block == 0, F.array(own, own + 1)).otherwise(F.array(own))
    return docs.select(F.explode(both).alias("block"), "idx", *columns)


def _counted(column, grams: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, frequencies) of each document, by term."""
    each = (hashed_grams(t.as_py(), grams) for t in column) if grams else (np.array(t.values) if t.is_valid else np.empty(0, np.int64) for t in column)
    return [np.unique(t, return_counts=True) for t in each]


def _cosine(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float | None:
    """Of two weighted sets of places; none where either has no length."""
    size = np.sqrt(one[1] @ one[1]) * np.sqrt(two[1] @ two[1])
    _, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    return float(one[1][a] @ two[1][b] / size) if size > 0 else None


_FOUND = "idx long, similarity double"


def _result(docs: DataFrame, found: DataFrame, missing: Column) -> DataFrame:
    return docs.select("idx").join(found, "idx", "left").select("idx", F.when(F.col("idx") > 0, F.coalesce("similarity", missing)).alias("similarity"))


def _source(docs: DataFrame, terms: Column, grams: tuple[int, ...], block: int) -> DataFrame:
    return blocks(docs, (terms if grams else F.transform(terms, lambda t: F.xxhash64(t))).alias("terms"), block=block)


def _block_counts(source: DataFrame, grams: tuple[int, ...], block: int) -> DataFrame:
    """(block, term, df) over each block's own positions."""

    def count(key, table):
        at = table.column("idx").to_numpy() // block == key[0].as_py()
        own = [t for (t, _), k in zip(_counted(table.column("terms"), grams), at) if k]
        term, df = np.unique(np.concatenate([np.empty(0, np.int64), *own]), return_counts=True)
        return pa.table({"block": pa.array(np.full(len(term), key[0].as_py()), pa.int64()), "term": term, "df": df})

    return source.groupBy("block").applyInArrow(count, "block long, term long, df long")


def adjacent_similarity(docs: DataFrame, terms: Column, grams: tuple[int, ...] = (), block: int = BLOCK) -> DataFrame:
    """(idx, similarity) with the document before; weights tf * (ln((1+n)/(1+df)) + 1). The first is null, blank texts give 0.

    docs must have idx 0, 1, 2, ...; repeated texts are documents of their own. terms: an array of strings, or with grams a text whose n-grams of these sizes are the terms."""
    source = _source(docs, terms, grams, block)
    counts = _block_counts(source, grams, block)
    total = counts.groupBy("term").agg(F.sum("df").alias("df"))
    few = total.limit(TERMS + 1).toArrow()
    n_docs, spark = docs.count(), docs.sparkSession
    if few.num_rows <= TERMS:
        order = np.argsort(few.column("term").to_numpy())
        shared = spark.sparkContext.broadcast((few.column("term").to_numpy()[order], few.column("df").to_numpy()[order]))
        found = source.groupBy("block").applyInArrow(lambda key, table: _similar(key, table, *shared.value, n_docs, grams, block), _FOUND)
    else:
        own = counts.select("block", "term").union(counts.select(F.col("block") + 1, "term")).distinct().join(total, "term")
        found = source.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda key, table, by: _similar(key, table, *_sorted(by), n_docs, grams, block), _FOUND)
    return _result(docs, found, F.lit(0.0))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(table.column("term").to_numpy())
    return table.column("term").to_numpy()[order], table.column("df").to_numpy()[order]


def _similar(key, table, terms, df, n_docs, grams, block):
    if not table.num_rows:  # the terms of a last block are sent on to a block that is not there
        return pa.table({"idx": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    table = table.sort_by("idx")
    last, at, out = None, [], []
    for idx, (term, tf) in zip(table.column("idx").to_pylist(), _counted(table.column("terms"), grams)):
        own = term, tf * (np.log((1.0 + n_docs) / (1.0 + df[np.searchsorted(terms, term)])) + 1.0)
        if last is not None:
            at.append(idx)
            out.append(_cosine(own, last))
        last = own
    return pa.table({"idx": pa.array(at, pa.int64()), "similarity": pa.array(out, pa.float64())})


def expanding_similarity(docs: DataFrame, terms: Column, block: int = BLOCK) -> DataFrame:
    """(idx, similarity) with the document before, fitted on documents 0 to idx only; null for the first and where either text is blank.

    A term's frequency up to a document is that of the blocks before, a running sum, and what the block's documents up to it add."""
    source = _source(docs, terms, (), block)
    so_far = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = _block_counts(source, (), block)
    # a block needs the terms of the last document before it too: it takes all frequencies of the terms that it or the block before has
    near = counts.unionByName(counts.select((F.col("block") + 1).alias("block"), "term", F.lit(0).cast("long").alias("df"))).groupBy("block", "term").agg(F.sum("df").alias("df"))
    before = near.select("block", "term", F.coalesce(F.sum("df").over(so_far), F.lit(0)).alias("df"))

    def walk(key, table, by):
        if not table.num_rows:
            return pa.table({"idx": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        names, df = _sorted(by)
        table, df = table.sort_by("idx"), df.astype(float)
        last, at, out = None, [], []
        for idx, (term, tf) in zip(table.column("idx").to_pylist(), _counted(table.column("terms"), ())):
            place = np.searchsorted(names, term)
            if idx // block == key[0].as_py():
                df[place] += 1
                if last is not None:
                    weigh = lambda p, n: (p, n * (np.log((2.0 + idx) / (1.0 + df[p])) + 1.0))  # noqa: B023, E731
                    at.append(idx)
                    out.append(_cosine(weigh(place, tf), weigh(*last)))
            last = place, tf
        return pa.table({"idx": pa.array(at, pa.int64()), "similarity": pa.array(out, pa.float64())})

    found = source.groupBy("block").cogroup(before.groupBy("block")).applyInArrow(walk, _FOUND)
    return _result(docs, found, F.lit(None).cast("double"))


def adjacent_jaccard(docs: DataFrame, text: Column, n: int = 3, block: int = BLOCK) -> DataFrame:
    """(idx, jaccard) of each document's distinct character n-grams with those of the next one; the last has no row. Null where a text is null or both are empty."""

    def compare(table):
        table = table.sort_by("idx")
        own = [np.unique(hashed_grams(t.as_py(), (n,))) if t.is_valid else None for t in table.column("terms")]
        at, out = table.column("idx").to_pylist()[:-1], []
        for one, two in zip(own, own[1:]):
            common = len(np.intersect1d(one, two, assume_unique=True)) if one is not None and two is not None else 0
            union = len(one) + len(two) - common if one is not None and two is not None else 0
            out.append(common / union if union else None)
        return pa.table({"idx": pa.array(at, pa.int64()), "jaccard": pa.array(out, pa.float64())})

    return blocks(docs, text.alias("terms"), block=block).groupBy("block").applyInArrow(compare, "idx long, jaccard double")
