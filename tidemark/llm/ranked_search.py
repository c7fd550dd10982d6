"""The best documents for each of many items, by integer impacts that are accumulated by sorting.

1. Postings. Tasks read whole texts and write one row for each document that has an item's term: its length, its matched terms' numbers
   and their counts. Only terms of items are kept.
2. Statistics. Documents, their terms in all and each term's documents are sums over tasks, of as many numbers as the items have terms.
3. Accumulation. A task holds a range of documents and takes it in blocks. Each of a block's postings becomes the array of its term's
   items, the document and the impact; the arrays are concatenated, (item, document) is packed into a key of as few bits as the block
   needs, keys are radix sorted by digits of 16 bits, and reduceat sums the impacts of equal keys.
4. Selection. A heap for each item keeps a task's best; what tasks keep is ranked in two steps, so no item's rows meet in one task
   before each of SHARES shares of the tasks has come down to the best few.

Items are taken in blocks of about BLOCK_BYTES of text, so what is broadcast does not grow with their number.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced, sum_arrays

TOP = 10
#: Bytes of items' text whose terms are broadcast at once, about.
BLOCK_BYTES = 4 << 20
#: Postings that are put together at once, about; shares that the tasks' best are ranked in first; bytes of a text that are split at once.
ENTRIES, SHARES, SLICE_BYTES = 1 << 20, 64, 1 << 20

# Fixed values of the measure: what a term adds is w * ((SCALE * tf) div (TF * tf + LENGTH * m)), m = BASE - B + ((B * n * N) div L).
SCALE, TF, LENGTH, BASE, B = 1_000_000_000, 1000, 8, 100, 90

#: Bytes that are part of a term stay, A-Z become a-z, all others are spaces; bytes from 128 on belong to characters that are part of a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: str | None) -> tuple[Counter, int]:
    """How often each term (as UTF-8) occurs in the whole text, and the terms in all."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    out: Counter = Counter()
    n = at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + SLICE_BYTES)
        words = raw[at : stop if stop >= 0 else len(raw)].split()
        out.update(words)
        n += len(words)
        at = stop if stop >= 0 else len(raw)
    return out, n


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each posting's part of a score, in 64-bit integers."""
    m = BASE - B + B * n * n_docs // n_terms
    return w * (SCALE * tf // (TF * tf + LENGTH * m))


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of unsigned keys in stable order: one pass for each digit of 16 bits, which numpy's stable sort counts out."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def accumulate(starts: np.ndarray, items: np.ndarray, n_items: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of each pair that shares a term, by item, then doc. Items of term t are items[starts[t] : starts[t + 1]]."""
    many = starts[term + 1] - starts[term]
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    item = items[np.arange(total) + np.repeat(starts[term] - (ends - many), many)]
    low = max(1, (n_docs - 1).bit_length())
    keys = item.astype(np.uint64 if low + n_items.bit_length() > 32 else np.uint32) << low | np.repeat(doc, many).astype(np.uint32)
    order = radix_order(keys, low + n_items.bit_length())
    keys, values = keys[order], np.repeat(impact, many)[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first] >> low).astype(np.int64), (keys[first] & ((1 << low) - 1)).astype(np.int64), np.add.reduceat(values, first)


class Best:
    """A heap of the `top` best (score, smaller document first, any row) for each item."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(n_items)], np.zeros(n_items, np.int64)

    def add(self, item: np.ndarray, doc: list, at: np.ndarray, score: np.ndarray) -> None:
        hit = (score > 0) & (score >= self.least[item])
        for i, d, s in zip(item[hit].tolist(), at[hit].tolist(), score[hit].tolist()):
            heap, own = self.heaps[i], doc[d]
            # of equal scores a smaller id is better and a null one the worst
            entry = (s, own is not None, -(own or 0))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self):
        for i, heap in enumerate(self.heaps):
            for s, known, d in heap:
                yield i, -d if known else None, s


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    def run(batches):
        numbers = vocabulary.value
        for b in sliced(batches):
            ids, sizes, terms, counts, ends = [], [], [], [], [0]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, n = term_counts(text)
                own = [(numbers[t], k) for t, k in found.items() if t in numbers]
                ids.append(doc)
                sizes.append(n)
                terms += [t for t, _ in own]
                counts += [k for _, k in own]
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column without nulls, and each row's number of them."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _block(docs: DataFrame, texts: dict, top: int) -> DataFrame:
    """item_id, doc_id, score of the best of each task, for a block of items: {item_id: its texts}."""
    spark = docs.sparkSession
    ids = list(texts)
    items_of: dict[bytes, list[int]] = {}
    for k, i in enumerate(ids):
        for t in {t for text in texts[i] for t in term_counts(text)[0]}:
            items_of.setdefault(t, []).append(k)
    names = sorted(items_of)
    postings = materialize(_postings(docs, spark.sparkContext.broadcast({t: k for k, t in enumerate(names)})), "postings")

    def statistics(batches):
        out = np.zeros(len(names) + 2, np.int64)
        for b in batches:
            n = b.column(0).to_numpy()
            out[-2:] += [int((n > 0).sum()), int(n.sum())]
            terms = b.column(1).flatten().to_numpy(zero_copy_only=False)
            out[: len(names)] += np.bincount(terms, minlength=len(names))
        return out

    df = sum_arrays(postings.select("n", "terms"), statistics, len(names) + 2).astype(np.int64).tolist()
    n_docs, n_terms = df[-2:]
    weights = np.array([weight(d, n_docs) for d in df[:-2]], np.int64)
    starts = np.cumsum([0, *(len(items_of[t]) for t in names)])
    items = np.array([k for t in names for k in items_of[t]], np.int64)
    model = spark.sparkContext.broadcast((ids, starts, items, weights))

    def run(batches):
        own_ids, starts, items, weights = model.value
        best = Best(len(own_ids), top)
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
            doc, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            (term, many), (tf, _) = _lists(b.column(2)), _lists(b.column(3))
            at = np.repeat(np.arange(len(doc)), many)
            impact = impacts(weights[term], tf, n[at], n_docs, n_terms)
            # blocks of documents: few enough for a key of 16 bits where items allow it, and for ENTRIES
            ends = np.cumsum(np.bincount(at, starts[term + 1] - starts[term], minlength=len(doc)))
            most, k = max(1, 1 << max(0, 16 - len(own_ids).bit_length())), 0
            rows = np.concatenate(([0], np.cumsum(many)))
            while k < len(doc):
                stop = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + ENTRIES, "right"))
                stop = min(max(stop, k + 1), k + most, len(doc))
                own = slice(rows[k], rows[stop])
                item, place, score = accumulate(starts, items, len(own_ids), term[own], at[own] - k, impact[own], stop - k)
                best.add(item, doc, place + k, score)
                k = stop
        rows = list(best.rows())
        for k in range(0, len(rows), 50_000):
            part = list(zip(*rows[k : k + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array([own_ids[i] for i in part[0]], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["item_id", "doc_id", "score"])

    return postings.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with the highest scores above 0, ties to the smaller doc_id.

    Null, empty and blank texts have no terms: as documents they count for nothing, as items they have no rows. Rows that repeat a
    doc_id are documents of their own, and a null doc_id comes last among equal scores. Rows that repeat an item_id are one item with the
    terms of all; a null item_id is an item too. Other columns are ignored; an empty table on either side gives no rows."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text <> ''")
    asked = materialize(asked.withColumn("block", F.xxhash64("item_id")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    best = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(blocks):
        texts: dict = {}
        for i, text in asked.where(F.pmod("block", F.lit(blocks)) == k).select("item_id", "text").collect():  # about block_bytes
            texts.setdefault(i, []).append(text)
        if texts:
            best = best.unionByName(_block(own, texts, top))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    first = best.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).withColumn("_r", rank("item_id", "_share")).where(f"_r <= {top}")
    return first.withColumn("rank", rank("item_id")).where(f"rank <= {top}").select("item_id", "rank", "doc_id", "score")
