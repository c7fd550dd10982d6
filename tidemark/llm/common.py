"""What the operators of this folder share: scratch tables, byte arrays and bounded array sums."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize, scratch_dir

__all__ = ["materialize", "scratch_dir", "documents", "sliced", "sum_arrays", "without", "marked", "claim", "trim", "short_batches", "ARROW_ROWS"]


def short_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are short enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_caches: dict[str, object] = {}
_owner = ""


def claim(name: str, clear) -> None:
    """Called where a task begins to use a worker's word cache: caches of other operators, which ran in it before, are emptied
    and what the allocators hold for them goes back to the system."""
    global _owner
    _caches[name] = clear
    if _owner != name:
        for other, empty in _caches.items():
            if other != name:
                empty()
        _owner = name
    trim()


def trim() -> None:
    """Memory that a worker has freed goes back to the system; workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


#: Rows that JVM and Python exchange at once, and rows that Python takes up at once; texts may be long.
ARROW_ROWS = 1000
SLICE_ROWS = 500


def sliced(batches, rows: int = SLICE_ROWS):
    """Record batches of at most `rows` rows."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def sum_arrays(df: DataFrame, vectors, length: int, chunk: int = 1024, fold: str = "add", kind=np.uint64) -> np.ndarray:
    """Adds (or ORs) one array of `length` uint64 per partition; what reaches the driver has that length whatever the input.

    vectors: turns an iterator of record batches into one numpy array. Each partition sends its
    array in chunks, each chunk is folded in its own group, so no task holds more than a chunk per partition."""

    def partial(batches):
        v = vectors(batches).astype(kind)
        parts = [(k, v[k * chunk : (k + 1) * chunk]) for k in range(-(-length // chunk))]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["part", "v"])

    def merge(key, table):
        out = None
        for x in table.column("v").to_pylist():
            a = np.frombuffer(x, kind).astype(np.uint64)
            out = a.copy() if out is None else (np.bitwise_or(out, a, out=out) if fold == "or" else np.add(out, a, out=out))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    rows = df.mapInArrow(partial, "part int, v binary").groupBy("part").applyInArrow(merge, "part int, v binary").collect()
    total = np.zeros(-(-length // chunk) * chunk, np.uint64)
    for r in rows:
        a = np.frombuffer(bytes(r["v"]), np.uint64)
        total[r["part"] * chunk : r["part"] * chunk + len(a)] = a
    return total[:length]


#: Bits of a bitmap for each id that it marks, and the bounds of its size; at the largest it is 64 MB.
BITS_AN_ID, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 29


def bits_for(count: int) -> int:
    """A power of two of bits for so many ids."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_AN_ID * max(1, count) - 1).bit_length()))


def slots_of(ids: np.ndarray, slots: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


def marked(ids: DataFrame) -> np.ndarray:
    """A bitmap, sized by the number of ids, in which the slot of each is set; ids has one long column without nulls."""
    slots = bits_for(ids.count())

    def mark(batches):
        seen = np.zeros(slots, bool)
        for b in batches:
            seen[slots_of(b.column(0).to_numpy(zero_copy_only=False), slots)] = True
        return np.packbits(seen, bitorder="little").view(np.uint64)

    return sum_arrays(ids, mark, slots // 64, chunk=max(1024, slots // 64 // 1024), fold="or")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs whose id is not in dropped (one long column). Rows whose slot is free in a bitmap of the dropped ids
    stay where they are; only the others are shuffled and joined. Null ids stay."""
    bits = docs.sparkSession.sparkContext.broadcast(marked(dropped))
    name = dropped.columns[0]

    def part(wanted: bool):
        def run(batches):
            seen = np.unpackbits(bits.value.view(np.uint8), bitorder="little").astype(bool)
            for b in batches:
                ids = b.column(b.schema.get_field_index(id_col))
                hit = seen[slots_of(ids.fill_null(0).to_numpy(zero_copy_only=False), len(seen))] & ids.is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == wanted))

        return docs.mapInArrow(run, docs.schema)

    gone = dropped.select(F.col(name).alias("_dropped")).distinct()
    again = part(True)
    return part(False).unionByName(again.join(gone, again[id_col] == gone["_dropped"], "left_anti"))
