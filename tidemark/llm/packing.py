"""Best-fit packing of token sequences, in bulk-synchronous rounds over range-sorted lengths and gaps.

Documents are taken in classes of falling length. A round of a class:

1. Sort. The class's documents and the slots of open sequences are range-sorted together by falling size. A gap that holds
   several of the longest document left has several slots of that size, no more in all than about twice the documents; any other gap is
   one slot of its size. Of equal sizes slots come first, and the smallest gap last.
2. Sweep. Each partition sweeps its rows: a document takes the slot met last, which is the smallest one that is large enough and still free.
3. Conflicts by rank. Documents that find no slot in their partition take those that earlier partitions left free, the last first. Of
   each partition only two counts reach the driver, which turns them into runs of ranks; documents and slots
   are then joined on (partition, rank), a key that two rows have at most.
4. Update. Gaps shrink by what was placed, and documents without a slot are swept again. Where a sweep places none, the longest of
   them open sequences, one each: as many as those left need at least, by their tokens and by how many of the shortest one fit
   into a sequence. The others are swept again.

Where a round would be one partition of at most TASK_ROWS rows, its class's rounds go on inside that one task, by the same sweep; the classes
that are left, too, once all their rows are so few. The number of rounds depends on the capacity, not on the corpus; what moves in
a round is the class's lengths and the gaps. At the end documents get their offsets within their sequence, which holds `capacity` documents at most.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, materialize
from .tokens import encoder

CAPACITY = 4096
#: Bounds of the classes of lengths, as parts of the capacity. Between a half and a quarter, where two or three fit into a sequence, they are narrow.
CLASSES = [1, 2**-1, 2**-1.25, 2**-1.5, 2**-1.75, 2**-2, 2**-3]
#: Rows that a task sweeps, about; where a class's documents and gaps are no more, one task does its rounds.
TASK_ROWS = 50_000


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32): each text's ids and end_id, cut only beyond capacity.

    Null and empty texts are the end id alone. Null ids and repeated rows are kept as they are.
    Other columns of docs are ignored."""

    def run(batches):
        enc = encoder(tokenizer_path)
        claim(f"tokens {tokenizer_path}", enc.clear)
        encode, end, step = enc.encode, int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                rows: list[tuple] = []
                for doc, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist()):
                    ids = encode(text) + end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols[:n], kinds)], names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def classes(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) of each class of lengths, falling."""
    bounds = sorted({int(capacity * c) for c in CLASSES} - {0}, reverse=True)
    return list(zip([*bounds[1:], 0], bounds))


def sweep(numbers: list[int], sequences: list[int | None]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """([(row number, sequence)], rows left over, sequences left over) of items by falling size; a slot has a sequence, a document none.

    A document takes the slot that came last, so the smallest free one. What is left over is in order."""
    placed, alone, free = [], [], []
    for number, sequence in zip(numbers, sequences):
        if sequence is not None:
            free.append(sequence)
        elif free:
            placed.append((number, free.pop()))
        else:
            alone.append(number)
    return placed, alone, free


def match_ranks(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """From (partition, documents left, slots left): runs (partition, first rank, documents, slots' partition, rank of the first one's slot, falling)
    of documents that take an earlier partition's slots, and runs (partition, first rank, documents) of those that find none."""
    runs, none, free = [], [], []  # free: [partition, slots]
    for part, documents, slots in sorted(counts):
        at = 0
        while at < documents and free:
            own = free[-1]
            n = min(documents - at, own[1])
            runs.append((part, at, n, own[0], own[1] - 1))
            at, own[1] = at + n, own[1] - n
            if not own[1]:
                free.pop()
        if at < documents:
            none.append((part, at, documents - at))
        if slots:
            free.append([part, slots])
    return runs, none


_ITEM = "part int, kind string, rank long, row long, length int, seq long"


def _swept(batches):
    """Sweeps a partition: rows placed, documents left and slots left, each with its rank among its kind."""
    part, lengths = TaskContext.get().partitionId(), {}
    alone, free, done = [], [], []

    def rows(kind, numbers, sequences, first):
        n = len(numbers)
        size = [lengths.get(k, 0) for k in numbers] if kind != "slot" else [0] * n
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(numbers, pa.int64()), pa.array(size, pa.int32()), pa.array(sequences, pa.int64())], [c.split()[0] for c in _ITEM.split(", ")])

    for b in batches:
        size, number, seq = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("size", "row", "seq"))
        lengths.update((k, n) for k, n, s in zip(number, size, seq) if s is None)
        # slots left by what came before are met first; the sweep goes on where it stood
        placed, more, free = sweep([*[-1] * len(free), *number], [*free, *seq])
        done += placed
        alone += more
        if len(done) > 50_000:
            yield rows("placed", [k for k, _ in done], [s for _, s in done], 0)
            for k, _ in done:
                del lengths[k]
            done = []
    yield rows("placed", [k for k, _ in done], [s for _, s in done], 0)
    for k in range(0, len(alone), 50_000):
        yield rows("alone", alone[k : k + 50_000], [None] * len(alone[k : k + 50_000]), k)
    for k in range(0, len(free), 50_000):
        yield rows("slot", [-1] * len(free[k : k + 50_000]), free[k : k + 50_000], k)


def _looked_up(runs: list[tuple], fields: int):
    """Runs by (partition, first rank), as arrays for searchsorted; a few a partition, whatever the number of rows."""
    table = np.array(sorted(runs), np.int64).reshape(-1, fields)
    return table[:, 0] << 40 | table[:, 1], table


def _joined(spark, alone: DataFrame, slots: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(row, length, seq): documents left over, at the slots of earlier partitions that their ranks give them."""
    table = spark.sparkContext.broadcast(_looked_up(runs, 5))

    def place(batches):
        first, t = table.value
        for b in batches:
            part, rank = (b.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            i = np.maximum(np.searchsorted(first, part << 40 | rank, "right") - 1, 0)
            at = rank - t[i, 1]
            hit = (t[i, 0] == part) & (at >= 0) & (at < t[i, 2])
            yield pa.RecordBatch.from_arrays([pa.array(t[i, 3][hit], pa.int32()), pa.array((t[i, 4] - at)[hit], pa.int64()), *(b.column(k).filter(pa.array(hit)) for k in (2, 3))], ["part", "rank", "row", "length"])

    return alone.mapInArrow(place, "part int, rank long, row long, length int").join(slots, ["part", "rank"]).select("row", "length", "seq")


def sequences_needed(n: int, tokens: int, least: int, capacity: int) -> int:
    """So many sequences n documents need at least, the shortest of which has `least` tokens."""
    return min(n, max(-(-tokens // capacity), -(-n // (capacity // least))))


def opened(none: list[tuple[int, int, int]], first: int, need: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (partition, first rank, documents, to a sequence, first sequence, 0): the `need` longest documents without a slot, which come
    first, open a sequence each, from number `first` on; the others none."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    for part, at, n in sorted(none):
        own = min(n, need)
        if own:
            runs.append((part, at, own, 1, first, 0))
        if n > own:
            runs.append((part, at + own, n - own, 0, 0, 0))
        first, need = first + own, need - own
    return runs


def slots_of(gap: int, most: int, some: int) -> tuple[int, int]:
    """(how many slots, of which size) a gap has for documents of up to `most` tokens, `some` at most."""
    n = min(some, max(1, gap // most))
    return n, most if n > 1 else gap


def settle(documents: list[tuple[int, int]], gaps: dict[int, int], bounds: list[tuple[int, int]], capacity: int, first: int) -> list[tuple[int, int, int]]:
    """[(row, length, sequence)] of all documents (length, row): the rounds of their classes, as one partition. gaps is brought up to date."""
    placed = []
    for lo, hi in bounds:
        left = sorted((-n, row) for n, row in documents if lo < n <= hi)
        while left:
            most, least, length = -left[0][0], -left[-1][0], {row: -n for n, row in left}
            fit = [(g, s) for s, g in gaps.items() if g >= least]
            some = -(-2 * len(left) // max(1, len(fit)))
            items = [(n, 1, 0, row) for n, row in left]
            for g, s in fit:
                n, size = slots_of(g, most, some)
                items += [(-size, 0, -g, s)] * n
            items.sort()
            hits, alone, _ = sweep([x[3] if x[1] else -1 for x in items], [None if x[1] else x[3] for x in items])
            if not hits:
                need = sequences_needed(len(left), sum(length.values()), least, capacity)
                hits, alone = list(zip(alone[:need], range(first, first + need))), alone[need:]
                first += need
            for row, s in hits:
                gaps[s] = gaps.get(s, capacity) - length[row]
                placed.append((row, length[row], s))
            left = [(-length[row], row) for row in alone]
    return placed


def _without_slot(spark, alone: DataFrame, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """(row, length, seq): documents in the new sequences of their runs; no sequence where a run puts none into one."""
    table = spark.sparkContext.broadcast(_looked_up(runs, 6))

    def open_(batches):
        first, t = table.value
        for b in batches:
            part, rank = (b.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            i = np.maximum(np.searchsorted(first, part << 40 | rank, "right") - 1, 0)
            at = rank - t[i, 1]
            hit = (t[i, 0] == part) & (at >= 0) & (at < t[i, 2])
            seq = t[i, 4] + (t[i, 5] + at) // np.maximum(t[i, 3], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(pa.array(hit)) for k in (2, 3)), pa.array(seq[hit], pa.int64(), mask=(t[i, 3] == 0)[hit])], ["row", "length", "seq"])

    return alone.mapInArrow(open_, "row long, length int, seq long")


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS) -> DataFrame:
    """pieces with sequence_id and offset: a length column of 1 to capacity is packed into few sequences of that size.

    Every row goes to one sequence, repeated rows too; rows of equal length are taken as they were read. Lengths outside 1..capacity
    or null raise an error. An empty table gives an empty one. All columns stay, but those named sequence_id or offset are replaced."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    checked = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("lengths must be between 1 and the capacity")))
    # written first, with row numbers: rounds read lengths and numbers only, and a lost executor changes neither
    rows = materialize(pieces.select(checked.cast("int").alias("length"), F.monotonically_increasing_id().alias("row"), F.struct(*names).alias("own")), "pieces")
    lengths, bounds = rows.select("row", "length"), classes(capacity)
    in_class = F.expr("case " + " ".join(f"when length > {lo} then {k}" for k, (lo, _) in enumerate(bounds)) + " end")
    totals = [F.count("*"), F.sum("length"), F.min("length"), F.max("length")]
    sizes = {r[0]: tuple(r)[1:] for r in lengths.groupBy(in_class.alias("k")).agg(*totals).collect()}
    gaps, n_gaps, step = spark.createDataFrame([], "seq long, gap int"), 0, 0
    rounds: list[DataFrame] = []
    for k, (lo, hi) in enumerate(bounds):
        left, (n, tokens, least, most) = lengths.where(f"length > {lo} and length <= {hi}"), sizes.get(k, (0, 0, 0, 0))
        while n:
            held = gaps.where(f"gap >= {least}").count() if n_gaps else 0
            later = sum(sizes[j][0] for j in range(k + 1, len(bounds)) if j in sizes)
            step += 1
            first = step << 40  # sequences opened in a step have numbers of their own
            if n + held <= task_rows:
                last = n + later + n_gaps <= task_rows
                own = lengths.where(f"length <= {lo}").unionByName(left) if last else left
                settled = _settled(own, gaps if last else gaps.where(f"gap >= {least}"), bounds[k:] if last else [(lo, hi)], capacity, first)
                rounds.append(settled.where("row is not null").select("row", "length", "seq"))
                if last:
                    return _with_places(rows, rounds, names)
                gaps = materialize(gaps.where(f"gap < {least}").unionByName(settled.where("row is null and gap > 0").select("seq", "gap")), "gaps")
                n_gaps = gaps.count()
                break
            some = -(-2 * n // max(1, held))
            many = F.expr(f"least({some}, greatest(1, cast(gap div {most} as int)))")
            slots = gaps.where(f"gap >= {least}").withColumn("many", many).select(F.when(F.col("many") > 1, most).otherwise(F.col("gap")).alias("size"), F.lit(0).alias("kind"), (-F.col("gap")).alias("order"), F.lit(-1).cast("long").alias("row"), "seq", F.explode(F.sequence(F.lit(1), F.col("many"))).alias("slot")).drop("slot")
            items = left.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(0).alias("order"), "row", F.lit(None).cast("long").alias("seq")).unionByName(slots)
            keys = [F.col("size").desc(), F.col("kind").asc(), F.col("order").asc(), F.col("row").asc(), F.col("seq").asc()]
            items = items.repartitionByRange(-(-(n + held) // task_rows), *keys)
            swept = materialize(items.sortWithinPartitions(*keys).mapInArrow(_swept, _ITEM), "swept")
            counted = swept.groupBy("part").agg(F.count_if(F.col("kind") == "alone"), F.count_if(F.col("kind") == "slot"), F.count_if(F.col("kind") == "placed")).collect()
            runs, none = match_ranks([tuple(r)[:3] for r in counted])
            hits, rest = sum(r[3] for r in counted) + sum(r[2] for r in runs), sum(r[2] for r in none)
            alone = swept.where("kind = 'alone'").select("part", "rank", "row", "length")
            done = swept.where("kind = 'placed'").select("row", "length", "seq")
            if runs:
                done = done.unionByName(_joined(spark, alone, swept.where("kind = 'slot'").select("part", "rank", "seq"), runs))
            if rest:  # swept again if this round placed any, else the longest open sequences
                done = done.unionByName(_without_slot(spark, alone, opened(none, first, 0 if hits else sequences_needed(n, tokens, least, capacity))))
            done = materialize(done, "round")
            rounds.append(done.where("seq is not null"))
            used = rounds[-1].groupBy("seq").agg(F.sum("length").cast("int").alias("used"))
            updated = gaps.join(used, "seq", "full").select("seq", (F.coalesce("gap", F.lit(capacity)) - F.coalesce("used", F.lit(0))).alias("gap"))
            gaps = materialize(updated.where("gap > 0"), "gaps")
            n_gaps, left = gaps.count(), done.where("seq is null").select("row", "length")
            n, tokens, least, most = left.agg(*totals).first() if rest else (0, 0, 0, 0)
    return _with_places(rows, rounds, names)


def _settled(documents: DataFrame, gaps: DataFrame, bounds: list[tuple[int, int]], capacity: int, first: int) -> DataFrame:
    """row, length, seq of documents placed by one task, and seq, gap of all its gaps afterwards (row null)."""

    def run(batches):
        own, open_ = [], {}
        for b in batches:
            for row, length, s, gap in zip(*(c.to_pylist() for c in b.columns)):
                if row is None:
                    open_[s] = gap
                else:
                    own.append((length, row))
        placed = settle(own, open_, bounds, capacity, first)
        cols = [[*(p[0] for p in placed), *[None] * len(open_)], [*(p[1] for p in placed), *[None] * len(open_)], [*(p[2] for p in placed), *open_], [*[None] * len(placed), *open_.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["row", "length", "seq", "gap"])

    none = lambda t: F.lit(None).cast(t)
    both = documents.select("row", "length", none("long").alias("seq"), none("int").alias("gap")).unionByName(gaps.select(none("long").alias("row"), none("int").alias("length"), "seq", "gap"))
    return materialize(both.repartition(1).mapInArrow(run, "row long, length int, seq long, gap int"), "settled")


def _with_places(rows: DataFrame, rounds: list[DataFrame], names: list[str]) -> DataFrame:
    every = rows.sparkSession.createDataFrame([], "row long, length int, seq long")
    for part in rounds:
        every = every.unionByName(part)
    before = Window.partitionBy("seq").orderBy(F.col("length").desc(), "row").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("row", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return rows.select("row", "own").join(every, "row").select(*[F.col("own")[c].alias(c) for c in names], "sequence_id", "offset")
