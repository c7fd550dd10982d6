"""Token ids in files compressed by a Re-Pair grammar, with random access to each document.

A shard holds documents in ascending order. In rounds, its frequent pairs of neighbouring symbols are
counted and replaced by new symbols, a round's pairs all at once, until no pair is frequent; within a run
of overlapping occurrences every second one is replaced. A symbol that ends documents is never paired, so no rule
spans two documents. A shard file is one binary value:

    magic "TMRP", version, bytes a symbol (2 or 4), distinct ids (a symbol below is an id's place),
    rules, symbols, documents, partition (uint32 each), tokens of the partition before this shard (uint64), then: the documents' ids
    (int64) and whether each is there (a byte), the distinct ids (uint32), rules' left and right symbols, rules' expansion
    lengths (uint32), symbols, each document's symbol count and token count (uint32).

Expansion lengths give a token's place without expanding what precedes it: tokens(first, last) expands the symbols that reach
into that range and no others.
"""

from __future__ import annotations

import struct
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize
from .tokens import encoder

SHARD_TOKENS = 1 << 21
RULES_A_ROUND = 60_000
LEAST = 12

_HEAD = struct.Struct("<4sIIIIIIIQ")
_TABLE_BITS = 18


def compress(ids: np.ndarray, terminals: int, barrier: int, rounds: int | None = None, rules_a_round: int = RULES_A_ROUND, least: int = LEAST):
    """(symbols, left, right): ids with frequent pairs replaced; symbol terminals + k stands for left[k], right[k].

    Without `rounds` it goes on until no pair occurs `least` times."""
    seq = ids.astype(np.uint32)
    lefts, rights, fresh = [], [], terminals
    for _ in range(rounds) if rounds is not None else count():
        if len(seq) < 2:
            break
        # a pair is one number: of 32 bits while all symbols fit into 16
        kind, half = (np.uint32, np.uint32(16)) if fresh <= 1 << 16 else (np.uint64, np.uint64(32))
        low = kind((1 << int(half)) - 1)
        keys = (seq[:-1].astype(kind) << half) | seq[1:].astype(kind)
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        times, pairs = np.diff(np.append(edge, len(ordered))), ordered[edge]
        barred = (pairs >> half == barrier) | (pairs & low == barrier)
        frequent = np.flatnonzero((times >= least) & ~barred)
        if not len(frequent):
            break
        # the most frequent first; equal counts by pair, so a shard is always stored alike
        frequent = frequent[np.lexsort((pairs[frequent], -times[frequent]))][: min(rules_a_round, 65_000)]
        chosen = np.sort(pairs[frequent])
        # a slot holds a chosen pair's place, counted from 1; pairs that share a slot are looked up among the chosen pairs themselves
        table, slot = np.zeros(1 << _TABLE_BITS, np.uint16), _hashed(chosen)
        table[slot] = np.arange(1, len(chosen) + 1, dtype=np.uint16)
        shared = np.bincount(slot.astype(np.int64), minlength=1 << _TABLE_BITS) > 1
        table[shared] = len(chosen) + 1
        which = table.take(_hashed(keys))
        places = np.flatnonzero(which != 0)
        which, own = which.take(places).astype(np.int32) - 1, keys.take(places)
        late = np.flatnonzero(which == len(chosen))
        which[late] = np.minimum(np.searchsorted(chosen, own[late]), len(chosen) - 1)
        hit = chosen.take(which) == own
        places, which = places[hit], which[hit]
        # in a run of overlapping occurrences the first, third, fifth ... are replaced
        at = np.arange(len(places), dtype=np.int32)
        start = at.copy()
        start[1:][places[1:] == places[:-1] + 1] = 0
        odd = ((at - np.maximum.accumulate(start)) & 1) == 0
        take, which = places[odd], which[odd]
        used = np.flatnonzero(np.bincount(which, minlength=len(chosen)))
        renumbered = np.zeros(len(chosen), np.uint32)
        renumbered[used] = np.arange(fresh, fresh + len(used), dtype=np.uint32)
        seq[take] = renumbered[which]
        stays = np.ones(len(seq), bool)
        stays[take + 1] = False
        seq = seq[stays]
        lefts.append((chosen[used] >> half).astype(np.uint32))
        rights.append((chosen[used] & low).astype(np.uint32))
        fresh += len(used)
    return seq, np.concatenate(lefts or [np.empty(0, np.uint32)]), np.concatenate(rights or [np.empty(0, np.uint32)])


def _hashed(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _levels(left: np.ndarray, right: np.ndarray, terminals: int):
    """(from, to) of rules that only use symbols before `from`, so each range can be expanded at once."""
    need, k = np.maximum(left, right).astype(np.int64), 0
    while k < len(need):
        late = np.flatnonzero(need[k:] >= terminals + k)
        to = k + int(late[0]) if len(late) else len(need)
        if to == k:
            raise ValueError("a rule that uses itself or a later one")
        yield k, to
        k = to


def _lengths(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    out = np.ones(terminals + len(left), np.uint32)
    for k, to in _levels(left, right, terminals):
        out[terminals + k : terminals + to] = out[left[k:to]] + out[right[k:to]]
    return out[terminals:]


def write_shard(docs: list[bytes], terminals: int, barrier: int, doc_ids: list[int | None] | None = None, part: int = 0, before: int = 0) -> bytes:
    """docs: each document's little-endian uint32 ids, all ending in barrier."""
    doc_ids = doc_ids if doc_ids is not None else [None] * len(docs)
    ids = np.frombuffer(b"".join(docs), np.uint32)
    # symbols count from the ids that occur, so that rules too fit into two bytes for longer
    present = np.zeros(terminals, bool)
    present[ids] = True
    alphabet, place = np.flatnonzero(present).astype(np.uint32), np.cumsum(present) - 1
    terminals = len(alphabet)
    seq, left, right = compress(place[ids], terminals, int(place[barrier]))
    tokens = np.array([len(d) // 4 for d in docs], np.uint32)
    lengths = _lengths(left.astype(np.int64), right.astype(np.int64), terminals)
    wide = np.concatenate((np.ones(terminals, np.int64), lengths.astype(np.int64)))[seq.astype(np.int64)] if len(seq) else np.empty(0, np.int64)
    ends = np.searchsorted(np.cumsum(wide), np.cumsum(tokens.astype(np.int64)), "left") + 1
    symbols = np.diff(np.concatenate(([0], ends))).astype(np.uint32)
    kind = np.uint16 if terminals + len(left) <= 1 << 16 else np.uint32
    head = _HEAD.pack(b"TMRP", 3, np.dtype(kind).itemsize, terminals, len(left), len(seq), len(docs), part, before)
    names, there = np.array([i or 0 for i in doc_ids], np.int64), np.array([i is not None for i in doc_ids], np.uint8)
    return b"".join((head, names.tobytes(), there.tobytes(), alphabet.tobytes(), left.astype(kind).tobytes(), right.astype(kind).tobytes(), lengths.tobytes(), seq.astype(kind).tobytes(), symbols.tobytes(), tokens.tobytes()))


class Shard:
    """Reads a shard file; tokens(first, last) decodes a range, document(k) one document, all() the whole shard by one table of all rules."""

    def __init__(self, data: bytes):
        magic, version, width, self.terminals, rules, n, docs, self.part, self.before = _HEAD.unpack_from(data)
        if magic != b"TMRP" or version != 3:
            raise ValueError("not a shard file of this version")
        at, kind = _HEAD.size, np.dtype(np.uint16 if width == 2 else np.uint32)

        def take(count, dtype):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        names, there = take(docs, np.int64).tolist(), take(docs, np.uint8)
        self.doc_ids = [i if t else None for i, t in zip(names, there)]
        self.alphabet = take(self.terminals, np.uint32)
        self.left, self.right, lengths = take(rules, kind), take(rules, kind), take(rules, np.uint32)
        self.symbols, self.symbol_counts, self.token_counts = take(n, kind), take(docs, np.uint32), take(docs, np.uint32)
        if at != len(data):
            raise ValueError("a shard file of another length than its header says")
        self.size = np.concatenate((np.ones(self.terminals, np.int64), lengths.astype(np.int64)))
        self.symbol_ends = np.cumsum(self.symbol_counts.astype(np.int64))
        self.token_ends = np.cumsum(self.size[self.symbols.astype(np.int64)])

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids at places first to last (exclusive) of the shard, from the symbols that reach into them alone."""
        if not 0 <= first <= last <= (int(self.token_ends[-1]) if len(self.token_ends) else 0):
            raise ValueError("a range outside the shard")
        if first == last:
            return np.empty(0, np.uint32)
        a, b = int(np.searchsorted(self.token_ends, first, "right")), int(np.searchsorted(self.token_ends, last, "left")) + 1
        symbols, start = self.symbols[a:b].astype(np.int64), int(self.token_ends[a - 1]) if a else 0
        while (rule := symbols >= self.terminals).any():
            at = np.cumsum(rule + 1) - (rule + 1)
            wider = np.empty(len(symbols) + int(rule.sum()), np.int64)
            wider[at[~rule]] = symbols[~rule]
            wider[at[rule]] = self.left[symbols[rule] - self.terminals]
            wider[at[rule] + 1] = self.right[symbols[rule] - self.terminals]
            symbols = wider
        return self.alphabet[symbols[first - start : last - start]]

    def document(self, k: int) -> np.ndarray:
        end = int(self.token_counts[: k + 1].sum(dtype=np.int64))
        return self.tokens(end - int(self.token_counts[k]), end)

    def all(self) -> np.ndarray:
        """All ids: rules are expanded once, in the order in which they were made, and then the symbols."""
        first = np.cumsum(self.size) - self.size
        table = np.empty(int(self.size.sum()), np.uint32)
        table[: self.terminals] = self.alphabet

        def expand(symbols: np.ndarray) -> np.ndarray:
            symbols = symbols.astype(np.int64)
            size = self.size[symbols]
            total = np.cumsum(size)
            return table[np.repeat(first[symbols] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]

        for k, to in _levels(self.left, self.right, self.terminals):
            pairs = expand(np.column_stack((self.left[k:to], self.right[k:to])).ravel())
            table[first[self.terminals + k] :][: len(pairs)] = pairs
        return expand(self.symbols)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, appends end_id and writes shard files in ascending id order (null ids first, ties by text) to the shared folder.

    The table read back: part, shard, n_tokens, content (the file, which holds the documents' ids and the tokens before it). Null texts are empty. Other columns are ignored; an empty
    table gives no shards."""

    def run(batches):
        part, before, shard = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path)
        claim(f"tokens {tokenizer_path}", enc.clear)
        terminals = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        end = int(end_id).to_bytes(4, "little")
        ids: list = []
        held: list[bytes] = []
        tokens = 0

        def flush():
            nonlocal ids, held, tokens, before, shard
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([tokens], pa.int64()), pa.array([write_shard(held, terminals, end_id, ids, part, before)], pa.binary())],
                ["part", "shard", "n_tokens", "content"],
            )
            before, shard, ids, held, tokens = before + tokens, shard + 1, [], [], 0
            return row

        for b in batches:
            for k in range(0, b.num_rows, 500):
                c = b.slice(k, 500)
                for doc, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist()):
                    one = enc.encode(text) + end
                    if held and tokens + len(one) // 4 > SHARD_TOKENS:
                        yield flush()
                    ids.append(doc)
                    held.append(one)
                    tokens += len(one) // 4
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part int, shard int, n_tokens long, content binary"), "shards")


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document of the shard files: doc_id, start, n_tokens, ids_crc32 (and ids: binary, little-endian uint32), from the stored bytes."""
    spark = files.sparkSession
    sums = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    base: dict[int, int] = {}
    total = 0
    for part, n in sums:
        base[part], total = total, total + n
    bases = spark.sparkContext.broadcast(base)

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                shard = Shard(content)
                flat, ids, before = shard.all(), shard.doc_ids, shard.before
                n = shard.token_counts.astype(np.int64)
                ends = np.cumsum(n)
                for k in range(0, len(ids), 2000):
                    s = slice(k, k + 2000)
                    parts = [flat[e - m : e] for e, m in zip(ends[s].tolist(), n[s].tolist())]
                    cols = [pa.array(ids[s], pa.int64()), pa.array(bases.value[shard.part] + before + ends[s] - n[s], pa.int64()), pa.array(n[s], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([x.tobytes() for x in parts], pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return files.select("content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
