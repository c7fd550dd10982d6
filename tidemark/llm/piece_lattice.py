"""SentencePiece encoding and decoding by a relational lattice over distinct words.

Pieces of the model never span the border between text and the spaces after it, so a text is cut into
words there and each distinct word is encoded once:

1. Documents are dealt to chunks of bounded size; a chunk's row has its distinct words, cut once more between
   neighbouring characters that no piece holds (every path has a border there), and, for each document, the
   words' places in that list. (mapInArrow)
2. All chunks' parts of words ("words" from here on) are made distinct. Each word's substrings of up to the longest piece's length
   are exploded and equi-joined to the piece table; a single character without a piece keeps an edge of
   its own, as bytes. Edges are grouped by word, sorted by their ends, and folded with Spark's aggregate(): the state is
   the values of the last few ends, one per character of the longest piece, so strings of any length take the same way.
   A second aggregate() follows the chosen edges back.
3. Words' ids go back to the chunks' places by a join on the word and are put in the documents' order.

The path is the one with the largest sum of scores (Viterbi), ties to the edge that starts earliest, so to the
longest last piece. A unigram model's scores are its own, and the path is the library's encoding. A BPE model has
merge ranks instead of scores; by Zipf's law piece r of the ranking gets -log(r + RANK_SHIFT), so that few pieces win, and among those
frequent ones. That is close to the merge order, but not the same for all words. Decoding gives the text back.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, trim

CHUNK_CHARACTERS = 32_000_000
CHUNK_DOCUMENTS = 32_000
#: A character without a piece costs this much more than the worst piece.
UNKNOWN = 10.0
#: Shift of the ranks of a BPE model before their logarithm is taken.
RANK_SHIFT = 3000
#: Winning edges are kept in blocks of this size, and long words' substrings are taken from segments of SEGMENT starts.
BLOCK, SEGMENT = 256, 64

_WORDS = re.compile("▁+[^▁]*|[^▁]+")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_table(path: str) -> tuple[list[tuple[str, int, float]], int, float]:
    """(piece, id, score) of ordinary pieces, the id of byte 0, and the score of a character without a piece."""
    p = _processor(path)
    ordinary = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    # runs of spaces come with a score for "never by merging"; here they rank after all other pieces
    floor = min(s for i in ordinary if (s := p.get_score(i)) > -1e8)
    scores = [max(float(p.get_score(i)), floor - 1) for i in ordinary]
    if all(x <= 0 and x == int(x) for x in scores):  # ranks
        scores = [-math.log(RANK_SHIFT - x) for x in scores]
    return [(p.id_to_piece(i), i, x) for i, x in zip(ordinary, scores)], p.piece_to_id("<0x00>"), min(scores) - UNKNOWN


def normalized(text: str | None) -> str:
    """The model's view of a text: a space before it, spaces as ▁."""
    return "▁" + text.replace(" ", "▁") if text else ""


@lru_cache(maxsize=2)
def _bytes_of_ids(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids' bytes in a row, with each id's first place and size; control ids have none."""
    p = _processor(path)
    byte0 = p.piece_to_id("<0x00>")
    own = [b"" if p.is_control(i) or p.is_unknown(i) else bytes([i - byte0]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
    size = np.array([len(x) for x in own], np.int64)
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum(size) - size, size


def _runs(first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[first:first + size] of each, in a row."""
    return flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The text's UTF-8 bytes: the pieces' bytes in a row without the space that stands before every text."""
    if not len(ids):
        return b""
    flat, first, size = _bytes_of_ids(path)
    raw = _runs(first[ids], size[ids], flat).tobytes()
    return raw[1:] if raw[:1] == b" " else raw


def decode(ids: list[int], path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return decode_bytes(np.asarray(ids, np.int64), path).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def joined_pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Which neighbouring characters some piece holds: a character's row (0 for those in no pair), and a table of pairs of rows.
    Between any other pair every path has a border. The vocabulary bounds both."""
    pairs = {p[i : i + 2] for p, _, _ in piece_table(path)[0] for i in range(len(p) - 1)}
    row = np.zeros(0x110000, np.uint16)
    known = sorted({c for p in pairs for c in p})
    row[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
    table = np.zeros((len(known) + 1, len(known) + 1), bool)
    for p in pairs:
        table[row[ord(p[0])], row[ord(p[1])]] = True
    return row, table


class _Words(dict):
    """word -> place among a chunk's words."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def cut_words(words: list[str], path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(parts, units, sizes): the distinct parts of all words, and each word's parts in a row as places among them."""
    if not words:
        return [], np.empty(0, np.uint32), np.empty(0, np.uint32)
    row, table = joined_pairs(path)
    whole = "".join(words)
    rows = row[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.ones(len(rows), bool)
    first[1:] = ~table[rows[:-1], rows[1:]]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    first[ends[:-1]] = True
    at = np.append(np.flatnonzero(first), len(rows))
    sizes = np.diff(np.concatenate(([0], np.searchsorted(at, ends))))
    places = _Words()
    edges = at.tolist()
    units = np.fromiter((places[whole[a:b]] for a, b in zip(edges, edges[1:])), np.uint32, len(edges) - 1)
    return list(places), units, sizes


def _squeezed(numbers) -> bytes:
    """uint32 numbers by byte planes, zstd."""
    return zstandard.compress(np.ascontiguousarray(np.asarray(numbers).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


CHUNK = "chunk long, docs array<bigint>, lengths binary, codes binary, sums array<bigint>, units binary, sizes binary, parts binary, cuts binary"
#: A chunk's number is its input partition's and its place there; a part's place follows in the lowest bits.
PLACES, CHUNKS = 26, 16


def _chunker(path: str):
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        docs, codes, sums, words, size = [], [], [], _Words(), 0

        def row():
            nonlocal docs, codes, sums, words, size, n
            names, counts = list(words), [len(c) for c in codes]
            flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
            words, codes = _Words(), []
            # the most frequent word is 0, so most numbers are small
            times = np.bincount(flat, minlength=len(names))
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            names, flat = [names[k] for k in order.tolist()], rank[flat]
            parts, units, sizes = cut_words(names, path)
            names = []
            cuts = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in parts), np.uint32, len(parts))
            squeezed = [_squeezed(counts), _squeezed(flat), sums, _squeezed(units), _squeezed(sizes), zstandard.compress("".join(parts).encode("utf-8", "surrogatepass"), 3), _squeezed(cuts)]
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            out = pa.RecordBatch.from_arrays([pa.array([part << CHUNKS | n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *[pa.array([x], k) for x, k in zip(squeezed, kinds)]], [c.split()[0] for c in CHUNK.split(", ")])
            docs, sums, size, n = [], [], 0, n + 1
            return out

        for b in sliced(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _WORDS.findall(normalized(text))
                codes.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
                docs.append(doc)
                sums.append(zlib.crc32((text or "").encode("utf-8", "surrogatepass")))
                size += len(text or "")
                if size >= CHUNK_CHARACTERS or len(docs) >= CHUNK_DOCUMENTS:
                    yield row()
                    trim()
        if docs:
            yield row()
            trim()

    return run


def _parts_of_chunks(batches):
    """(at, word): each chunk's parts, with the chunk and the part's place in one number."""
    for b in batches:
        for chunk, parts, cuts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("chunk", "parts", "cuts"))):
            offsets = np.concatenate(([0], np.cumsum(_expanded(cuts)))).astype(np.int32)
            words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(zstandard.decompress(parts)))
            at = pa.array((chunk << PLACES) + np.arange(len(words), dtype=np.int64))
            for k in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([at[k : k + 10_000], words[k : k + 10_000]], ["at", "word"])


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) for rows (at, word), word distinct and not empty, partitioned by word: the lattice, grouped and folded.

    An edge is one long: its end, 64 less its length, and its piece's id, or 2^25 and the code point of a character without a piece.
    So edges in order are ends in order, at each end the longest edge first, and a single character's last."""
    spark = words.sparkSession
    rows, byte0, unknown = piece_table(path)
    longest = max(len(r[0]) for r in rows)
    pieces = spark.createDataFrame([r[:2] for r in rows], "piece string, id long")  # the vocabulary's size bounds it
    by_id = dict((r[1], r[2]) for r in rows)
    table = "cast(split('" + ",".join(repr(by_id.get(i, 0.0)) for i in range(max(by_id) + 1)) + "', ',') as array<double>)"
    segments = words.select("at", "word", F.explode(F.expr(f"sequence(0, (length(word) - 1) div {SEGMENT})")).alias("k"))
    segments = segments.select("at", "word", (F.col("k") * SEGMENT).alias("base"), F.expr(f"substring(word, int(k * {SEGMENT} + 1), {SEGMENT + longest - 1})").alias("seg"))
    starts = segments.select("at", "word", "base", "seg", F.explode(F.expr(f"sequence(0, least({SEGMENT}, length(seg)) - 1)")).alias("i"))
    parts = starts.select("at", "word", "base", "seg", "i", F.explode(F.expr(f"sequence(1, least({longest}, length(seg) - i))")).alias("n"))
    parts = parts.select("at", "word", (F.col("base") + F.col("i") + F.col("n")).alias("e"), "n", F.expr("substring(seg, i + 1, n)").alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    edge = F.expr("shiftleft(cast(e as bigint), 32) | shiftleft(cast(64 - n as bigint), 26) | coalesce(id, 33554432L + ascii(piece))")
    lattice = edges.select("at", "word", edge.alias("edge")).groupBy("at", "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    length_of = "(64 - cast(shiftright({0}, 26) & 63 as int))"
    score = f"if((x & 33554432L) = 0, {table}[cast(x & 33554431L as int)], {unknown!r}D)"
    reached = f"(a.w[{length_of.format('x')} - 1] + {score})"
    none, lowest = "cast(array() as array<bigint>)", "double('-Infinity')"
    state = "named_struct('w', {}, 'v', {}, 'p', {}, 't', {}, 'b', {})".format
    won = "if(r > s.v, x, s.p)"
    ended = state(f"slice(concat(array(greatest(s.v, r)), s.w), 1, {longest})", lowest, "0L", f"if(size(s.t) < {BLOCK}, concat(s.t, array({won})), array({won}))", f"if(size(s.t) < {BLOCK}, s.b, concat(s.b, array(s.t)))")
    # the inner aggregate only names the value r
    step = f"aggregate(array({reached}), a, (s, r) -> if((shiftright(x, 26) & 63) < 63, if(r > s.v, {state('s.w', 'r', 'x', 's.t', 's.b')}, s), {ended}))"
    best = f"aggregate(edges, {state('array(0D)', lowest, '0L', none, f'cast(array() as array<array<bigint>>)')}, (a, x) -> {step}, a -> concat(a.b, array(a.t)))"
    back = f"""aggregate(reverse(best), named_struct('at', cast(length(word) as bigint), 'd', cast(array() as array<array<bigint>>), 'c', {none}),
        (a, k) -> aggregate(reverse(k), named_struct('at', a.at, 'd', concat(a.d, array(a.c)), 'c', {none}),
            (c, x) -> if(shiftright(x, 32) = c.at, named_struct('at', c.at - {length_of.format('x')}, 'd', c.d, 'c', concat(c.c, array(x & 67108863L))), c)),
        a -> reverse(flatten(concat(a.d, array(a.c)))))"""
    point = "(p - 33554432L)"
    low = lambda shift: f"{byte0} + 128 + (shiftright({point}, {shift}) & 63)"
    utf8 = f"""case when {point} < 128 then array({byte0} + {point}) when {point} < 2048 then array({byte0} + 192 + shiftright({point}, 6), {low(0)})
        when {point} < 65536 then array({byte0} + 224 + shiftright({point}, 12), {low(6)}, {low(0)}) else array({byte0} + 240 + shiftright({point}, 18), {low(12)}, {low(6)}, {low(0)}) end"""
    plain = "not exists(path, p -> p >= 33554432L)"
    ids = f"cast(if({plain}, path, flatten(transform(path, p -> if(p < 33554432L, array(p), {utf8})))) as array<int>)"
    return lattice.select("word", F.expr(best).alias("best")).select("word", F.expr(back).alias("path")).select("word", F.expr(ids).alias("ids"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip (and ids: binary, little-endian uint32) for each row.

    round_trip: decoding the ids gives the text back. Null and empty texts have no ids. Null ids of rows and
    repeated rows stay; other columns are ignored; an empty table gives no rows.

    Chunks and their parts are shuffled once each; both exchanges are read twice (nothing above them is pruned, so Spark reuses them)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = rows.mapInArrow(_chunker(path), CHUNK).repartition("chunk")
    parts = chunks.mapInArrow(_parts_of_chunks, "at long, word string").repartition("word")
    known = encode_words(parts.groupBy("word").agg(F.min("at").alias("at")).sortWithinPartitions("at"), path)
    # two bytes an id where the vocabulary allows it
    small = _processor(path).get_piece_size() <= 1 << 16
    packed = F.expr("transform(ids, i -> cast(i - 32768 as smallint))") if small else F.col("ids")
    place = F.col("at").bitwiseAND((1 << PLACES) - 1)
    # a part's place stands before its ids, in one or two numbers
    before = F.array(F.shiftright(place, 15).cast("smallint"), place.bitwiseAND(32767).cast("smallint")) if small else F.array(place.cast("int"))
    known = known.select(F.col("word").alias("of"), packed.alias("ids")).hint("shuffle_hash")
    own = parts.join(known, F.col("word") == F.col("of")).select(F.shiftright("at", PLACES).alias("chunk"), F.concat(before, "ids").alias("ids"))

    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.binary())][: 4 + with_ids]

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("ids").combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        first, skip = ends[:-1], 1 + small
        order = np.argsort(flat[first] << 15 | flat[first + 1] if small else flat[first])
        size, first = np.diff(ends)[order] - skip, first[order] + skip
        flat += 32768 * small
        cols: list[list] = [[] for _ in fields]
        for docs_, lengths, codes, sums, units, sizes in zip(*(left.column(c).to_pylist() for c in ("docs", "lengths", "codes", "sums", "units", "sizes"))):
            lengths, codes, units, sizes = map(_expanded, (lengths, codes, units, sizes))
            unit_first, at = np.cumsum(sizes) - sizes, 0
            for doc, n, total in zip(docs_, lengths.tolist(), sums):
                w = codes[at : at + n]
                at += n
                u = _runs(unit_first[w], sizes[w], units) if n else w
                ids = _runs(first[u], size[u], flat) if n else np.empty(0, np.int64)
                raw = ids.astype(np.uint32).tobytes()
                for col, x in zip(cols, (doc, len(ids), zlib.crc32(raw), zlib.crc32(decode_bytes(ids, path)) == total, raw)):
                    col.append(x)
        out = pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [name for name, _ in fields])
        del cols, lists, flat, order, left, right
        trim()
        return out

    return chunks.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(assemble, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids)
