"""Greedy word-piece counts by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie over bytes and one end-of-word symbol. Where the trie has no edge for the next
symbol, a failure link leads to the node of what is left after the pieces that greedy matching takes from
the text read so far; how many pieces that are is stored with the link. So each symbol is read once.
The bare end of a word counts as no piece. A word that cannot be cut into pieces counts as one (unknown).
"""

from __future__ import annotations

import json
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, sliced
from .tokens import byte_characters

END = 256
_STEP = 257
WORD_CACHE = 200_000

#: Words as the vocabulary's own splitting has them: runs of letters, single digits, runs of other marks.
_WORDS = re.compile(r"[^\W\d_]+|\d|[^\w\s]+|_+")


def vocabulary(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a tokenizers file as tuples of symbols; `end` is the end-of-word symbol. Special tokens are no pieces."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    letters = {chr(byte_characters().get(b, b)): b for b in range(256)}
    out = []
    for piece in model["model"]["vocab"]:
        if piece in special:
            continue
        body, ended = (piece[: -len(end)], (END,)) if piece.endswith(end) and piece != end else (piece, ())
        out.append(tuple(letters[c] for c in body) + ended)
    return out


class Automaton:
    def __init__(self, pieces: list[tuple[int, ...]]):
        self.edges: dict[int, int] = {}
        whole, nodes = {}, 1
        parents: list[tuple[int, int]] = [(0, 0)]
        for piece in [*pieces, (END,)]:
            at = 0
            for s in piece:
                nxt = self.edges.get(at * _STEP + s)
                if nxt is None:
                    nxt = self.edges[at * _STEP + s] = nodes
                    parents.append((at, s))
                    nodes += 1
                at = nxt
            whole[at] = 0 if piece == (END,) else 1
        self.fail, self.pops = [-1] * nodes, [0] * nodes
        children: dict[int, list[int]] = {}
        for node in range(1, nodes):
            children.setdefault(parents[node][0], []).append(node)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for v in children.get(u, ()):
                queue.append(v)
                if v in whole:
                    self.fail[v], self.pops[v] = 0, whole[v]
                    continue
                s, z, popped = parents[v][1], self.fail[u], self.pops[u]
                while z >= 0 and (nxt := self.edges.get(z * _STEP + s)) is None:
                    z, popped = (self.fail[z], popped + self.pops[z]) if z else (-1, popped)
                if z >= 0:
                    self.fail[v], self.pops[v] = nxt, popped

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node = n = 0
        for s in (*word, END):
            while (nxt := edges.get(node * _STEP + s)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


class _Counts(dict):
    """chunk without white space -> (words << 32 | pieces)."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        words = _WORDS.findall(chunk.lower())
        out = len(words) << 32 | sum(self.automaton.count(w.encode("utf-8", "surrogatepass")) for w in words)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counts:
    return _Counts(Automaton(vocabulary(path)))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each whole text, lower-cased. Null and empty texts count 0; null ids and repeated rows stay; other columns are ignored."""

    def run(batches):
        counts = _counter(vocabulary_path)
        claim(f"pieces {vocabulary_path}", counts.clear)
        for b in sliced(batches):
            sums = []
            for text in b.column(1).to_pylist():
                chunks = text.split() if text else ()
                sums.append(int(np.fromiter(map(counts.__getitem__, chunks), np.int64, len(chunks)).sum()) if chunks else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s >> 32 for s in sums], pa.int64()), pa.array([s & 0xFFFFFFFF for s in sums], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
