"""Words of texts that are written without spaces, by the frequencies of a lexicon.

A run of letters and digits is a graph whose edges are the lexicon's words, found by walking a trie from each place. An edge weighs the logarithm of its
word's share of all occurrences, a character that begins no word half an occurrence. The best path is folded from the right, each place once.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Words of a lexicon at most, which all tasks get; runs whose words a worker remembers.
WORDS, REMEMBERED = 500_000, 200_000
#: Texts whose tokens a task holds at once.
TEXTS = 256
_RUN = re.compile(r"\w+")


class WordGraph:
    """A trie over words with their numbers of occurrences."""

    def __init__(self, words: dict[str, int]):
        words = {w: n for w, n in words.items() if w and n > 0}
        total = sum(words.values()) or 1
        self.unknown, self.root = math.log(0.5 / total), {}
        for w, n in words.items():
            reduce(lambda node, c: node.setdefault(c, {}), w, self.root)[""] = math.log(n / total)

    def best(self, run: str) -> list[tuple[str, bool]]:
        """(word, known) along the path with the largest sum; on equal sums the longer word comes first. Unknown characters beside one another are one word."""
        n = len(run)
        sums, sizes, known = [0.0] * (n + 1), [1] * n, [False] * n
        for i in range(n - 1, -1, -1):
            node, top, size, j = self.root, None, 1, i
            while j < n and (node := node.get(run[j])) is not None:
                j += 1
                if "" in node and (top is None or node[""] + sums[j] >= top):
                    top, size = node[""] + sums[j], j - i
            known[i] = top is not None
            other = self.unknown + sums[i + 1]
            # a longer word may cost more than this character and what follows
            if top is None or (size > 1 and other > top and "" not in self.root.get(run[i], {})):
                top, size, known[i] = other, 1, False
            sums[i], sizes[i] = top, size
        out: list[tuple[str, bool]] = []
        i = 0
        while i < n:
            word = run[i : i + sizes[i]]
            if not known[i] and out and not out[-1][1]:
                out[-1] = out[-1][0] + word, False
            else:
                out.append((word, known[i]))
            i += sizes[i]
        return out


def segment_words(df: DataFrame, text_col: str, lexicon: DataFrame, protected: list[str] = (), stopwords: list[str] = (), least: int = 2, out: str = "tokens") -> DataFrame:
    """df with out: array<string> of the lower-cased whole text's words by the lexicon (word, n).

    Protected terms are words wherever they stand, the longest first, those with spaces or marks too. Stopwords, words under `least`
    characters and numbers are left out; unknown runs stay. Null and empty texts have no words. A lexicon of more than WORDS words raises an error."""
    words = lexicon.select(F.lower(F.col("word").cast("string")).alias("word"), F.col("n").cast("long").alias("n")).where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.limit(WORDS + 1).collect()
    if len(words) > WORDS:
        raise ValueError(f"a lexicon of more than {WORDS} words")
    terms = sorted({t.lower() for t in protected if t}, key=lambda t: (-len(t), t))
    shared = df.sparkSession.sparkContext.broadcast(({r["word"]: r["n"] for r in words}, terms, frozenset(stopwords)))

    def run(batches):
        table, terms, stop = shared.value
        graph, found = WordGraph(table), re.compile("|".join(map(re.escape, terms))) if terms else None
        seen: dict[str, list[str]] = {}

        def of(part: str) -> list[str]:
            tokens: list[str] = []
            for m in _RUN.finditer(part):
                own = seen.get(m[0])
                if own is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    own = seen[m[0]] = [w for w, _ in graph.best(m[0])]
                tokens += own
            return tokens

        # few texts at once, so that a task holds the tokens of these only
        for b in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            lists = []
            for text in b.column(b.schema.get_field_index(text_col)).to_pylist():
                tokens, at, low = [], 0, (text or "").lower()
                for m in found.finditer(low) if found else ():
                    tokens += of(low[at : m.start()])
                    tokens.append(m[0])
                    at = m.end()
                tokens += of(low[at:])
                lists.append([t for t in tokens if len(t) >= least and t not in stop and not t.isnumeric()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.string()))], [*b.schema.names, out])

    rows = df.drop(out)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(StringType()))]))
