"""Lexicon scores of whole texts in one pass, whatever the lexicon's size.

An automaton over all words of the lexicon gives (word, place) in one walk over the sentences of many texts; a hit's weight comes from the modifiers
that lie within its reach, found by place. Work grows with the texts and their hits, not with the lexicon; what follows the walk is done on arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: (word, category) pairs of a lexicon at most; all tasks get them.
WORDS = 500_000
TOKEN_KINDS, PHRASE_KINDS, MODIFIERS = ("positive", "negative"), ("dovish", "hawkish"), ("degree", "negation", "turning")
FACTORS = {"negation": -1.0, "turning": 1.15}
#: Characters that are walked over at once (longer lines whole), and (hit, modifier) pairs that are weighed at once.
CHUNK, PAIRS = 1 << 20, 1 << 21
LEAST = 4  # characters of a sentence, as in T.sentences
SPACES = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def sentence_lines(text: str, terminators: str = T.TERMINATORS) -> str:
    """The sentences of T.sentences, as lines."""
    for c in SPACES:
        if c in text:
            text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    text = text.strip(" ")
    for c in dict.fromkeys(terminators):
        text = text.replace(c, "\n" if c == " " else c + "\n")
    return "\n".join([s for s in text.replace("\n ", "\n").split("\n") if len(s) >= LEAST])


@cache
def _kinds() -> np.ndarray:
    """Of each character: 2 for letters and _, 1 for numbers, else 0."""
    found = np.fromiter(({"L": 2, "N": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    found[ord("_")] = 2
    return found


def _spread(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For row k, counts[k] times: k, and first[k] counted up."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) + np.repeat(first - (np.cumsum(counts) - counts), counts)


class Words:
    """Words with lists of their own, and others that are found with them; the places where they stand in a text."""

    def __init__(self, words: dict[str, list], others: dict[str, list] | None = None):
        known, other = list(dict.fromkeys([*words, *(others or {})])), {w: k for k, w in enumerate(others or {})}
        self.automaton = ahocorasick.Automaton()
        for k, w in enumerate(known):
            self.automaton.add_word(w, k)
        self.automaton.make_automaton()
        self.sizes = np.fromiter(map(len, known), np.int64)
        self.other = np.fromiter((other.get(w, -1) for w in known), np.int64)
        self.counts = np.fromiter((len(words.get(w, ())) for w in known), np.int64)
        self.first, self.own = np.cumsum(self.counts) - self.counts, list(chain.from_iterable(words.values()))
        self.meets_itself = np.fromiter((w[0] in w[1:] and any(w.startswith(w[k:]) for k in range(1, len(w))) for w in known), bool)

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word) of all hits, by their ends."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        ends = found[:, 0] + 1
        return ends - self.sizes[found[:, 1]], ends, found[:, 1]

    def apart(self, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether a hit counts: a word's own occurrences do not overlap, the first one counts; other words' may."""
        out = np.ones(len(words), bool)
        may = np.flatnonzero(self.meets_itself[words])
        near = may[np.argsort(words[may], kind="stable")]
        meet = (words[near[1:]] == words[near[:-1]]) & (starts[near[1:]] < ends[near[:-1]])
        may = may[np.isin(words[may], words[near[1:][meet]])]
        free = {}
        for k, p, q, w in zip(may.tolist(), starts[may].tolist(), ends[may].tolist(), words[may].tolist()):
            if p < free.get(w, 0):
                out[k] = False
            else:
                free[w] = q
        return out


class Weights:
    """The modifiers of a text by their ends, and the weights they give to places."""

    def __init__(self, mods: Words | None, starts: np.ndarray, ends: np.ndarray, words: np.ndarray):
        self.mods, self.starts, self.ends, self.words = mods, starts, ends, words
        if mods is not None:
            self.keys = np.array([k for k, _ in mods.own], np.int64)
            self.factors = np.array([f for _, f in mods.own], np.float64)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each degree word inside [low, high) gives its factor once, negations -1 and turning words 1.15 together."""
        out = np.ones(len(low))
        if self.mods is None:
            return out
        a, b = np.searchsorted(self.ends, low, "right"), np.searchsorted(self.ends, high, "right")
        some = np.flatnonzero(b > a)
        blocks = np.cumsum(b[some] - a[some]) // PAIRS
        for at in np.split(some, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1) if len(some) else ():
            hits, k = _spread(b[at] - a[at], a[at])
            inside = self.starts[k] >= low[at][hits]
            hits, words = hits[inside], self.words[k[inside]]
            rows, own = _spread(self.mods.counts[words], self.mods.first[words])
            hits, keys = hits[rows], self.keys[own]
            # the first of each (hit, key), in the order of the text
            once = np.sort(np.unique(hits * (self.keys.max() + 1) + keys, return_index=True)[1])
            np.multiply.at(out, at[hits[once]], self.factors[own[once]])
        return out


class Scorer:
    """Sums of weights for each category, of many texts at once."""

    def __init__(self, rows: list[tuple[str, str, float | None]], reach: int = 8, token_reach: int = 3):
        kinds = sorted({c for _, c, _ in rows} - {*TOKEN_KINDS, *PHRASE_KINDS, *MODIFIERS})
        self.names, self.reach, self.token_reach = [*TOKEN_KINDS, *PHRASE_KINDS, *kinds], reach, token_reach
        at = {n: k for k, n in enumerate(self.names)}
        tokens, phrases, mods, keys = {}, {}, {}, {}
        for word, kind, factor in rows:
            if not word or "\n" in word:  # no sentence holds a line end
                continue
            if kind in MODIFIERS:
                key = keys.setdefault((kind, word) if kind == "degree" else kind, len(keys))
                mods.setdefault(word, {})[key] = FACTORS.get(kind, factor)
            else:
                own = (tokens if kind in TOKEN_KINDS else phrases).setdefault(word, [])
                if at[kind] not in own:
                    own.append(at[kind])
        self.weighted = len(TOKEN_KINDS) + len(PHRASE_KINDS)
        mods = {w: list(m.items()) for w, m in mods.items()}
        self.mods = Words(mods) if mods else None
        self.tokens, self.phrases = Words(tokens) if tokens else None, Words(phrases, mods) if phrases else None

    def sums(self, texts: Iterable[str | None], terminators: str = T.TERMINATORS) -> list[list[float] | None]:
        """A list of sums for each text; none for a missing one."""
        out, there = [], []

        def pieces() -> Iterator[tuple[int, str]]:
            for k, t in enumerate(texts):
                there.append(t is not None)
                lines, at = sentence_lines(t or "", terminators), 0
                while at < len(lines):  # a long text is cut between sentences
                    end = lines.find("\n", at + CHUNK)
                    end = end if end >= 0 else len(lines)
                    yield k, lines[at:end]
                    at = end + 1

        held, size = [], 0
        for k, piece in pieces():
            held.append((k, piece))
            size += len(piece)
            if size >= CHUNK:
                self._add(held, out)
                held, size = [], 0
        if held:
            self._add(held, out)
        out += [np.zeros(len(self.names)) for _ in range(len(there) - len(out))]
        return [s.tolist() if h else None for s, h in zip(out, there)]

    def _add(self, held: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        first, n = held[0][0], len(self.names)
        out += [np.zeros(n) for _ in range(held[-1][0] + 1 - len(out))]
        sums = np.concatenate(out[first:])
        owners = np.array([k - first for k, _ in held])
        text = "\n".join([p for _, p in held])
        if self.phrases is not None:
            begins = np.cumsum([0, *[len(p) + 1 for _, p in held[:-1]]])
            self._add_phrases(text, lambda places: owners[np.searchsorted(begins, places, "right") - 1], sums)
        if self.tokens is not None:
            lines = np.repeat(owners, [p.count("\n") + 1 for _, p in held])
            self._add_tokens(text.lower(), lines, sums)
        out[first:] = sums.reshape(-1, n)

    def _put(self, found: Words, words: np.ndarray, owners: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> None:
        rows, own = _spread(found.counts[words], found.first[words])
        kinds = np.array(found.own, np.int64)[own]
        np.add.at(sums, owners[rows] * len(self.names) + kinds, np.where(kinds < self.weighted, weights[rows], 1.0))

    def _add_phrases(self, text: str, owner, sums: np.ndarray) -> None:
        starts, ends, words = self.phrases.places(text)
        other = self.phrases.other[words]
        there = other >= 0
        mods = Weights(self.mods, starts[there], ends[there], other[there])
        there = (self.phrases.counts[words] > 0) & self.phrases.apart(starts, ends, words)
        starts, words = starts[there], words[there]
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
        line = np.concatenate([[0], breaks])[np.searchsorted(breaks, starts, "right")]
        weights = mods.of(np.maximum(starts - self.reach, line), starts)
        self._put(self.phrases, words, owner(starts), weights, sums)

    def _add_tokens(self, text: str, owners: np.ndarray, sums: np.ndarray) -> None:
        """Tokens are those of T.words; what stands before one is the tokens before it in its sentence, with nothing between them."""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = _kinds()[chars]
        inside = np.concatenate([[False], kinds > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return
        kept = (ends - starts >= 2) & (np.maximum.reduceat(kinds, starts) == 2)
        starts, ends = starts[kept], ends[kept]
        p, q, words = self.tokens.places(text)
        k = np.searchsorted(starts, p)
        hits = np.flatnonzero((k < len(starts)) & (np.append(starts, -1)[k] == p) & (np.append(ends, -1)[k] == q))
        if not len(hits):
            return
        k, p, words = k[hits], p[hits], words[hits]
        breaks = np.flatnonzero(chars == 10)
        line = np.searchsorted(breaks, p)
        a = np.maximum(np.searchsorted(starts, np.concatenate([[0], breaks])[line]), k - self.token_reach)
        # only the tokens before a hit are laid side by side
        near = np.cumsum(np.bincount(a, minlength=len(starts) + 1) - np.bincount(k, minlength=len(starts) + 1))[:-1] > 0
        step = np.zeros(len(chars) + 1, np.int8)
        step[starts[near]], step[ends[near]] = 1, -1
        mods = [np.zeros(0, np.int64)] * 3
        if self.mods is not None:
            mods = self.mods.places(chars[np.cumsum(step[:-1], dtype=np.int8).view(bool)].tobytes().decode("utf-32-le"))
        at = np.concatenate([[0], np.cumsum((ends - starts) * near)])
        self._put(self.tokens, words, owners[line], Weights(self.mods, *mods).of(at[a], at[k]), sums)


def word_counts(docs: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, n): how often each of T.words stands in all texts. Texts are split without an array function a word; numbers go once they are counted, a distinct one at a time."""
    found = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+")).alias("word")).where(F.length("word") >= least)
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    # a condition on n too, which Spark does not move before the count
    return counts.where(F.when(~F.col("word").rlike(r"^\p{N}+$"), F.col("n")) > 0)


def lexicon_rows(lexicon: DataFrame) -> list[tuple[str, str, float | None]]:
    """(word, category, factor) of a lexicon, distinct, without blank words. More than WORDS rows, and degree words without or with two factors, raise errors."""
    cols = [F.col("word").cast("string"), F.col("category").cast("string"), (F.col("factor") if "factor" in lexicon.columns else F.lit(None)).cast("double").alias("factor")]
    rows = [tuple(r) for r in lexicon.select(*cols).where("word <> '' and category is not null").distinct().limit(WORDS + 1).collect()]
    if len(rows) > WORDS:
        raise ValueError(f"a lexicon of more than {WORDS} rows")
    degrees = [(w, f) for w, c, f in rows if c == "degree"]
    if any(f is None for _, f in degrees) or len({w for w, _ in degrees}) < len(degrees):
        raise ValueError("each degree word needs one factor")
    return sorted(rows, key=lambda r: (r[1], r[0]))


def category_sums(docs: DataFrame, rows: list[tuple[str, str, float | None]], id_col: str, text_col: str, reach: int = 8, token_reach: int = 3, terminators: str = T.TERMINATORS) -> tuple[DataFrame, list[str]]:
    """(id_col, n_chars, sums: array<double>) of each whole text, and the categories of the sums. Null texts have null sums and length."""
    rowed = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t")).select("_i", F.length("_t").cast("long").alias("n_chars"), "_t")
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    names = Scorer(rows).names

    def run(batches):
        scorer = Scorer(shared.value, reach, token_reach)
        for b in batches:
            sums = scorer.sums(map(pa.StringScalar.as_py, b.column(2)), terminators)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.list_(pa.float64()))], ["_i", "n_chars", "sums"])

    kind = rowed.schema["_i"].dataType.simpleString()
    return rowed.mapInArrow(run, f"_i {kind}, n_chars long, sums array<double>").withColumnRenamed("_i", id_col), names


def lexicon_scores(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, token_reach: int = 3, terminators: str = T.TERMINATORS) -> DataFrame:
    """id_col, sentiment, stance and attention_<topic> of each whole text, per 1000 characters, by a lexicon (word, category, factor) of up to WORDS rows.

    Categories: positive and negative (whole tokens), dovish and hawkish (phrases, wherever they stand), degree (with a factor), negation, turning;
    any other category is a topic, whose phrases are counted. Null texts have null scores, empty ones zeros; repeated rows stay, other columns are ignored."""
    return per_thousand(*category_sums(docs, lexicon_rows(lexicon), id_col, text_col, reach, token_reach, terminators), id_col)


def per_thousand(sums: DataFrame, names: list[str], id_col: str) -> DataFrame:
    per, z = 1000.0 / F.greatest(F.col("n_chars"), F.lit(1)), lambda n: F.get("sums", F.lit(names.index(n)))
    out = [((z("positive") - z("negative")) * per).alias("sentiment"), ((z("dovish") - z("hawkish")) * per).alias("stance")]
    there = F.col("sums").isNotNull()
    return sums.select(id_col, *[F.when(there, c).alias(n) for c, n in zip(out, ("sentiment", "stance"))], *[F.when(there, z(n) * per).alias(f"attention_{n}") for n in names[4:]])
