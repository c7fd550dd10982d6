"""Lexicon scores of texts: phrase and token hits with context weights, topic counts, rule gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.lexicon import category_sums, per_thousand


@dataclass(frozen=True)
class Lexicon:
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    dovish: tuple[str, ...] = ()
    hawkish: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()
    turning: tuple[str, ...] = ()
    degree: dict[str, float] = field(default_factory=dict)
    topics: dict[str, tuple[str, ...]] = field(default_factory=dict)


def hit_weight(prefix: Column, lex: Lexicon) -> Column:
    """Each degree factor whose word is in the prefix, times -1 for any negation, times 1.15 for any turning word."""
    w = F.lit(1.0)
    for word, factor in lex.degree.items():
        w = w * F.when(F.contains(prefix, F.lit(word)), float(factor)).otherwise(1.0)
    return w * F.when(T.contains_any(prefix, list(lex.negations)), -1.0).otherwise(1.0) * F.when(T.contains_any(prefix, list(lex.turning)), 1.15).otherwise(1.0)


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _before(tails: Column, word: str, reach: int, lex: Lexicon):
    """The weight of the j-th occurrence: `reach` characters lie within the reach + 1 parts before it, whose last characters suffice."""
    near = lambda j: F.slice(tails, F.greatest(j - reach, F.lit(1)), F.least(j, F.lit(reach + 1)))
    return lambda j: _let(F.right(F.array_join(near(j), word), F.lit(reach)), lambda before: hit_weight(before, lex))


def phrase_score(sentence: Column, words: tuple[str, ...], lex: Lexicon, reach: int = 8) -> Column:
    """Sum over all occurrences of all words of the weight that the `reach` characters before give. Overlapping list words all count."""
    total = F.lit(0.0)
    for word in words:
        total = total + _let(F.transform(F.split(sentence, "\\Q" + word + "\\E", -1), lambda p: F.right(p, F.lit(reach))), _summed(word, reach, lex))
    return total


def _summed(word: str, reach: int, lex: Lexicon):
    def body(parts: Column) -> Column:
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(places, _before(parts, word, reach, lex)), F.lit(0.0), lambda a, x: a + x)

    return body


def token_score(tokens: Column, words: tuple[str, ...], lex: Lexicon, reach: int = 3) -> Column:
    """Sum over tokens in `words` of the weight that up to `reach` tokens before, joined, give."""
    if not words:
        return F.lit(0.0)

    def body(t: Column) -> Column:
        places = F.filter(F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>")), lambda i: F.get(t, i - 1).isin(list(words)))
        before = lambda i: F.array_join(F.slice(t, F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach))), "")
        return F.aggregate(F.transform(places, lambda i: hit_weight(before(i), lex)), F.lit(0.0), lambda a, x: a + x)

    return _let(tokens, body)


def _scores_of(sentence: Column, lex: Lexicon) -> dict[str, Column]:
    tokens = T.words(sentence)
    cols = {
        "pos": token_score(tokens, lex.positive, lex), "neg": token_score(tokens, lex.negative, lex),
        "dovish": phrase_score(sentence, lex.dovish, lex), "hawkish": phrase_score(sentence, lex.hawkish, lex),
    }
    for topic, words in lex.topics.items():
        n = F.lit(0)
        for w in words:
            n = n + T.occurrences(sentence, w)
        cols[f"topic_{topic}"] = n
    return cols


def sentence_scores(df: DataFrame, sentence: str, lex: Lexicon) -> DataFrame:
    """df (a row a sentence) with pos, neg (token hits), dovish, hawkish (phrase hits) and a count for each topic."""
    return df.withColumns(_scores_of(F.col(sentence), lex))


def lexicon_of(lex: Lexicon) -> list[tuple[str, str, float | None]]:
    """The lexicon as (word, category, factor)."""
    lists = {"positive": lex.positive, "negative": lex.negative, "dovish": lex.dovish, "hawkish": lex.hawkish, "negation": lex.negations, "turning": lex.turning, **lex.topics}
    return [(w, c, None) for c, words in lists.items() for w in words] + [(w, "degree", float(f)) for w, f in lex.degree.items()]


def text_scores(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text", terminators: str = T.TERMINATORS) -> DataFrame:
    """sentiment, stance and topic attention of each text, per 1000 characters of the raw text. Missing texts have missing scores.

    All words are found in one pass over the text (operators/lexicon.py); a word that a list names twice counts once."""
    scores = per_thousand(*category_sums(docs, lexicon_of(lex), id_col, text_col, terminators=terminators), id_col)
    empty = [F.col("sentiment") * 0 for t in lex.topics]
    have = [F.col(f"attention_{t}") if f"attention_{t}" in scores.columns else e.alias(f"attention_{t}") for t, e in zip(lex.topics, empty)]
    return scores.select(id_col, "sentiment", "stance", *have)


def gated(label: Column, sentence: Column, triggers: list[str], irrelevant: list[str], neutral: str = "neutral", other: str = "irrelevant") -> Column:
    """A neutral label becomes irrelevant without a trigger word or with a default-irrelevant word; directional labels pass."""
    drop = ~T.contains_any(sentence, triggers) | T.contains_any(sentence, irrelevant)
    return F.when((label == neutral) & drop, other).otherwise(label)
