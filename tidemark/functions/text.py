"""Text expressions: normalising, sentences, tokens, n-grams, labels. All are columns, none needs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends of Latin scripts; pass another class for other scripts, such as "。！？；".
TERMINATORS = ".!?;"


def _class(terminators: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-" else c for c in terminators) + "]"


def collapse_space(text: Column) -> Column:
    """Ideographic spaces and runs of any white space become one space; ends are trimmed. Null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x{3000}]+", " "))


def normalize(text: Column, terminators: str = TERMINATORS) -> Column:
    """collapse_space, with a line end after each sentence end."""
    return F.btrim(F.regexp_replace(collapse_space(text), f"({_class(terminators)}) *", "$1\n"), F.lit(" \n"))


def sentences(text: Column, terminators: str = TERMINATORS, least: int = 4) -> Column:
    """Array of the sentences of at least `least` characters, each with its terminator."""
    parts = F.split(collapse_space(text), rf"(?<={_class(terminators)}) *")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def words(text: Column, least: int = 2, stop: list[str] | None = None) -> Column:
    """Lower-cased words of letters, digits and _, without those below `least` characters, of digits only, or in `stop`."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    keep = lambda w: (F.length(w) >= least) & ~w.rlike(r"^\p{N}+$")
    kept = F.filter(found, keep)
    return F.filter(kept, lambda w: ~w.isin(stop)) if stop else kept


def readability(text: Column, terminators: str = TERMINATORS) -> Column:
    """Characters a sentence end; null where there is none."""
    return F.try_divide(F.length(text).cast("double"), F.nullif(F.regexp_count(text, F.lit(_class(terminators))), F.lit(0)).cast("double"))


def bare(text: Column) -> Column:
    """Without white space and punctuation, for comparing sentences."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Punct}\p{IsPunctuation}\p{Z}]+", "")


def char_grams(text: Column, n: int = 3, distinct: bool = True) -> Column:
    """Character n-grams; the whole text if it is not longer than n, none if it is empty."""
    # the characters are taken apart once, so a text's cost is in proportion to its length
    of = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))
    many = F.element_at(F.transform(F.array(F.split(text, "")), of), 1)
    grams = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(many)
    return F.array_distinct(grams) if distinct else grams


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def contains_any(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def sign_label(value: Column, positive: str, negative: str, neutral: str = "neutral") -> Column:
    return F.when(value.isNull() | (value == 0), neutral).when(value > 0, positive).otherwise(negative)


def first_best(scores: dict[str, Column], other: str = "other") -> Column:
    """Name of the largest score, ties to the first named; `other` if the largest is 0 or missing."""
    top = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in scores.values()]) if len(scores) > 1 else F.coalesce(*scores.values(), F.lit(0.0))
    out = F.when(top <= 0, other)
    for name, c in scores.items():
        out = out.when(F.coalesce(c, F.lit(0.0)) == top, name)
    return out.otherwise(other)


def group_label(value: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.encode(value, "UTF-8")), 1, length)


def formatted(value: Column, digits: int = 4, missing: str = "—") -> Column:
    return F.when(value.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", value))


def looks_numeric(value: Column) -> Column:
    return value.rlike(r"^-?\d+(\.\d+)?$")


def last_section(text: Column, start: str, end: str, least: int = 200) -> Column:
    """The text from the last match of `start`, cut at the first match of `end` after its beginning; null below `least` characters."""
    n = F.regexp_count(text, F.lit(start))
    tail = F.element_at(F.split(text, start, -1), -1)
    head = F.element_at(F.regexp_extract_all(text, F.lit(f"({start})"), 1), -1)
    body = F.concat(head, tail)
    stop = F.regexp_instr(body, F.lit(end))
    cut = F.when(stop > 1, F.substring(body, F.lit(1), stop - 1)).otherwise(body)
    return F.when((n > 0) & (F.length(cut) >= least), cut)


def segment(text: Column, terms: list[str], stopwords: list[str] = (), least: int = 2) -> Column:
    """Words of a text, with the terms of a lexicon as words wherever they stand, the longest first; what lies between them is split into
    runs of letters and digits. Stopwords, words under `least` characters and numbers are left out."""
    known = "|".join("\\Q" + t + "\\E" for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?U)({known + '|' if known else ''}[\\p{{L}}\\p{{N}}_]+?(?={known or '(?!)'}|[^\\p{{L}}\\p{{N}}_]|$))"), F.lit(1))
    keep = lambda w: (F.length(w) >= least) & ~w.rlike(r"^\p{N}+$") & (~w.isin(list(stopwords)) if stopwords else F.lit(True))
    return F.filter(found, keep)
