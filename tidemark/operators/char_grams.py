"""Character 2- to 4-grams of many texts at once, counted on arrays: sorted numbers instead of a dictionary a text."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters that are counted at once.
CHARACTERS = 1_000_000


def gram_counts(text: str | None) -> Counter:
    """How often each character 2- to 4-gram occurs; a text that is not longer than n is its only n-gram."""
    t = text or ""
    out: Counter = Counter()
    for n in (2, 3, 4):
        out.update(map("".join, zip(*(t[k:] for k in range(n)))) if len(t) > n else [t] * bool(t))
    return out


def chunks(texts: list[str | None]):
    """Ranges of texts of about CHARACTERS characters."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= CHARACTERS):
            size += len(texts[stop] or "")
            stop += 1
        yield at, stop
        at = stop


def cells(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term, text, n): the distinct n-grams of all texts, and for each that a text has its place among the terms, the text's, and how often,
    as gram_counts counts them."""
    found = _sorted_cells(texts)
    return _counted_cells(texts) if found is None else found


def _counted_cells(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The same by gram_counts; for texts of very many different characters, or with NUL."""
    own = [gram_counts(t) for t in texts]
    codes: dict[str, int] = {}
    term = np.array([codes.setdefault(g, len(codes)) for c in own for g in c], np.int64)
    n = np.array([v for c in own for v in c.values()], np.int64)
    return list(codes), term, np.repeat(np.arange(len(own)), [len(c) for c in own]), n


def _sorted_cells(texts: list[str | None]):
    """An n-gram is a number of up to four characters, as few bits each as the characters take, with its text behind; none if that needs over 64 bits."""
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    bits, row_bits = len(alphabet).bit_length(), max(1, (len(texts) - 1).bit_length())
    if seen[0] or 4 * bits + row_bits > 64:
        return None
    ids = np.zeros(0x110000, np.uint64)
    ids[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    left = ends[text] - np.arange(len(codes))  # characters from here to the text's end
    shift = lambda n: np.uint64(n * bits)
    own = ids[codes]
    own = np.concatenate((own, np.zeros(3, np.uint64)))
    last = len(codes)
    row = text.astype(np.uint64)
    keys, gram = [], own[:last]
    for n in (2, 3, 4):
        gram = gram << shift(1) | own[n - 1 : last + n - 1]
        whole = left >= n
        keys.append((gram[whole] << shift(4 - n)) << np.uint64(row_bits) | row[whole])
    for size in (1, 2, 3):  # texts shorter than n are their own n-gram
        for k in np.flatnonzero(sizes == size):
            at = int(ends[k]) - size
            gram_of = 0
            for c in own[at : at + size].tolist():
                gram_of = gram_of << bits | c
            keys.append(np.full(4 - size if size > 1 else 3, (gram_of << ((4 - size) * bits)) << row_bits | int(k), np.uint64))
    key = np.concatenate(keys)
    key.sort()
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(starts, len(key)))
    key = key[starts]
    grams = key >> np.uint64(row_bits)
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    mask, letters = np.uint64((1 << bits) - 1), np.concatenate((np.zeros(1, np.uint32), alphabet))
    chars = np.stack([letters[(grams[new] >> shift(3 - k)) & mask] for k in range(4)], axis=1)
    terms = np.ascontiguousarray(chars).view("U4").ravel().tolist()
    return terms, np.cumsum(new) - 1, (key & np.uint64((1 << row_bits) - 1)).astype(np.int64), n


class Terms:
    """Numbers of known terms: each text's (number, n), by text."""

    def __init__(self, terms: list[str]):
        self.codes = {t: k for k, t in enumerate(terms)}

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, code, n): how many known terms each text has, then which ones, in order, and how often."""
        terms, term, text, n = cells(texts)
        code = np.fromiter((self.codes.get(t, -1) for t in terms), np.int64, len(terms))[term]
        known = np.flatnonzero(code >= 0)
        code, text, n = code[known], text[known], n[known]
        order = np.argsort(text * len(self.codes) + code)
        return np.bincount(text, minlength=len(texts)), code[order], n[order]
