"""Secrets in texts, with SQL functions only: three patterns, and windows of high entropy in candidate strings.

A kind's matches are taken with regexp_extract_all, their places from the lengths of what split() leaves
between them. The entropy kinds look at candidate strings: maximal runs of a character class that hold a
digit and a letter. A window of WINDOW characters slides over the string; with each step the counts of two characters change,
which are overwritten in a string that holds a count a place, and with them the running sum of c * log2(c), so entropy = log2(WINDOW) - sum / WINDOW. The span
runs from the first to the last window at or above the class's threshold. Windows that overlap a match of the allow-list
(placeholders, counting sequences, eight and more equal characters; leftmost matches, one after the other) do not count, and
candidates that are UUIDs add no span; the three base kinds are never suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, and how long the whole match or its value must be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs of 24 and more: those of [0-9a-f]+ that pass
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

WINDOW = 24
# class: candidate pattern, alphabet (a character's place is its count's place), least entropy in bits
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9])(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{24,}+(?![A-Za-z0-9])", "0123456789abcdef", 3.0),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{24,}+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 4.0),
}
# Strings that are not secrets though they look like them, as parts of a candidate and as a whole one.
ALLOW = r"(?i)example|sample|dummy|placeholder|change_?me|redacted|lorem|xxxx|your[_-]|0123456789|123456789|abcdefgh|(.)\1{7,}"
ALLOW_WHOLE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Stands for the characters of a match of ALLOW; no candidate has it.
MASK = "!"

_NONE = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(text: str, pattern: str, rank: int, passes: str, value_group: int = 0) -> str:
    """array<struct<start, rank, end>> of the pattern's passing matches; x.v is the value group in `passes`."""
    q = _quoted(pattern)
    zipped = f"arrays_zip(split({text}, {q}, -1), regexp_extract_all({text}, {q}, 0), regexp_extract_all({text}, {q}, {value_group}))"
    named = f"transform({zipped}, z -> named_struct('p', length(z.`0`), 'm', length(z.`1`), 'v', z.`2`))"
    step = f"""(a, x) -> named_struct('at', a.at + x.p + coalesce(x.m, 0), 'out',
        if({passes}, concat(a.out, array(named_struct('start', a.at + x.p, 'rank', {rank}, 'end', a.at + x.p + x.m))), a.out))"""
    return f"if({text} rlike {q}, aggregate({named}, named_struct('at', 0, 'out', {_NONE}), {step}, a -> a.out), {_NONE})"


def _entropy_span(string: str, masked: str, alphabet: str, least: float) -> str:
    """struct<lo, hi>: from the first to the last window of `string` with the least entropy and no MASK in `masked`; lo is -1 if none has."""
    code = f"instr({_quoted(alphabet)}, {{0}}) - 1"
    table = "array(" + ",".join(["0D"] + [f"{k * math.log2(k)}D" for k in range(1, WINDOW + 1)]) + ")"
    limit = WINDOW * (math.log2(WINDOW) - least)
    codes = f"transform(split({string}, ''), c -> {code.format('c')})"
    # two counts change: the one that comes in, and from the window's length on the one that goes out
    f = lambda e: f"element_at(t.f, {e} + 1)"
    count = lambda k: f"(ascii(substring(a.n, x.{k} + 1, 1)) - 65)"  # noqa: E731  a count is a letter, A for none
    came = f"overlay(a.n, char(66 + {count('new')}), x.new + 1, 1)"
    step = f"""(a, x) -> named_struct(
        'n', if(x.new = x.old, a.n, if(x.old < 0, {came}, overlay({came}, char(64 + {count('old')}), x.old + 1, 1))),
        's', if(x.new = x.old, a.s, a.s + {f(count('new') + ' + 1')} - {f(count('new'))} + if(x.old < 0, 0D, {f(count('old') + ' - 1')} - {f(count('old'))})),
        'i', a.i + 1, 'b', if(x.masked, a.i + 1, a.b), 'lo', a.lo, 'hi', a.hi)"""
    counts = f"a.i - a.b >= {WINDOW} and a.s <= {limit}D + 1e-9D"  # b: where the last masked character ends
    note = f"""a -> named_struct('n', a.n, 's', a.s, 'i', a.i, 'b', a.b,
        'lo', if(a.lo < 0 and {counts}, a.i - {WINDOW}, a.lo), 'hi', if({counts}, a.i, a.hi))"""
    start = f"named_struct('n', repeat('A', {len(alphabet)}), 's', 0D, 'i', 0, 'b', 0, 'lo', -1, 'hi', -1)"
    inner = step.split("->", 1)[1]
    body = f"element_at(transform(array({inner}), {note}), 1)"
    pairs = f"transform(t.c, (c, k) -> named_struct('new', c, 'old', if(k >= {WINDOW}, t.c[k - {WINDOW}], -1), 'masked', t.m[k] = '{MASK}'))"
    return f"element_at(transform(array(named_struct('c', {codes}, 'm', split({masked}, ''), 'f', {table})), t -> aggregate({pairs}, {start}, (a, x) -> {body}, a -> named_struct('lo', a.lo, 'hi', a.hi))), 1)"


def _entropies(text: str, kind: str) -> str:
    pattern, alphabet, least = CLASSES[kind]
    q = _quoted(pattern)
    rank = KINDS.index(kind)
    string = "lower(z.`1`)" if kind == "entropy_hex" else "z.`1`"
    allowed, a = f"z.`1` rlike {_quoted(ALLOW_WHOLE)}", _quoted(ALLOW)
    between = f"arrays_zip(split(z.`1`, {a}, -1), regexp_extract_all(z.`1`, {a}, 0))"
    masked = f"if(z.`1` rlike {a}, array_join(transform({between}, y -> concat(y.`0`, repeat('{MASK}', length(coalesce(y.`1`, ''))))), ''), z.`1`)"
    zipped = f"arrays_zip(split({text}, {q}, -1), regexp_extract_all({text}, {q}, 0))"
    none = "named_struct('lo', -1, 'hi', -1)"
    named = f"transform({zipped}, z -> named_struct('p', length(z.`0`), 'm', length(z.`1`), 'w', if(z.`1` is null or {allowed}, {none}, {_entropy_span(string, masked, alphabet, least)})))"
    step = f"""(a, x) -> named_struct('at', a.at + x.p + coalesce(x.m, 0), 'out',
        if(x.w.lo >= 0, concat(a.out, array(named_struct('start', a.at + x.p + x.w.lo, 'rank', {rank}, 'end', a.at + x.p + x.w.hi))), a.out))"""
    return f"if({text} rlike {q}, aggregate({named}, named_struct('at', 0, 'out', {_NONE}), {step}, a -> a.out), {_NONE})"


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with out: array<struct<start, rank, end>> by start, then rank (KINDS' place), then end; code points, end exclusive.

    Null and empty texts have no spans; every row stays, repeated rows too; a column named like `out` is replaced."""
    text = f"coalesce(cast(`{text_col}` as string), '')"
    kinds = [
        _placed(text, ASSIGN, 0, f"length(x.v) >= {ASSIGN_LEAST}", 2),
        _placed(text, ACCESS, 1, f"x.m >= {ACCESS_LEAST}"),
        _placed(text, HEX, 2, "x.m > 0"),
        _entropies(text, "entropy_hex"),
        _entropies(text, "entropy_base64"),
    ]
    return docs.withColumn(out, F.expr(f"array_sort(concat({', '.join(kinds)}))"))


def _joined(spans: str) -> str:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat(element_at({names}, s.rank + 1), ':', s.start, ':', s.end)), ',')"


def _free(columns: list[str]) -> str:
    """A column name that is not taken."""
    name, taken = "_found", {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row. Other columns are ignored."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), out="_found")
    count = lambda k: F.expr(f"cast(size(filter(_found, s -> s.rank = {k})) as long)")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.expr(f"sha2({_joined('filter(_found, s -> s.rank < 3)')}, 256)").alias("base_sha256"), F.expr(_joined("_found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of the text replaced by mark, overlapping spans by one; texts without spans stay as they are, null too. All other columns stay, whatever their names."""
    found = _free(docs.columns)
    rows = with_spans(docs, text_col, found)
    step = f"""(a, s) -> named_struct('at', greatest(a.at, s.end), 'out',
        if(s.start < a.at, a.out, concat(a.out, array(substring(`{text_col}`, a.at + 1, s.start - a.at), '{mark}'))))"""
    fold = f"aggregate({found}, named_struct('at', 0, 'out', cast(array() as array<string>)), {step}, a -> concat(array_join(a.out, ''), substring(`{text_col}`, a.at + 1, length(`{text_col}`))))"
    names = [F.expr(f"if(size({found}) = 0, `{c}`, {fold})").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(names)
