"""Operators 11 to 13 against plain Python over the same rows, and archives that are damaged on purpose."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import filter_audit, queries, ranked_search, warc

duckdb = pytest.importorskip("duckdb")

DOCS = "doc_id long, text string, lang string, part string, bits int"
LABELS = "doc_id long, quality int, toxic int, lang string"


def sql_rows(name, folder, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    return [d[0] for d in cur.description], cur.fetchall()


def same_as_sql(spark, name, folder, tables):
    df = queries.queries()[name](spark, str(folder))
    names, want = sql_rows(name, folder, tables)
    got = [tuple(r) for r in df.select(names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


# -- 11 --------------------------------------------------------------------------------------------------------------


def audit_rows(r):
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "A B C", "x" * 50, "HELLO WORLD " * 60, "cost $5 " * 3, " wide space " * 40, "\x0b\x0c\r\n".join(words[:120])]
    texts += [" ".join(r.choice(words[: r.choice([5, 80, 400])]) for _ in range(r.choice([20, 99, 100, 101, 300]))) + r.choice(["", " #", " |", " ABC" * 90]) for _ in range(60)]
    texts += texts[4:30] + [texts[12]] * 25
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, t, r.choice(["en", "de", None, ""]), "own", 7) for i, t in zip(ids, texts)]
    rows += [rows[20], rows[20], (None, texts[12], "en", None, None), (None, texts[12], "en", None, None), (None, "only here", "en", None, None), (ids[5], texts[12], "de", "x", 0)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "zz") for i in ids if r.random() < 0.6] + [(None, 1, 1, "zz"), (ids[12], 1, 0, "zz"), (ids[12], 0, 1, "zz")]
    return rows, labels


def brute_audit(rows, labels):
    least, marks = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, t, _ in labels:
        if i is not None:
            old = marks.get(i, (False, False))
            marks[i] = (old[0] or q == 1, old[1] or t == 1)
    docs = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        docs.setdefault(lang or "", []).append(({c for c, f in zip("ABCDE", fails) if f}, *marks.get(i, (False, False))))
    out = []
    for part, own in docs.items():
        total = Counter()
        found = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                before = set(order[:k])
                total[c] += len(gone)
                found.append((part, order, k + 1, c, len(left), len(gone), sum(c in d[0] and bool(d[0] & before) for d in own), sum(d[0] == {c} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(p, o, k, *rest, total[c]) for p, o, k, c, *rest in found]
    return sorted(out)


def test_filter_audit_equals_brute_force_and_sql(spark, tmp_path):
    rows, labels = audit_rows(random.Random(3))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = sorted(tuple(r) for r in filter_audit.audit(docs.repartition(7), marks).collect())
    assert got == brute_audit(rows, labels)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()), "toxic": pa.array([r[2] for r in labels], pa.int32())}), tmp_path / "labels.parquet")
    assert sorted((r for r in same_as_sql(spark, "op11_filter_audit", tmp_path, ["documents", "labels"]))) == got


def test_filter_audit_of_nothing_and_of_one_long_text(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).collect() == []
    long = [(1, "Word another " * 400_000, None, None, None)]
    rows = filter_audit.audit(spark.createDataFrame(long, DOCS), none)
    assert sorted(tuple(r) for r in rows.collect()) == brute_audit(long, [])


# -- 12 --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, first long, key string"


def page_rows():
    html = ["<p>a</p>", "", None, "é\U0001f600 \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "x" * 200_000, "<p>a</p>", "\x1f\x8b\x08 no member", "<b>"]
    rows = [(k, f"http://h/{k}?q=a b\r\nc", t, "p", 3, "k") for k, t in enumerate(html)]
    rows += [(k, None, "<p>copy</p>", None, None, None) for k in range(100, 140)]
    return rows + [(139, "again", "<p>copy</p>", None, None, None), (None, "n", "<p>copy</p>", None, None, None), (None, "n", "alone", None, None, None), (None, "m", "alone", None, None, None), (-5, "", "<b>", None, None, None)]


def expected_pages(rows):
    first = {}
    for i, _, t, *_ in rows:
        if i is not None:
            first[t or ""] = max(i, first.get(t or "", i))
    out = []
    for i, _, t, *_ in rows:
        raw, to = (t or "").encode(), first.get(t or "")
        again = to is not None and i != to
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("sent", [0, 1000])
def test_archives_round_trip(spark, tmp_path, monkeypatch, compressed, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    rows = page_rows()
    folder = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/a", compressed, archive_bytes=3000)
    read = warc.read_archives(spark, folder)
    assert sorted((tuple(r) for r in warc.page_records(read).collect()), key=repr) == expected_pages(rows)
    whole = {r.record_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect() if "null" not in r.record_id}
    assert whole["<urn:page:3>"] == rows[3][2] and whole["<urn:page:4>"] == rows[4][2]
    assert read.where("kind = 'gap'").count() == 0
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 3  # several archives a task
    for f in files:  # other programs read them too
        text = gzip.decompress(f.read_bytes()) if compressed else f.read_bytes()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_no_pages_and_sql(spark, tmp_path):
    for name, rows in (("some", page_rows()), ("none", [])):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string())}), tmp_path / name / "pages.parquet")
        assert len(same_as_sql(spark, "op12_warc", tmp_path / name, ["pages"])) == len(rows)


def archive(r, n, compressed):
    parts = []
    for k in range(n):
        payload = bytes(r.choice(b"ab<>\r\n WARC/1.1") for _ in range(r.randrange(0, 4000)))
        one = warc.record("response", k, "u", payload, len(payload), hashlib.sha1(payload).digest()) + warc.END
        parts.append(warc.member(one) if compressed else one)
    return parts


def covered(data, found):
    """Records and gaps follow one another; empty members may lie between."""
    at = 0
    for f in found:
        assert set(data[at : f.start]) == set() or data[at : f.start] == warc.EMPTY_MEMBER * ((f.start - at) // 20)
        at = f.stop
    return at


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_what_is_whole(compressed):
    r = random.Random(9)
    for trial in range(60):
        parts = archive(r, 12, compressed)
        starts = np.cumsum([0, *map(len, parts)])
        data = bytearray(b"".join(parts))
        hurt = set()
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(12)
            hurt.add(k)
            at = r.randrange(starts[k], starts[k + 1])
            data[at : at + 3] = bytes(255 - b for b in data[at : min(at + 3, starts[k + 1])])
        if trial % 3 == 0:  # cut short as well
            hurt.add(11)
            del data[-r.randrange(1, len(parts[11])) :]
        found = list(warc.salvage(bytes(data)))
        assert covered(data, found) == len(data)
        ids = [f.record.headers["warc-record-id"] for f in found if f.record]
        # fields that no digest covers may change and leave a record valid (its id, its date, a gzip header's time)
        assert set(ids) >= {f"<urn:page:{k}>" for k in range(12) if k not in hurt} and len(ids) <= 12 and all(f.reason for f in found if not f.record)
        for f in found:
            if f.record:
                assert warc.base32(hashlib.sha1(f.record.payload).digest()) == f.record.digest


def test_salvage_of_odd_archives():
    one = warc.record("response", 1, "u", b"abc", 3, hashlib.sha1(b"abc").digest()) + warc.END
    shape = lambda data: [(f.start, f.stop, f.reason if f.record is None else None) for f in warc.salvage(data)]
    assert shape(b"") == []
    assert shape(b"junk") == [(0, 4, "no version line")]
    assert shape(b"junk" + one) == [(0, 4, "no version line"), (4, 4 + len(one), None)]
    assert shape(one[:-5]) == [(0, len(one) - 5, "a record cut short")]
    assert [x[2] for x in shape(one.replace(b"abc", b"abd") + one)] == ["a wrong block digest", None]
    assert [x[2] for x in shape(one.replace(b"Content-Length: 8", b"Content-Length: 7", 1) + one)][-1] is None
    both = warc.member(one + one)
    assert shape(both) == [(0, len(both), None)] * 2
    half = warc.member(one)[:-4] + b"\0\0\0\0"
    assert shape(half + one + warc.EMPTY_MEMBER) == [(0, len(half), "a broken member"), (len(half), len(half) + len(one), None)]
    # a record inside the payload of a damaged one is found too, as nothing else can be told
    outer = warc.record("response", 2, "u", one, len(one), hashlib.sha1(one).digest()) + warc.END
    assert [f.record.headers["warc-record-id"] for f in warc.salvage(outer)] == ["<urn:page:2>"]


def test_gaps_are_logged_with_their_archive(spark, tmp_path):
    parts = archive(random.Random(1), 5, True)
    parts[2] = parts[2][:40] + b"\0\0\0" + parts[2][43:]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    rows = warc.read_archives(spark, f"file://{tmp_path}", with_payload=False).orderBy("start").collect()
    gap = [r for r in rows if r.kind == "gap"]
    assert len(rows) == 5 and len(gap) == 1 and gap[0].archive.endswith("x.warc.gz") and gap[0].reason
    assert (gap[0].start, gap[0].stop) == (len(parts[0]) + len(parts[1]), sum(map(len, parts[:3])))


# -- 13 --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute_search(docs, items):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def search_rows(r):
    words = ["the", "Of", "straße", "STRASSE", "İx", "日本", "a1b2", "x_y", "don't", "naïve", " gap", "zero"] + [f"w{k}" for k in range(60)]
    text = lambda n: r.choice([" ", "\n", "-", "\x00"]).join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.randrange(0, 60))) for k in range(300)] + [(400, None), (401, ""), (402, "!?"), (403, "the " * 3000), (None, text(20)), (None, text(30)), (7, text(10)), (7, text(10))]
    docs += [(500 + k, docs[3][1]) for k in range(30)]  # equal scores
    items = [(k, text(r.choice([1, 5, 40]))) for k in range(25)] + [(90, None), (91, ""), (92, "--"), (93, "nowhere"), (None, "the w3"), (94, "w5"), (94, "w6 w5"), (95, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes, entries", [(1 << 22, 1 << 20), (300, 50)])
def test_search_equals_brute_force(spark, monkeypatch, block_bytes, entries):
    monkeypatch.setattr(ranked_search, "ENTRIES", entries)
    docs, items = search_rows(random.Random(4))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id long, score long").repartition(5)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id long")
    got = ranked_search.search(df, asked, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items)


def test_search_equals_sql_and_takes_empty_tables(spark, tmp_path):
    docs, items = search_rows(random.Random(6))
    for name, d, i in (("both", docs, items), ("no_docs", [], items), ("no_items", docs, []), ("blank", [(1, " "), (2, None)], items)):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in d], pa.int64()), "text": pa.array([r[1] for r in d], pa.string())}), tmp_path / name / "documents.parquet")
        pq.write_table(pa.table({"item_id": pa.array([r[0] for r in i], pa.int64()), "text": pa.array([r[1] for r in i], pa.string())}), tmp_path / name / "benchmark.parquet")
        assert bool(same_as_sql(spark, "op13_ranked_search", tmp_path / name, ["documents", "benchmark"])) == (name == "both")


def test_radix_order_and_long_texts(monkeypatch):
    r = np.random.default_rng(0)
    for bits in (3, 16, 17, 40, 63):
        keys = r.integers(0, 1 << bits, 5000, dtype=np.uint64) // 7 * 7
        assert (ranked_search.radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()
    text = "Ab, é-9 " * 1000 + "z" * 500
    whole = ranked_search.term_counts(text)
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", 37)
    assert ranked_search.term_counts(text) == whole == (Counter({b"ab": 1000, "é".encode(): 1000, b"9": 1000, b"z" * 500: 1}), 3001)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
@pytest.mark.parametrize("name, tables", [("op11_filter_audit", ["documents", "labels"]), ("op12_warc", ["pages"]), ("op13_ranked_search", ["documents", "benchmark"])])
def test_same_rows_on_the_tables(spark, name, tables):
    assert same_as_sql(spark, name, "/root/testdata/sf0.01", tables)
