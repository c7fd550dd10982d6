"""Segmentation, stitched sessions, settled quotas and workbooks against brute force and on odd rows."""

import io
import math
import random
import zipfile
from collections import Counter

import pytest

from tidemark.operators import sampling, segmentation
from tidemark.operators.sessions import sessions
from tidemark.sources import workbooks


def all_paths(run, words, unknown):
    """The largest sum over all ways to cut a run."""
    best = [0.0] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        best[i] = max(words.get(run[i:j], unknown if j == i + 1 else -math.inf) + best[j] for j in range(i + 1, len(run) + 1))
    return best[0]


def test_segmentation_takes_the_best_path():
    r = random.Random(2)
    for _ in range(300):
        counts = {"".join(r.choice("abc日") for _ in range(r.randrange(1, 5))): r.randrange(1, 50) for _ in range(r.randrange(1, 12))}
        graph, total = segmentation.WordGraph(counts), sum(counts.values())
        weights, unknown = {w: math.log(n / total) for w, n in counts.items()}, math.log(0.5 / total)
        run = "".join(r.choice("abc日x") for _ in range(r.randrange(0, 12)))
        found = graph.best(run)
        assert "".join(w for w, _ in found) == run
        assert all(w in counts for w, known in found if known) and not any(a[1] is b[1] is False for a, b in zip(found, found[1:]))
        assert sum(weights[w] if known else unknown * len(w) for w, known in found) == pytest.approx(all_paths(run, weights, unknown))


def test_segmented_texts(spark):
    lexicon = spark.createDataFrame([("rate", 50), ("interest", 40), ("in", 30), ("terest", 1), ("Rise", 5), (None, 3), ("zero", 0)], "word string, n int")
    texts = ["InterestRateRise 2024", "the interestratexyz, up-to-date rate", None, "", "x" * 100_000 + "rate", "12 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").selectExpr("*", "'old' as tokens")
    got = {r.doc_id: r.tokens for r in segmentation.segment_words(df, "t", lexicon, ["up-to-date"], ["the"]).collect()}
    assert got == {0: ["interest", "rate", "rise"], 1: ["interest", "rate", "xyz", "up-to-date", "rate"], 2: [], 3: [], 4: ["x" * 100_000, "rate"], 5: []}
    old, segmentation.WORDS = segmentation.WORDS, 2
    try:
        with pytest.raises(ValueError):
            segmentation.segment_words(df, "t", lexicon)
    finally:
        segmentation.WORDS = old


def test_sessions_are_stitched(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(0, 40_000)) for k in range(1500)] + [(2000 + k, "gap", k * 1000) for k in range(50)] + [(3000, "late", -5), (3001, "late", 10**7)]
    for gap, bucket in ((60, 100), (1000, 7), (10, 50_000)):
        got = {x.i: x.session for x in sessions(spark.createDataFrame(rows, "i int, u string, at long"), "u", "at", ["i"], gap, bucket).where("u is not null").collect()}
        for u in {x[1] for x in rows} - {None}:
            last, n = None, 0
            for i, _, at in sorted((x for x in rows if x[1] == u), key=lambda x: (x[2], x[0])):
                n += last is not None and at - last >= gap
                last = at
                assert got[i] == n


def test_quotas_settle(spark):
    r = random.Random(4)
    rows = [(s, f"t{k}", r.choice([0, 1, 2, 5, 40, 300])) for s in ("one", "two", "three") for k in range(r.randrange(1, 9))]
    for total in (1, 7, 60, 500, 5000):
        got = {(x.s, x.t): x.quota for x in sampling.settled_quotas(spark.createDataFrame(rows, "s string, t string, n int"), "s", "t", total).collect()}
        for s in ("one", "two", "three"):
            own, want, left = sorted((t, n) for q, t, n in rows if q == s), Counter(), total
            while left and any(want[t] < n for t, n in own):
                for t, n in own:
                    if left and want[t] < n:
                        want[t] += 1
                        left -= 1
            assert {t: got[s, t] for t, _ in own} == {t: want[t] for t, _ in own}
    people = spark.createDataFrame([(k, "a" if k % 3 else "b", f"t{min(k % 10, 4)}") for k in range(200)], "k int, s string, t string")
    assert Counter(x.s for x in sampling.repaired_sample(people, "s", "t", ["k"], 50).collect()) == {"a": 50, "b": 50}


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(sheets, strings=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    shared = ["<t>word</t>", "<t>good</t>", "<r><t>fi</t></r><r><t>ne</t></r><rPh><t>no</t></rPh>", "<t>n</t>"]
    words = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>3</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.5</v></c></row><row r="4"><c t="s"><v>2</v></c><c t="b"><v>1</v></c></row><row r="5"><c r="B5"/></row>'
    plain = '<row><c t="inlineStr"><is><t>bad</t></is></c></row><row><c t="inlineStr"><is><t> </t></is></c></row><row><c t="str"><v>worse</v></c></row>'
    (tmp_path / "a.xlsx").write_bytes(workbook({"words": words, "other": plain}, shared))
    (tmp_path / "b.xlsx").write_bytes(workbook({"words": words.replace("1.5", "2.5")}, shared))
    rows = workbooks.workbook_rows(spark, f"file://{tmp_path}/*.xlsx").collect()
    assert sorted((r.file[-6:], r.sheet, r.row, r.cells) for r in rows if r.file.endswith("a.xlsx")) == [("a.xlsx", "other", 1, ["bad"]), ("a.xlsx", "other", 2, [" "]), ("a.xlsx", "other", 3, ["worse"]), ("a.xlsx", "words", 1, ["word", None, "n"]), ("a.xlsx", "words", 2, ["good", None, "1.5"]), ("a.xlsx", "words", 4, ["fine", "true"])]
    table = workbooks.workbook_table(spark, f"file://{tmp_path}", ["n", "word", "none"], "words").collect()
    assert sorted((r.file[-6:], r.row, r.word, r.n, r.none) for r in table) == [("a.xlsx", 2, "good", "1.5", None), ("a.xlsx", 4, "fine", None, None), ("b.xlsx", 2, "good", "2.5", None), ("b.xlsx", 4, "fine", None, None)]
    lexicon = workbooks.workbook_words(spark, {"positive": (f"file://{tmp_path}/b.xlsx", "words", True), "negative": (f"file://{tmp_path}/a.xlsx", "other", False)})
    assert sorted(map(tuple, lexicon.collect())) == [("bad", "negative"), ("fine", "positive"), ("good", "positive"), ("worse", "negative")]
    whole = (tmp_path / "a.xlsx").read_bytes()
    (tmp_path / "c.xlsx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "d.xlsx").write_bytes(workbook({"words": words}))  # its shared strings are missing
    errors = {r.file[-6:]: r.error for r in workbooks.workbook_rows(spark, f"file://{tmp_path}").where("error is not null").collect()}
    assert set(errors) == {"c.xlsx", "d.xlsx"} and "BadZipFile" in errors["c.xlsx"] and "IndexError" in errors["d.xlsx"]
    with pytest.raises(Exception, match="BadZipFile|IndexError"):
        workbooks.workbook_table(spark, f"file://{tmp_path}", ["word"], "words").collect()
