"""Large lexicons: the one-pass scorer against sums of column expressions and a plain count."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import lexicon, scoring
from tidemark.operators.scoring import Lexicon

LEX = Lexicon(
    positive=("aa", "ab", "bé"), negative=("ba", "aa"), dovish=("a", "ab", "aba", "b a", "\U0001f600"), hawkish=("ba", "aa", "é"), negations=("b", "éa"), turning=("ab", " a"),
    degree={"a": 1.5, "ba": 0.5, "bb": 2.0, "\U0001f600a": 3.0}, topics={"one": ("a", "ab", "aa"), "two": ("b b", "é")},
)


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", "é", " ", "a", "b", ".", "\U0001f600", "\n", "　"]) for _ in range(r.randrange(0, 90))) for _ in range(n)]


def by_columns(spark, rows, lex):
    """Scores from the column expressions of one sentence, a row a sentence."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.explode_outer(T.sentences(F.col("text"))))
    scored = scoring.sentence_scores(df.withColumn("s", F.coalesce("s", F.lit(""))), "s", lex)
    sums = scored.groupBy("doc_id", "text").agg(*[F.sum(c).cast("double").alias(c) for c in ("pos", "neg", "dovish", "hawkish", *[f"topic_{t}" for t in lex.topics])])
    out = {}
    for r in sums.collect():
        per = 1000.0 / max(1, len(r.text)) if r.text is not None else None
        raw = [r.pos - r.neg, r.dovish - r.hawkish, *[r[f"topic_{t}"] for t in lex.topics]]
        out[r.doc_id] = None if per is None else [x * per for x in raw]
    return out


def test_one_pass_equals_the_column_expressions(spark):
    rows = [(k, t) for k, t in enumerate([*texts(150, 5), "", "   ", ". . .", None, "a" * 900, "ab a. " * 300])]
    want = by_columns(spark, rows, LEX)
    got = {r.doc_id: r for r in scoring.text_scores(spark.createDataFrame(rows, "doc_id long, text string"), LEX).collect()}
    assert len(got) == len(want) == len(rows)
    for k, w in want.items():
        have = list(got[k][1:])
        assert have == [None] * 4 if w is None else have == pytest.approx(w, rel=1e-9, abs=1e-9), (rows[k][1][:90], have, w)


def test_thousands_of_words_against_a_plain_count(spark):
    r = random.Random(8)
    words = sorted({"".join(r.choices("abcd ", k=r.randrange(2, 7))).strip() for _ in range(9000)} - {""})[:3000]
    kinds = {w: r.choice(["dovish", "hawkish", "topic x"]) for w in words}
    mods = [("no", "negation", None), ("da", "degree", 1.5), ("cab", "degree", 2.0), ("dd", "turning", None)]
    table = spark.createDataFrame([*[(w, c, None) for w, c in kinds.items()], *mods, ("", "dovish", None), (None, "dovish", None), (words[0], kinds[words[0]], None)], "word string, category string, factor double")
    rows = [(k, "".join(r.choices(["a", "b", "c", "d", " ", "no", "."], k=60))) for k in range(25)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows * 2], "doc_id long, text string, sums string")
    got = lexicon.lexicon_scores(docs, table).collect()
    assert len(got) == 50

    def weight(p):
        return (1.5 if "da" in p else 1.0) * (2.0 if "cab" in p else 1.0) * (-1.0 if "no" in p else 1.0) * (1.15 if "dd" in p else 1.0)

    for row in got:
        text = rows[row.doc_id][1]
        low, topic = 0.0, 0
        for s in [s.strip() for s in " ".join(text.split()).replace(".", ".\n").split("\n")]:
            if len(s) < 4:
                continue
            for w, c in kinds.items():
                at = s.find(w)
                while at >= 0:
                    if c == "topic x":
                        topic += 1
                    else:
                        low += weight(s[max(0, at - 8) : at]) * (1 if c == "dovish" else -1)
                    at = s.find(w, at + len(w))
        assert row.stance == pytest.approx(low * 1000 / len(text)) and row.sentiment == 0 and row["attention_topic x"] == pytest.approx(topic * 1000 / len(text))


def test_odd_lexicons(spark):
    docs = spark.createDataFrame([(None, "some text. here"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "word string, category string")
    assert sorted(map(tuple, lexicon.lexicon_scores(docs, none).collect()), key=str) == [(1, None, None), (None, 0.0, 0.0)]
    assert lexicon.lexicon_scores(docs.limit(0), none).count() == 0
    assert scoring.text_scores(docs, Lexicon(topics={"t": ()})).where("attention_t = 0").count() == 1
    for bad in ([("a", "degree", None)], [("a", "degree", 1.0), ("a", "degree", 2.0)]):
        with pytest.raises(ValueError):
            lexicon.lexicon_scores(docs, spark.createDataFrame(bad, "word string, category string, factor double"))


ODD = ["a", "b", "É", " ", "A", ".", "!", ";", "\U0001f600", "\n", "　", "\x1c", "\x85", "İ", "Σ", "ς", "1", "٣", "一", "_", "́", "\xa0", "\t"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randrange(0, 70))) for _ in range(n)] + [None, "", "...", " \n", "ab cd. " * 40]


def test_counting_and_scoring_take_no_array_function_a_word(spark):
    """Counting and scoring were regular expressions and lambdas on the words of each sentence, and a few Python calls a hit."""
    docs = spark.createDataFrame([(1, "one text")], "doc_id long, text string")
    for df in (lexicon.word_counts(docs), lexicon.category_sums(docs, [("one", "positive", None)], "doc_id", "text")[0]):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()

    def calls(n):
        scorer, seen = lexicon.Scorer([("aa", "dovish", None), ("bb", "positive", None), ("no", "negation", None)]), []
        lexicon._kinds()
        sys.setprofile(lambda _, event, __: seen.append(event) if event == "call" else None)
        try:
            scorer.sums(["no aa bb " * n])
        finally:
            sys.setprofile(None)
        return len(seen)

    assert calls(5000) < 3 * calls(50)


def test_word_counts_are_those_of_words(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts(300, 3)], "text string")
    for least in (2, 4):
        want = df.select(F.explode(T.words(F.col("text"), least)).alias("word")).groupBy("word").count()
        assert sorted(map(tuple, lexicon.word_counts(df, "text", least).collect())) == sorted(map(tuple, want.collect()))


def test_lines_are_sentences(spark):
    texts = [t or "" for t in odd_texts(400, 4)]
    for terminators in (".!?;", ". ;", "-]^a"):
        want = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_join(T.sentences(F.col("t"), terminators), "\n").alias("s"))
        assert [lexicon.sentence_lines(t, terminators) for t in texts] == [r.s for r in want.collect()]


@pytest.mark.parametrize("chunk, pairs", [(30, 3), (1 << 20, 1 << 21)])
def test_texts_together_and_in_parts(spark, monkeypatch, chunk, pairs):
    monkeypatch.setattr(lexicon, "CHUNK", chunk)
    monkeypatch.setattr(lexicon, "PAIRS", pairs)
    rows = list(enumerate([*texts(120, 9), *odd_texts(120, 6), "", None, "a" * 300, "ab a. " * 200]))
    want = by_columns(spark, rows, LEX)
    scorer = lexicon.Scorer(scoring.lexicon_of(LEX))
    for (k, text), have in zip(rows, scorer.sums([t for _, t in rows]), strict=True):
        if text is None:
            assert have is None
            continue
        z, per = dict(zip(scorer.names, have)), 1000 / max(1, len(text))
        assert [(z["positive"] - z["negative"]) * per, (z["dovish"] - z["hawkish"]) * per, z["one"] * per, z["two"] * per] == pytest.approx(want[k], rel=1e-9, abs=1e-9), text[:90]
