"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import duplicates, events, lexicon, order, scoring, segmentation, similarity
from tidemark.sources.tables import table

from .catalog import register

LEX = scoring.Lexicon(
    positive=("that", "with", "una"), negative=("this", "from", "nicht"), dovish=("the ", "tion"), hawkish=("and ", "que"),
    negations=("not", "un ", "nicht"), turning=("was", "pour"), degree={"is": 1.3, "and": 1.2, "les": 1.1},
    topics={"growth": ("tion", "ing"), "inflation": ("heit", "ung"), "risk": ("eau", "ment")},
)
TRIGGERS, IRRELEVANT = ["the", "der", "les"], ["@", "http"]

S_SPACE = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{3000}}]+', ' ', 'g'))"
S_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?;]) *', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 4)".format(S_SPACE.format("{0}"))
S_WORDS = r"list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 and not regexp_full_match(w, '\p{{N}}+'))"


def sent_sql(c: str) -> str:
    return S_SENT.replace("{0}", c).replace("{{", "{").replace("}}", "}")


def words_sql(c: str) -> str:
    return S_WORDS.format(c)


def weight_sql(prefix: str) -> str:
    out = "1.0::DOUBLE"
    for w, f in LEX.degree.items():
        out += f" * (CASE WHEN contains({prefix}, '{w}') THEN {f}::DOUBLE ELSE 1.0::DOUBLE END)"
    for ws, f in ((LEX.negations, -1.0), (LEX.turning, 1.15)):
        out += " * (CASE WHEN " + " OR ".join(f"contains({prefix}, '{w}')" for w in ws) + f" THEN {f}::DOUBLE ELSE 1.0::DOUBLE END)"
    return out


def phrase_sql(s: str, words) -> str:
    return " + ".join(f"coalesce(list_sum(list_transform(range(1, len(string_split({s}, '{w}'))), lambda j: {weight_sql(f'''right(array_to_string(list_slice(string_split({s}, '{w}'), 1, j), '{w}'), 8)''')})), 0)" for w in words)


def token_sql(t: str, words) -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"coalesce(list_sum(list_transform(list_filter(range(1, len({t}) + 1), lambda i: {t}[i] IN ({inside})), lambda i: {weight_sql(f'''array_to_string(list_slice({t}, greatest(i - 3, 1), i - 1), '')''')})), 0)"


def topic_sql(s: str, words) -> str:
    return " + ".join(f"(length({s}) - length(replace({s}, '{w}', ''))) // {len(w)}" for w in words)


DOCS = "documents"
IDX_SQL = "d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)"


def _indexed(spark, d):
    return order.with_index(table(spark, d, DOCS).select("doc_id", "text"), ["doc_id"])


def _novelty(spark, d):
    docs = _indexed(spark, d)
    sim = similarity.expanding_similarity(docs, T.words(F.col("text")))
    return docs.join(sim, "idx").select("doc_id", F.round(1 - F.col("similarity"), 6).alias("novelty"))


register("expanding_novelty", _novelty, f"""
WITH {IDX_SQL}, t AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest({words_sql('text')}) AS term FROM d) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY idx) AS n FROM t),
u AS (SELECT idx, term, tf AS own, 0 AS prev, n FROM r UNION ALL SELECT idx + 1, term, 0, tf, n FROM r),
g AS (SELECT idx, term, sum(own) * (ln((2.0::DOUBLE + idx) / (1.0::DOUBLE + max(n))) + 1) AS a, sum(prev) * (ln((2.0::DOUBLE + idx) / (1.0::DOUBLE + max(n))) + 1) AS b FROM u GROUP BY 1, 2),
s AS (SELECT idx, sum(a * b) AS dot, sum(a * a) AS aa, sum(b * b) AS bb FROM g GROUP BY 1)
SELECT doc_id, round(1 - CASE WHEN d.idx > 0 AND aa > 0 AND bb > 0 THEN dot / (sqrt(aa) * sqrt(bb)) END, 6) AS novelty FROM d LEFT JOIN s USING (idx)""")


def _full_word(spark, d):
    docs = _indexed(spark, d)
    return docs.join(similarity.adjacent_similarity(docs, T.words(F.col("text"))), "idx").select("doc_id", F.round("similarity", 6).alias("similarity"))


def _adjacent_sql(terms: str, base: str, key: str) -> str:
    return f"""WITH {base}, t AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest({terms}) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), w AS (SELECT idx, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1.0::DOUBLE + df)) + 1) AS w FROM t JOIN f USING (term)),
u AS (SELECT idx, term, w AS a, 0.0::DOUBLE AS b FROM w UNION ALL SELECT idx + 1, term, 0.0::DOUBLE, w FROM w), g AS (SELECT idx, term, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2),
s AS (SELECT idx, sum(a * b) AS dot, sum(a * a) AS aa, sum(b * b) AS bb FROM g GROUP BY 1)
SELECT {key}, round(CASE WHEN d.idx > 0 THEN CASE WHEN aa > 0 AND bb > 0 THEN dot / (sqrt(aa) * sqrt(bb)) ELSE 0.0 END END, 6) AS similarity FROM d LEFT JOIN s USING (idx)"""


register("fullsample_similarity_word", _full_word, _adjacent_sql(words_sql("text"), IDX_SQL, "doc_id"))


def _full_char(spark, d):
    items = order.with_index(table(spark, d, "benchmark"), ["item_id"])
    t = F.lower(F.regexp_replace("text", r"(?U)\s\s+", " "))
    grams = F.concat(*[T.char_grams(t, n, distinct=False) for n in (2, 3, 4)])
    return items.join(similarity.adjacent_similarity(items, grams), "idx").select("item_id", F.round("similarity", 6).alias("similarity"))


_low = r"lower(regexp_replace(text, '\s\s+', ' ', 'g'))"
register("fullsample_similarity_char", _full_char, _adjacent_sql("list_concat(list_concat(" + ", ".join(f"list_transform(range(1, length({_low}) - {n} + 2), lambda i: substr({_low}, i, {n}))" for n in (2, 3)) + f"), list_transform(range(1, length({_low}) - 2), lambda i: substr({_low}, i, 4)))", "d AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)", "item_id"))

register("sentence_split", lambda s, d: table(s, d, DOCS).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", F.col("p").cast("long").alias("sentence_no"), "sentence", F.length("sentence").cast("long").alias("n_chars")),
    f"SELECT doc_id, no - 1 AS sentence_no, sents[no] AS sentence, length(sents[no]) AS n_chars FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS no FROM (SELECT doc_id, {sent_sql('text')} AS sents FROM documents))")
register("token_counts", lambda s, d: table(s, d, DOCS).select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct")),
    f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
register("tokenized_text", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.words(F.col("text")), " ").alias("tokens")), f"SELECT item_id, array_to_string({words_sql('text')}, ' ') AS tokens FROM benchmark")
register("readability", lambda s, d: table(s, d, DOCS).select("doc_id", F.round(T.readability(F.col("text")), 6).alias("readability")),
    "SELECT doc_id, round(length(text)::DOUBLE / nullif(len(regexp_extract_all(text, '[.!?;]')), 0), 6) AS readability FROM documents")
register("normalize_text", lambda s, d: table(s, d, DOCS).select("doc_id", F.md5(F.encode(T.normalize(F.col("text")), "UTF-8")).alias("digest")),
    rf"SELECT doc_id, md5(trim(regexp_replace({S_SPACE.format('text')}, '([.!?;]) *', '\1' || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents")
register("sentence_bare", lambda s, d: table(s, d, "benchmark").select("item_id", T.bare(F.col("text")).alias("bare")), r"SELECT item_id, regexp_replace(text, '[\s[:punct:]]+', '', 'g') AS bare FROM benchmark")
register("text_preview", lambda s, d: table(s, d, DOCS).select("doc_id", F.substring("text", 1, 500).alias("preview")), "SELECT doc_id, substr(text, 1, 500) AS preview FROM documents")


def _scored(spark, d):
    return scoring.text_scores(table(spark, d, DOCS), LEX)


_tokens = words_sql("s")
SCORES_SQL = f"""p AS (SELECT doc_id, s, {_tokens} AS w FROM (SELECT doc_id, unnest({sent_sql('text')}) AS s FROM documents)),
q AS (SELECT doc_id, sum({token_sql('w', LEX.positive)}) AS pos, sum({token_sql('w', LEX.negative)}) AS neg, sum({phrase_sql('s', LEX.dovish)}) AS dov, sum({phrase_sql('s', LEX.hawkish)}) AS haw, {', '.join(f'sum({topic_sql("s", w)}) AS t_{t}' for t, w in LEX.topics.items())} FROM p GROUP BY 1),
sc AS (SELECT doc_id, (coalesce(pos, 0) - coalesce(neg, 0)) * (1000.0::DOUBLE / greatest(length(text), 1)) AS sentiment, (coalesce(dov, 0) - coalesce(haw, 0)) * (1000.0::DOUBLE / greatest(length(text), 1)) AS stance, {', '.join(f'coalesce(t_{t}, 0) * (1000.0::DOUBLE / greatest(length(text), 1)) AS attention_{t}' for t in LEX.topics)} FROM documents LEFT JOIN q USING (doc_id))"""
_names = ["sentiment", "stance", *[f"attention_{t}" for t in LEX.topics]]
register("score_text", lambda s, d: _scored(s, d).select("doc_id", *[F.round(c, 5).alias(c) for c in _names]), f"WITH {SCORES_SQL} SELECT doc_id, {', '.join(f'round({c}, 5) AS {c}' for c in _names)} FROM sc")
register("phrase_score", lambda s, d: table(s, d, "benchmark").select("item_id", F.round(scoring.phrase_score(F.col("text"), LEX.dovish, LEX), 6).alias("dovish"), F.round(scoring.phrase_score(F.col("text"), LEX.hawkish, LEX), 6).alias("hawkish")),
    f"SELECT item_id, round(({phrase_sql('text', LEX.dovish)})::DOUBLE, 6) AS dovish, round(({phrase_sql('text', LEX.hawkish)})::DOUBLE, 6) AS hawkish FROM benchmark")
register("token_score", lambda s, d: table(s, d, "benchmark").select("item_id", T.words(F.col("text")).alias("w")).select("item_id", F.round(scoring.token_score(F.col("w"), LEX.positive, LEX), 6).alias("positive")),
    f"SELECT item_id, round(({token_sql('w', LEX.positive)})::DOUBLE, 6) AS positive FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark)")
register("topic_argmax", lambda s, d: _scored(s, d).select("doc_id", T.first_best({t: F.col(f"attention_{t}") for t in LEX.topics}).alias("topic")),
    f"WITH {SCORES_SQL} SELECT doc_id, CASE WHEN greatest({', '.join(f'attention_{t}' for t in LEX.topics)}) <= 0 THEN 'other' " + " ".join(f"WHEN attention_{t} = greatest({', '.join(f'attention_{x}' for x in LEX.topics)}) THEN '{t}'" for t in LEX.topics) + " END AS topic FROM sc")
_sign = "CASE WHEN {0} IS NULL OR {0} = 0 THEN 'neutral' WHEN {0} > 0 THEN '{1}' ELSE '{2}' END"
register("sign_labels", lambda s, d: _scored(s, d).select("doc_id", T.sign_label(F.round("sentiment", 9), "positive", "negative").alias("sentiment"), T.sign_label(F.round("stance", 9), "dovish", "hawkish").alias("stance")),
    f"WITH {SCORES_SQL} SELECT doc_id, {_sign.format('round(sentiment, 9)', 'positive', 'negative')} AS sentiment, {_sign.format('round(stance, 9)', 'dovish', 'hawkish')} AS stance FROM sc")


def _gate(spark, d):
    rows = table(spark, d, DOCS).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "s"))
    label = T.sign_label(F.round(scoring.phrase_score(F.col("s"), ("tion",), LEX) - scoring.phrase_score(F.col("s"), ("que",), LEX), 9), "dovish", "hawkish")
    return rows.withColumn("label", label).groupBy(scoring.gated(F.col("label"), F.col("s"), TRIGGERS, IRRELEVANT).alias("label")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_has = lambda ks: "(" + " OR ".join(f"contains(s, '{k}')" for k in ks) + ")"
register("context_gate", _gate, f"""WITH p AS (SELECT doc_id, unnest({sent_sql('text')}) AS s FROM documents), l AS (SELECT doc_id, s, {_sign.format(f"round(({phrase_sql('s', ('tion',))} - ({phrase_sql('s', ('que',))}))::DOUBLE, 9)", 'dovish', 'hawkish')} AS label FROM p)
SELECT CASE WHEN label = 'neutral' AND (NOT {_has(TRIGGERS)} OR {_has(IRRELEVANT)}) THEN 'irrelevant' ELSE label END AS label, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM l GROUP BY 1""")


def _state_gate(spark, d):
    """Section first, then market words; a score of at least 6 of state words decides a sentence's sentiment."""
    rows = table(spark, d, DOCS).select("doc_id", "source", F.explode(T.sentences(F.col("text"))).alias("s"))
    up, down = T.occurrences(F.col("s"), "th"), T.occurrences(F.col("s"), "en")
    stance = F.when(F.col("source").isin("src1", "src2"), "irrelevant").when(T.contains_any(F.col("s"), ["market", "heit"]), "irrelevant").otherwise("kept")
    mood = F.when(up - down >= 6, "positive").when(down - up >= 6, "negative").otherwise("neutral")
    return rows.groupBy(stance.alias("stance"), mood.alias("mood")).agg(F.count("*").alias("n"))


register("state_gate", _state_gate, f"""WITH p AS (SELECT source, unnest({sent_sql('text')}) AS s FROM documents), q AS (SELECT *, {topic_sql('s', ['th'])} AS up, {topic_sql('s', ['en'])} AS down FROM p)
SELECT CASE WHEN source IN ('src1', 'src2') THEN 'irrelevant' WHEN contains(s, 'market') OR contains(s, 'heit') THEN 'irrelevant' ELSE 'kept' END AS stance, CASE WHEN up - down >= 6 THEN 'positive' WHEN down - up >= 6 THEN 'negative' ELSE 'neutral' END AS mood, count(*) AS n FROM q GROUP BY 1, 2""")
register("policy_relevant", lambda s, d: _scored(s, d).where(F.round("stance", 9) != 0).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")), f"WITH {SCORES_SQL} SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM sc WHERE round(stance, 9) <> 0")


def _formal_z(spark, d):
    rows = table(spark, d, DOCS).select("doc_id", "source", F.col("n_chars").cast("double").alias("v"))
    return events.formal_zscore(rows, "v", F.col("doc_id") % 5 != 0, ["source"], "z").select("doc_id", F.round("z", 6).alias("z"))


register("zscore_formal_only", _formal_z, "WITH s AS (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS sd FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1) SELECT doc_id, round((n_chars - m) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS z FROM documents LEFT JOIN s USING (source)")
register("zscore_by_section", lambda s, d: events.formal_zscore(table(s, d, DOCS).select("doc_id", "lang", F.col("n_chars").cast("double").alias("v")), "v", F.lit(True), ["lang"], "z").select("doc_id", F.round("z", 6).alias("z")), "SELECT doc_id, round((n_chars - avg(n_chars) OVER (PARTITION BY lang)) / stddev_pop(n_chars) OVER (PARTITION BY lang), 6) AS z FROM documents")


def _pivot(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    firsts = rows.groupBy("conv_id", "role").agg(F.min_by("n", F.struct("turn", "n")).alias("n"))
    return firsts.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.first("n", ignorenulls=True)).select("conv_id", F.col("user").alias("user_chars"), F.col("assistant").alias("assistant_chars"))


register("section_pivot_first", _pivot, """WITH r AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, length(text)) AS k FROM conversations)
SELECT conv_id, max(CASE WHEN role = 'user' AND k = 1 THEN n END) AS user_chars, max(CASE WHEN role = 'assistant' AND k = 1 THEN n END) AS assistant_chars FROM r GROUP BY 1""")
register("last_match_section", lambda s, d: table(s, d, DOCS).select("doc_id", T.last_section(F.col("text"), "And ", r"\.\n", 20).alias("section")).where("section is not null"), r"""WITH a AS (SELECT doc_id, string_split(text, 'And ') AS p FROM documents), b AS (SELECT doc_id, 'And ' || p[len(p)] AS body FROM a WHERE len(p) > 1),
c AS (SELECT doc_id, CASE WHEN strpos(body, '.' || chr(10)) > 1 THEN substr(body, 1, strpos(body, '.' || chr(10)) - 1) ELSE body END AS section FROM b) SELECT doc_id, section FROM c WHERE length(section) >= 20""")


def _change(spark, d):
    rows = _scored(spark, d).join(table(spark, d, DOCS).select("doc_id", "source"), "doc_id")
    return events.first_difference(rows, "attention_growth", "doc_id", "change", ["source"]).select("doc_id", F.round("change", 5).alias("change"))


register("attention_change", _change, f"WITH {SCORES_SQL} SELECT doc_id, round(attention_growth - lag(attention_growth) OVER (PARTITION BY source ORDER BY doc_id), 5) AS change FROM sc JOIN (SELECT doc_id, source FROM documents) USING (doc_id)")

_g3 = lambda c: f"list_distinct(CASE WHEN length({c}) = 0 THEN []::VARCHAR[] WHEN length({c}) <= 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)) END)"


def _jaccard(spark, d):
    b = table(spark, d, "benchmark").select("item_id", T.char_grams(F.col("text")).alias("g"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return b.join(n, "item_id").select("item_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


register("ngram_jaccard", _jaccard, f"WITH g AS (SELECT item_id, {_g3('text')} AS g FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.g, b.g))::DOUBLE / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 6) AS jaccard FROM g a JOIN g b ON b.item_id = a.item_id + 1")


def _turns(spark, d):
    """Every turn of the conversations as a text; the conversation is its report."""
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("report"), F.col("text").alias("s")).where("s is not null")


_bare = r"regexp_replace(lower(s), '[\s[:punct:]]+', '', 'g')"
_NEAR = f"""r AS (SELECT id, report, {_bare} AS t FROM (SELECT conv_id * 1000 + turn AS id, conv_id AS report, text AS s FROM conversations) WHERE s IS NOT NULL AND length({_bare}) > 0),
c AS (SELECT t, min(id) AS id, {_g3('t')} AS g FROM r GROUP BY t),
e AS (SELECT c.id AS a, r.id AS b FROM r JOIN c USING (t) WHERE c.id < r.id UNION
SELECT least(x.id, y.id), greatest(x.id, y.id) FROM c x JOIN c y ON length(x.t) < length(y.t) AND length(x.t) >= 20 AND contains(y.t, x.t) UNION
SELECT x.id, y.id FROM c x JOIN c y ON x.id < y.id AND 100 * least(len(x.g), len(y.g)) >= 92 * greatest(len(x.g), len(y.g)) WHERE 100 * len(list_intersect(x.g, y.g)) >= 92 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))))"""
register("near_duplicates", lambda s, d: duplicates.near_pairs(_turns(s, d), "id", "s"), f"WITH {_NEAR} SELECT a, b FROM e")
register("duplicate_groups", lambda s, d: duplicates.duplicate_groups(_turns(s, d), "id", "s", "report").select("id", "root", "group_label"), f"""WITH RECURSIVE {_NEAR}, n AS (SELECT conv_id * 1000 + turn AS id, conv_id AS report FROM conversations WHERE text IS NOT NULL), e2 AS (SELECT a, b FROM e UNION SELECT min(id) OVER (PARTITION BY report), id FROM n), b AS (SELECT a, b FROM e2 UNION SELECT b, a FROM e2),
p AS (SELECT id, id AS root FROM n UNION SELECT b.b AS id, p.root FROM p JOIN b ON b.a = p.id), m AS (SELECT id, min(root) AS root FROM p GROUP BY 1), q AS (SELECT conv_id * 1000 + turn AS root, conv_id, regexp_replace(lower(text), '[\\s[:punct:]]+', '', 'g') AS t FROM conversations) SELECT id, root, 'grp_' || substr(sha1(root::VARCHAR || ':' || conv_id::VARCHAR || ':' || substr(t, 1, 80)), 1, 12) AS group_label FROM m JOIN q USING (root)""")


SENTENCES_A_TEXT = 1 << 24  # a sentence's id is doc_id * SENTENCES_A_TEXT + sentence_no; too large a product is an error


def _all_sentences(spark, d):
    """Every sentence of the whole texts, (id, doc_id, s); ids ascend with (doc_id, sentence_no)."""
    rows = table(spark, d, DOCS).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "s"))
    fits = F.when(F.col("no") < SENTENCES_A_TEXT, F.col("no").cast("long")).otherwise(F.raise_error(F.lit("a text of too many sentences")).cast("long"))
    return rows.select((F.col("doc_id") * F.lit(SENTENCES_A_TEXT).cast("long") + fits).alias("id"), "doc_id", "s")


def _place(col: str, name: str = "") -> list:
    return [F.shiftright(col, 24).alias(f"{name}doc_id"), F.col(col).bitwiseAND(F.lit(SENTENCES_A_TEXT - 1).cast("long")).alias(f"{name}sentence_no")]


def _near_sentences(spark, d):
    return duplicates.near_pairs(_all_sentences(spark, d), "id", "s").select(*_place("a", "a_"), *_place("b", "b_"))


def _report_groups(spark, d):
    """A document is a report: its sentences share a group, and so do the documents of near-duplicate sentences."""
    return duplicates.duplicate_groups(_all_sentences(spark, d), "id", "s", "doc_id").select(*_place("id"), *_place("root", "root_"), "group_label")


# all sentences; their pairwise SQL is too slow, tests compare them with brute force
register("near_duplicate_sentences", _near_sentences)
register("duplicate_report_groups", _report_groups)


def _char_documents(spark, d):
    docs = _indexed(spark, d)
    t = F.lower(F.regexp_replace("text", r"(?U)\s\s+", " "))
    return docs.join(similarity.adjacent_similarity(docs, t, (2, 3, 4)), "idx").select("doc_id", F.round("similarity", 6).alias("similarity"))


def _jaccard_documents(spark, d):
    """Each document against the next one by doc_id."""
    docs = _indexed(spark, d)
    return docs.join(similarity.adjacent_jaccard(docs, F.col("text")), "idx").select("doc_id", F.round("jaccard", 6).alias("jaccard"))


# the queries on benchmark again, on whole documents and without SQL
register("fullsample_similarity_char_documents", _char_documents)
register("ngram_jaccard_documents", _jaccard_documents)
register("phrase_score_documents", lambda s, d: table(s, d, DOCS).select("doc_id", F.round(scoring.phrase_score(F.col("text"), LEX.dovish, LEX), 6).alias("dovish"), F.round(scoring.phrase_score(F.col("text"), LEX.hawkish, LEX), 6).alias("hawkish")))
register("token_score_documents", lambda s, d: table(s, d, DOCS).select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.round(scoring.token_score(F.col("w"), LEX.positive, LEX), 6).alias("positive")))
register("tokenized_text_documents", lambda s, d: table(s, d, DOCS).select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("tokens")))
register("sentence_bare_documents", lambda s, d: table(s, d, DOCS).select("doc_id", T.bare(F.col("text")).alias("bare")))



def _large_lexicon(spark, d):
    """Whole documents by a lexicon of their 3,000 most frequent words of four or more characters, dealt to six lists by their hash; LEX's modifiers."""
    docs = table(spark, d, DOCS).select("doc_id", "text")
    top = lexicon.word_counts(docs, "text", 4).orderBy(F.col("n").desc(), "word").limit(3000)
    kinds = F.array(*map(F.lit, ["positive", "negative", "dovish", "hawkish", "growth", "risk"]))
    dealt = top.select("word", F.get(kinds, F.pmod(F.xxhash64("word"), F.lit(6)).cast("int")).alias("category"), F.lit(None).cast("double").alias("factor"))
    mods = spark.createDataFrame([r for r in scoring.lexicon_of(LEX) if r[1] in lexicon.MODIFIERS], "word string, category string, factor double")
    found = lexicon.lexicon_scores(docs, dealt.unionByName(mods))
    return found.select("doc_id", *[F.round(c, 5).alias(c) for c in ("sentiment", "stance", "attention_growth", "attention_risk")])


register("large_lexicon_scores", _large_lexicon)

PROTECTED = ["tion", "ment", "les"]
register("segmented_tokens", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.segment(F.col("text"), PROTECTED, ["the", "and"]), " ").alias("tokens")))


def _segmented_documents(spark, d):
    """Whole documents by the 5,000 most frequent words of all of them; compounds and unknown words come apart."""
    docs = table(spark, d, DOCS).select("doc_id", "text")
    known = lexicon.word_counts(docs).orderBy(F.col("n").desc(), "word").limit(5000)
    found = segmentation.segment_words(docs, "text", known, PROTECTED, ["the", "and"])
    return found.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.crc32(F.array_join("tokens", " ").cast("binary")).alias("tokens_crc32"))


register("segmented_documents", _segmented_documents)
