"""Queries on tables: filters, joins, aggregates, samples, sets, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import classify as C
from tidemark.operators import events as E
from tidemark.operators import metrics as M
from tidemark.operators import regression as R
from tidemark.operators import sampling as P
from tidemark.operators.quantiles import quantiles
from tidemark.operators.sessions import sessions
from tidemark.operators.search import layered_search
from tidemark.sources import sinks
from tidemark.sources.tables import daily_prices, table

from .catalog import register
from .text_queries import sent_sql


def both(name: str, sql: str, spark_sql: str | None = None, tables: str = "") -> None:
    """A query that is plain SQL in either engine; `tables` are the views it reads."""

    def run(spark, d):
        for t in tables.split():
            table(spark, d, t).createOrReplaceTempView(f"tm_{t}")
        text = spark_sql or sql
        for t in tables.split():
            text = text.replace(f"{{{t}}}", f"tm_{t}")
        return spark.sql(text)

    out = sql
    for t in tables.split():
        out = out.replace(f"{{{t}}}", t)
    register(name, run, out)


# filters and conditionals
both("set_membership", "SELECT source, count(*) AS n FROM {documents} WHERE source IN ('src1', 'src2', 'src3') GROUP BY source", tables="documents")
both("derived_columns", "SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END, 6) AS log_price, round(1 - o_totalprice / 700000, 9) AS rest, round(greatest(o_totalprice / 100000, 1), 9) AS clipped FROM {orders}", tables="orders")
both("hide_when_missing", "SELECT doc_id, CASE WHEN n_chars >= 500 THEN substring(text, 1, 40) END AS shown FROM {documents}", tables="documents")
both("label_merge", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'other' ELSE event_type END AS label, count(*) AS n FROM {events} GROUP BY 1", tables="events")
both("label_normalise", "SELECT lower(trim(o_orderpriority)) AS label, count(*) AS n FROM {orders} GROUP BY 1", tables="orders")
both("numeric_coercion", "SELECT count(*) AS n, count(try_cast(o_orderstatus AS DOUBLE)) AS good, count(try_cast(substring(o_orderpriority, 1, 1) AS INT)) AS digits FROM {orders}", tables="orders")


def _complete(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "right").select("doc_id", F.col("quality").cast("double").alias("quality"), F.when(F.col("n_chars") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("n_chars").cast("double")).alias("n"))
    return R.complete(rows, ["quality", "n"]).agg(F.count("*").alias("n_rows"), F.sum("doc_id").alias("ids"))


register("complete_cases", _complete, "SELECT count(*) AS n_rows, sum(doc_id)::BIGINT AS ids FROM documents JOIN labels USING (doc_id) WHERE n_chars % 11 <> 0 AND quality IS NOT NULL")
register("map_with_default", lambda s, d: table(s, d, "nation").join(table(s, d, "region").where("r_regionkey < 3").select("r_regionkey", F.lit(1).cast("long").alias("flag")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("flag", F.lit(0)).alias("flag")),
    "SELECT n_name, (CASE WHEN n_regionkey < 3 THEN 1 ELSE 0 END)::BIGINT AS flag FROM nation")
register("tolerant_equal", lambda s, d: table(s, d, "lineitem").select((F.abs(F.col("l_extendedprice") - F.col("l_extendedprice") * (1 + F.col("l_discount") / 10000)) <= 1e-8 + 1e-5 * F.abs(F.col("l_extendedprice") * (1 + F.col("l_discount") / 10000))).alias("same")).groupBy("same").agg(F.count("*").alias("n")),
    "SELECT abs(l_extendedprice - l_extendedprice * (1 + l_discount / 10000)) <= 1e-8 + 1e-5 * abs(l_extendedprice * (1 + l_discount / 10000)) AS same, count(*) AS n FROM lineitem GROUP BY 1")
register("sentence_length_filter", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).where(F.length("s").between(12, 180)).groupBy("doc_id").agg(F.count("*").alias("n")),
    f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({sent_sql('text')}) AS s FROM documents) WHERE length(s) BETWEEN 12 AND 180 GROUP BY 1")

# joins
register("left_join_two_keys", lambda s, d: table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("r")), ["l_partkey", "l_suppkey"], "left").agg(F.count("*").alias("pairs"), F.count("r").alias("hits"), F.round(F.sum("r"), 2).alias("total")),
    "WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT count(*) AS pairs, count(r) AS hits, round(sum(r), 2) AS total FROM a LEFT JOIN b USING (l_partkey, l_suppkey)")
register("inner_join_counts", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
register("label_lookup", lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label")), "doc_id", "left").select("doc_id", F.coalesce("label", F.lit("")).alias("label")),
    "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality IS NOT NULL THEN 'bad' END, '') AS label FROM documents LEFT JOIN labels USING (doc_id)")
register("fold_semi_join", lambda s, d: table(s, d, "documents").select(F.pmod("doc_id", F.lit(5)).alias("fold"), "doc_id").join(table(s, d, "labels").where("toxic = 1").select(F.pmod("doc_id", F.lit(5)).alias("fold"), "doc_id"), ["fold", "doc_id"], "left_semi").groupBy("fold").agg(F.count("*").alias("n")),
    "SELECT doc_id % 5 AS fold, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
register("hash_table_diff", lambda s, d: sinks.hash_table_diff(table(s, d, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash")), table(s, d, "benchmark").where("item_id % 5 <> 0").select(F.col("item_id").cast("string").alias("path"), F.sha2(F.when(F.col("item_id") % 7 == 0, "changed").otherwise(F.col("text")), 256).alias("hash"))),
    "WITH a AS (SELECT item_id::VARCHAR AS path, sha256(text) AS a_hash FROM benchmark WHERE item_id % 3 <> 0), b AS (SELECT item_id::VARCHAR AS path, sha256(CASE WHEN item_id % 7 = 0 THEN 'changed' ELSE text END) AS b_hash FROM benchmark WHERE item_id % 5 <> 0) SELECT path, a_hash, b_hash, coalesce(a_hash = b_hash, false) AS match FROM a FULL JOIN b USING (path)")

# aggregates
both("mean_by_group", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus", tables="lineitem")
both("value_counts", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type", tables="events")
both("multi_aggregate", "SELECT lang, source, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, count(*) AS n FROM {documents} GROUP BY lang, source", tables="documents")
both("distinct_dates", "SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, count(DISTINCT o_custkey) AS n_customers FROM {orders}", tables="orders")
register("median_by_group", lambda s, d: quantiles(table(s, d, "documents"), ["lang"], "n_chars", [0.5]).select("lang", F.round(F.col("q")[0], 6).alias("median")), "SELECT lang, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS median FROM documents GROUP BY 1")
register("pivot_counts", lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0), "SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS \"F\", count_if(o_orderstatus = 'O')::BIGINT AS \"O\", count_if(o_orderstatus = 'P')::BIGINT AS \"P\" FROM orders GROUP BY 1")
register("describe_panel", lambda s, d: M.describe(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("variable", "count", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]),
    " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, round(quantile_cont({c}, 0.25), 5) AS p25, round(quantile_cont({c}, 0.5), 5) AS p50, round(quantile_cont({c}, 0.75), 5) AS p75, round(max({c}), 5) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
both("row_mean", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS mean FROM {lineitem}", tables="lineitem")

RULE_SQL = "CASE WHEN len(regexp_extract_all(text, '!!|###|[|]')) > 3 THEN 0 ELSE 1 END"


def _judged(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("quality").cast("string").alias("true"), F.when(F.regexp_count("text", F.lit("!!|###|[|]")) > 3, "0").otherwise("1").alias("pred"))


J = f"j AS (SELECT doc_id, source, quality::VARCHAR AS t, ({RULE_SQL})::VARCHAR AS p FROM documents JOIN labels USING (doc_id)), l AS (SELECT unnest(['0', '1']) AS label)"
LM = f"""{J}, m AS (SELECT label, (SELECT count(*) FROM j WHERE t = label) AS support, (SELECT count(*) FROM j WHERE p = label) AS predicted, (SELECT count(*) FROM j WHERE t = label AND p = label) AS hit FROM l),
x AS (SELECT label, support, coalesce(hit::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall FROM m), y AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM x)"""
register("confusion_matrix", lambda s, d: M.confusion(_judged(s, d), "true", "pred", ["0", "1"]), f"WITH {J} SELECT a.label AS \"true\", b.label AS pred, (SELECT count(*) FROM j WHERE t = a.label AND p = b.label) AS n FROM l a, l b")
register("label_metrics", lambda s, d: M.label_metrics(_judged(s, d), "true", "pred", ["0", "1"]).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]), f"WITH {LM} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM y")
_o = ["accuracy", *[f"{k}_{c}" for k in ("macro", "weighted") for c in ("precision", "recall", "f1")]]
register("overall_metrics", lambda s, d: M.overall_metrics(_judged(s, d), "true", "pred", ["0", "1"]).select(*[F.round(c, 6).alias(c) for c in _o]), f"WITH {LM} SELECT round((SELECT avg((t = p)::INT) FROM j), 6) AS accuracy, " + ", ".join(f"round(avg({c}), 6) AS macro_{c}, round(sum({c} * support) / sum(support), 6) AS weighted_{c}" for c in ("precision", "recall", "f1")) + " FROM y")
register("class_recall", lambda s, d: _judged(s, d).agg(F.round(F.count_if((F.col("true") == "0") & (F.col("pred") == "0")) / F.greatest(F.count_if(F.col("true") == "0"), F.lit(1)), 6).alias("recall")), f"WITH {J} SELECT round(count_if(t = '0' AND p = '0') / greatest(count_if(t = '0'), 1), 6) AS recall FROM j")
register("disagreements", lambda s, d: M.disagreements(table(s, d, "lineitem"), {"flag": ("l_returnflag", "l_linestatus"), "rate": ("l_discount", "l_tax"), "place": ("l_linenumber", "l_quantity")}).groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.count_if(f"{c}_differs").alias(f"n_{c}") for c in ("flag", "rate", "place")]), "SELECT l_returnflag, count(*) AS n, count_if(l_returnflag <> l_linestatus)::BIGINT AS n_flag, count_if(l_discount <> l_tax)::BIGINT AS n_rate, count_if(l_linenumber <> l_quantity)::BIGINT AS n_place FROM lineitem WHERE l_returnflag <> l_linestatus OR l_discount <> l_tax OR l_linenumber <> l_quantity GROUP BY 1")
register("label_union", lambda s, d: M.labels_of(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]), "SELECT DISTINCT label FROM (SELECT l_returnflag AS label FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem)")
register("majority_baseline", lambda s, d: table(s, d, "labels").groupBy("quality").count().orderBy(F.desc("count"), "quality").limit(1).select(F.col("quality").cast("long").alias("label"), F.col("count").alias("n")), "SELECT quality::BIGINT AS label, count(*) AS n FROM labels GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
register("completeness", lambda s, d: M.completeness(table(s, d, "events").withColumn("props", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props"))), ["event_type", "props", "value"]),
    " UNION ALL ".join(f"SELECT '{c}' AS column, count_if({x} IS NULL)::BIGINT AS nulls, count_if(trim({x}::VARCHAR) = '')::BIGINT AS empty, count_if({x} IS NOT NULL AND trim({x}::VARCHAR) <> '')::BIGINT AS valid FROM events" for c, x in (("event_type", "event_type"), ("props", "(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE props END)"), ("value", "value"))))
register("illegal_labels", lambda s, d: M.illegal_labels(table(s, d, "events"), "event_type", ["view", "click"]), "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click')")


def _tone(spark, d):
    from tidemark.operators.classify import report_tone

    rows = table(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(50)).alias("report"), "l_returnflag", "l_discount", "l_tax")
    out = report_tone(rows, "report", "l_returnflag", "l_discount", "l_tax", {"all": [], "relevant": ["A", "N"], "directional": ["A"]})
    return out.select("report", "n_sentences", *[c for k in ("all", "relevant", "directional") for c in (F.round(f"{k}_mean", 6).alias(f"{k}_mean"), F.col(f"n_{k}"))])


register("report_tone", _tone, "SELECT l_suppkey % 50 AS report, count(*) AS n_sentences, round(avg(l_discount) - avg(l_tax), 6) AS all_mean, count(*) AS n_all, round(avg(CASE WHEN l_returnflag IN ('A', 'N') THEN l_discount END) - avg(CASE WHEN l_returnflag IN ('A', 'N') THEN l_tax END), 6) AS relevant_mean, count_if(l_returnflag IN ('A', 'N'))::BIGINT AS n_relevant, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) - avg(CASE WHEN l_returnflag = 'A' THEN l_tax END), 6) AS directional_mean, count_if(l_returnflag = 'A')::BIGINT AS n_directional FROM lineitem GROUP BY 1")

# samples and ranks
register("even_sample", lambda s, d: P.even_sample(table(s, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], F.lit(7)), "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents), p AS (SELECT DISTINCT source, round_even(i * (n - 1) / 6.0::DOUBLE, 0)::BIGINT AS k FROM (SELECT DISTINCT source, n FROM r), range(0, 7) t(i) WHERE n > 7 UNION SELECT source, k FROM r WHERE n <= 7) SELECT doc_id, source FROM r JOIN p USING (source, k)")
register("quota_sample", lambda s, d: P.quotas(table(s, d, "documents").select("source").distinct(), ["source"], 107).select("source", F.col("quota").cast("long").alias("quota")), "WITH u AS (SELECT source, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source, (107 // n + CASE WHEN k <= 107 % n THEN 1 ELSE 0 END)::BIGINT AS quota FROM u")


def _stratified(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    q = P.quotas(docs.select("source").distinct(), ["source"], 100)
    return P.even_sample(docs.join(F.broadcast(q), "source"), ["source"], ["doc_id"], F.col("quota"), ["quota"]).select("doc_id", "source")


register("stratified_sample", _stratified, "WITH u AS (SELECT source, (100 // n + CASE WHEN k <= 100 % n THEN 1 ELSE 0 END) AS q FROM (SELECT source, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))), r AS (SELECT doc_id, source, q, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents JOIN u USING (source)), p AS (SELECT DISTINCT source, round_even(i * (n - 1) / greatest(q - 1, 1)::DOUBLE, 0)::BIGINT AS k FROM (SELECT DISTINCT source, n, q FROM r), range(0, 200) t(i) WHERE i < q AND n > q UNION SELECT source, k FROM r WHERE n <= q) SELECT doc_id, source FROM r JOIN p USING (source, k)")


def _repaired(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", "en").otherwise("other").alias("section"))
    return P.repaired_sample(docs, "section", "source", ["doc_id"], 170).select("doc_id", "section", "source")


# a unit is dealt to each stratum in turn while it has rows, so quotas are counts among a section's first units by (place, stratum)
register("repaired_sample", _repaired, "WITH r AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS section FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY section, source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY section, source) AS n FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY k, source) AS turn FROM n), q AS (SELECT section, source, n, count(*) FILTER (turn <= 170) AS q FROM d GROUP BY ALL), p AS (SELECT DISTINCT section, source, round_even(i * (n - 1) / greatest(q - 1, 1)::DOUBLE, 0)::BIGINT AS k FROM q, range(0, 200) t(i) WHERE i < q) SELECT doc_id, section, source FROM n JOIN p USING (section, source, k)")
register("top_features", lambda s, d: M.top_terms(C.with_grams(table(s, d, "benchmark"), "text"), "grams", C.FEATURES), r"WITH t AS (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark), g AS (SELECT CASE WHEN length(t) > n THEN substring(t, i::INT, n::INT) WHEN length(t) > 0 THEN t END AS term FROM t, range(2, 5) a(n), range(1, 2000) b(i) WHERE i = 1 OR i <= length(t) - n + 1) SELECT term, count(*) AS n FROM g WHERE term IS NOT NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 8000")
register("head_padding", lambda s, d: table(s, d, "documents").where("lang = 'es'").select("doc_id").unionByName(table(s, d, "documents").where("lang <> 'es'").select("doc_id").orderBy("doc_id").limit(10)), "SELECT doc_id FROM documents WHERE lang = 'es' UNION ALL (SELECT doc_id FROM documents WHERE lang <> 'es' ORDER BY doc_id LIMIT 10)")

# sets
register("lexicon_union", lambda s, d: sinks.combined_lexicon({"a": table(s, d, "part").select(F.col("p_brand").alias("word")), "b": table(s, d, "part").where("p_size > 40").select(F.col("p_type").alias("word")), "c": table(s, d, "part").where("p_size < 3").select(F.col("p_brand").alias("word"))}).groupBy("word").agg(F.count("*").alias("n_sources")),
    "SELECT word, count(DISTINCT source) AS n_sources FROM (SELECT trim(p_brand) AS word, 'a' AS source FROM part UNION ALL SELECT trim(p_type), 'b' FROM part WHERE p_size > 40 UNION ALL SELECT trim(p_brand), 'c' FROM part WHERE p_size < 3) WHERE word <> '' GROUP BY 1")


def _lex_diff(spark, d):
    old, new = (table(spark, d, "part").where(c).select(F.col("p_brand").alias("word"), F.col("p_type").alias("category")).distinct() for c in ("p_size <= 20", "p_size > 20"))
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed"))).groupBy("category", "change").agg(F.count("*").alias("n"))


register("lexicon_diff", _lex_diff, "WITH o AS (SELECT DISTINCT p_brand AS word, p_type AS category FROM part WHERE p_size <= 20), n AS (SELECT DISTINCT p_brand AS word, p_type AS category FROM part WHERE p_size > 20) SELECT category, change, count(*) AS n FROM (SELECT word, category, 'added' AS change FROM (FROM n EXCEPT FROM o) UNION ALL SELECT word, category, 'removed' FROM (FROM o EXCEPT FROM n)) GROUP BY 1, 2")
register("listing_equality", lambda s, d: table(s, d, "orders").select("o_custkey").distinct().exceptAll(table(s, d, "customer").select("c_custkey")).agg(F.count("*").alias("missing")).crossJoin(table(s, d, "customer").select("c_custkey").exceptAll(table(s, d, "orders").select("o_custkey").distinct()).agg(F.count("*").alias("unused"))), "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS missing, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS unused")

# functions and audits
register("text_hashes", lambda s, d: table(s, d, "documents").select("doc_id", T.group_label(F.col("text")).alias("sha1_12"), F.sha2("text", 256).alias("sha256")), "SELECT doc_id, substr(sha1(text), 1, 12) AS sha1_12, sha256(text) AS sha256 FROM documents")
register("number_format", lambda s, d: table(s, d, "part").select("p_partkey", T.formatted(F.when(F.col("p_size") > 5, F.col("p_retailprice")), 2).alias("price"), T.looks_numeric(F.col("p_name")).alias("numeric")), "SELECT p_partkey, coalesce(format('{:.2f}', CASE WHEN p_size > 5 THEN p_retailprice END), '—') AS price, regexp_full_match(p_name, '-?[0-9]+([.][0-9]+)?') AS numeric FROM part")
register("script_check", lambda s, d: table(s, d, "documents").select("doc_id", F.col("text").rlike("[一-龥]").alias("han"), F.col("text").rlike("[À-ÿ]").alias("accented")), "SELECT doc_id, regexp_matches(text, '[一-龥]') AS han, regexp_matches(text, '[À-ÿ]') AS accented FROM documents")
register("path_normalise", lambda s, d: table(s, d, "pages").select("page_id", F.translate(F.concat(F.lit("a\\b\\"), "url"), "\\", "/").alias("path")), "SELECT page_id, replace('a\\b\\' || url, '\\', '/') AS path FROM pages")
register("value_map", lambda s, d: sinks.value_map(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "—").otherwise(F.col("s_name")).alias("name"), F.col("s_nationkey").cast("string").alias("nation")), "s_suppkey", ["name", "nation"]),
    "SELECT s_suppkey, c AS column, v AS value, CASE WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN 'numeric' ELSE 'text' END AS kind FROM (SELECT s_suppkey, 'name' AS c, CASE WHEN s_suppkey % 4 = 0 THEN '—' ELSE s_name END AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR FROM supplier) WHERE v IS NOT NULL AND v <> '—'")


def _sessions(spark, d):
    """Clusters of a user's events: a gap of an hour or more begins a new one; clusters of three and more are kept, with their spread."""
    rows = table(spark, d, "events").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = sessions(rows, "user_id", "_at", ["event_id"], 3600 * 1000000)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("value") - F.min("value"), 6).alias("spread")).where("n >= 3")


register("gap_sessions", _sessions, "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM s GROUP BY 1, 2 HAVING count(*) >= 3")
both("first_match_tag", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'wide' WHEN p_retailprice > 1500 THEN 'tall' WHEN p_size BETWEEN 10 AND 20 THEN 'rule' ELSE 'none' END AS tag FROM {part} WHERE p_size > 2", tables="part")


def _search(spark, d):
    """The first document that holds each whole needle: exact, then with spaces collapsed, then without spaces."""
    return layered_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


register("layered_search", _search, r"WITH n AS (SELECT item_id, text AS needle FROM benchmark), h AS (SELECT item_id, doc_id, CASE WHEN contains(text, needle) THEN 1 WHEN contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(needle, '\s+', ' ', 'g'))) THEN 2 WHEN contains(regexp_replace(text, '\s', '', 'g'), regexp_replace(needle, '\s', '', 'g')) THEN 3 END AS level FROM documents, n), m AS (SELECT item_id, min((level, doc_id)) AS m FROM h WHERE level IS NOT NULL GROUP BY 1) SELECT item_id, m[1]::BIGINT AS level, m[2] AS doc_id FROM m")
register("first_page_per_caption", lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("caption")).where("caption <> ''").groupBy("caption").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")), "SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS caption, min(page_id) AS first_page, count(*) AS n FROM pages WHERE regexp_extract(url, '^https?://([^/]+)/', 1) <> '' GROUP BY 1")
both("ordered_replacement", "SELECT item_id, replace(replace(replace(text, 'tion', '<T>'), 'ti', '<t>'), 'th', '<h>') AS text FROM {benchmark}", tables="benchmark")
register("gate_status", lambda s, d: daily_prices(s, d).agg(F.count("*").alias("n"), F.min("close").alias("lo")).select(F.filter(F.array(F.when(F.col("n") < 100, "few days"), F.when(F.col("lo") <= 0, "bad price"), F.when(F.col("n") > 2000, "many days")), lambda x: x.isNotNull()).alias("f")).select(F.array_join("f", ",").alias("failed"), F.when(F.size("f") == 0, "PASS").otherwise("FAIL").alias("status")), "WITH t AS (SELECT count(*) AS n, min(c) AS lo FROM (SELECT avg(o_totalprice) AS c FROM orders GROUP BY CAST(o_orderdate AS DATE))), f AS (SELECT list_filter([CASE WHEN n < 100 THEN 'few days' END, CASE WHEN lo <= 0 THEN 'bad price' END, CASE WHEN n > 2000 THEN 'many days' END], lambda x: x IS NOT NULL) AS f FROM t) SELECT array_to_string(f, ',') AS failed, CASE WHEN len(f) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM f")
both("panel_split", "SELECT l_returnflag AS panel, max(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) = 1 AS keeps_status, max(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) = 1 AS keeps_quantity FROM {lineitem} GROUP BY l_returnflag", tables="lineitem")
register("holm_adjust", lambda s, d: E.holm(table(s, d, "supplier").select(F.col("s_suppkey").alias("model"), F.when(F.col("s_suppkey") % 9 != 0, F.round(F.pmod(F.col("s_suppkey") * 37, F.lit(101)) / 5050.0, 6)).alias("p"))).select("model", F.round("p_holm", 6).alias("p_holm")),
    "WITH s AS (SELECT s_suppkey AS model, coalesce(CASE WHEN s_suppkey % 9 <> 0 THEN round(((s_suppkey * 37) % 101) / 5050.0::DOUBLE, 6) END, 1.0) AS p FROM supplier), r AS (SELECT model, p, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p AS x FROM s) SELECT model, round(least(1.0, max(x) OVER (ORDER BY p, model ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r")
