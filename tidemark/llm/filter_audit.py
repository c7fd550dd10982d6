"""How five filters of documents overlap: what each one removes, in every order of application.

Each document gets a mask of five bits, one for each filter that it fails, by SQL expressions on its whole text. Whether a text
occurs under a smaller id is a grouped minimum over texts. What the orders give depends on the masks' counts alone, so the
documents are summed up into 32 cells a part, and the 120 orders are enumerated over cells.

No group of copies meets in one task: copies are summed up by (text, part, mask, labels) before they are shuffled, and what is
left of a text is a few rows a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: Fixed values of the filters: least words, least percent of distinct words, most percent of capitals, characters that must not occur.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Null ids are dealt to so many keys of the join with the labels.
NULL_KEYS = 64


def orders() -> list[str]:
    return ["".join(p) for p in permutations(LETTERS)]


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest, bits: the filters A to D that a text fails, as bits 0 to 3, and the text's SHA-256, by which texts are told apart.

    A null text is an empty one, a null part the empty string."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    words, different = F.size("_w"), F.size(F.array_distinct("_w"))
    fails = [
        words < LEAST_WORDS,
        different * 100 < words * LEAST_DISTINCT,
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")) * 100 > F.length("_t") * MOST_CAPITALS,
        F.col("_t").rlike(SIGNS),
    ]
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"), bits.alias("bits"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part with that mask, and how many of them labels (doc_id, quality, toxic) mark as 1.

    Filter E, bit 4: the text occurs under a smaller id. A null id is smaller than none and has none smaller. Rows that repeat an id
    are documents of their own; an id that labels repeat is marked if one of its rows is."""
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(NULL_KEYS)).cast("int")).otherwise(0)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")))
    marks = marks.where("doc_id is not null").withColumn("_k", F.lit(0))
    known = masks.withColumn("_k", spread).join(marks, ["doc_id", "_k"], "left").fillna(False, ["quality", "toxic"])
    own = ["digest", "part", "bits", "quality", "toxic"]
    # the join's own partitions serve the first sum; rows of one id and text become one
    once = known.groupBy("doc_id", "_k", *own).agg(F.count("*").alias("n"))
    # of a group's rows with an id only those with the smallest may be the text's first
    id_rows = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    sums = once.groupBy(own).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("none"), F.min(id_rows).alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("none") + F.when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0)
    parted = sums.select("part", "bits", "quality", "toxic", "n", kept.alias("kept"))
    both = parted.select("part", "quality", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("c"))
    marked = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return both.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), marked("quality").alias("good"), marked("toxic")).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part of docs.

    labels: doc_id, quality, toxic. Other columns of both are ignored; an empty table has no parts and gives no rows."""
    counted = cells(text_masks(docs, id_col, text_col, part_col), labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = [f"named_struct('filter_order', '{o}', 'step', {k + 1}, 'bit', {1 << LETTERS.index(o[k])}, 'before', {sum(1 << LETTERS.index(x) for x in o[:k])})" for o in orders() for k in range(5)]
    rows = parts.select("part", "cells", F.expr(f"inline(array({','.join(steps)}))"))
    total = lambda what, test: F.expr(f"aggregate(cells, 0L, (a, c) -> a + if({test}, {what}, 0L))")
    removed = "c.mask & before = 0 and c.mask & bit <> 0"
    return rows.select(
        "part", "filter_order", "step",
        total("c.n", "c.mask & (before | bit) = 0").alias("kept"),
        total("c.n", removed).alias("removed"),
        total("c.n", "c.mask & before <> 0 and c.mask & bit <> 0").alias("redundant"),
        total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", removed).alias("good_lost"),
        total("c.toxic", removed).alias("toxic_lost"),
        # of the orders of k failed filters each one comes first in a k-th part
        total("c.n * (120 div bit_count(c.mask))", "c.mask & bit <> 0").alias("shapley"),
    )
