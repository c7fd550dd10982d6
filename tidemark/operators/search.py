"""Search for a set of passages in all texts: a join on each passage's rarest anchor, then a look at the passages that may be there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

from .duplicates import CHARACTERS, minimizers

#: (anchor, window) by falling length: a passage has the first class whose window it fills. Classes that no passage has cost nothing.
CLASSES = ((10, 20), (8, 8), (4, 4), (2, 2), (1, 1))
#: Up to so many different anchors of passages, or documents that may hold one, are broadcast, 8 bytes each; more are joined by a shuffle.
ANCHORS = 500_000
#: Passages that are looked for in one row's text, about.
TOGETHER = 64
_SPACES = "[ \t\n\f\r]+"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, _SPACES, "")


def _one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def _anchored(kinds: list[int] | None):
    """Batches of (id, t, kind) to the different (id, h) of each row's own class, or of all classes in kinds."""

    def run(batches):
        for b in batches:
            texts, own, at = b.column(1).to_pylist(), b.column(2).to_numpy(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHARACTERS):
                    size += len(texts[stop])
                    stop += 1
                for kind in kinds if kinds is not None else sorted(set(own[at:stop].tolist())):
                    rows = np.arange(at, stop) if kinds is not None else at + np.flatnonzero(own[at:stop] == kind)
                    text, h = minimizers([texts[r] for r in rows], *CLASSES[kind])
                    # classes have keys of their own
                    h = (h ^ (np.uint64(kind + 1) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[text])), pa.array(h)], ["id", "h"])
                at = stop

    return run


def layered_search(docs: DataFrame, needles: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", needle: str = "text") -> DataFrame:
    """(item_id, level, doc_id): where each whole needle stands first, by level and then document.

    Level 1 is the needle as it is, 2 with runs of white space as one space on both sides, 3 without white space. Whatever holds a
    needle at any level holds it at level 3, and then all the minimizers of the needle without its spaces. Texts and needles meet at the
    needle's minimizer that the fewest documents have; what meets is compared as a whole, at each level. Needles and texts may be of any number: both are
    joined by their keys, equal needles are one. Null and blank needles and null texts are found nowhere."""
    given = needles.select(F.col(item_id).cast("long").alias("item"), F.col(needle).cast("string").alias("needle")).where("item is not null and needle is not null").distinct()
    given = given.select("item", "needle", F.sha2("needle", 256).alias("n"))
    size, kind = F.length("bare"), F.lit(len(CLASSES) - 1)
    for k in range(len(CLASSES) - 2, -1, -1):
        kind = F.when(size >= CLASSES[k][1], k).otherwise(kind)
    own = given.select("n", "needle", _bare(F.col("needle")).alias("bare")).where("bare <> ''").dropDuplicates(["n"])
    own = materialize(own.withColumn("kind", kind), "needles")
    kinds = sorted(r[0] for r in own.select("kind").distinct().collect())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("t")).where("doc is not null and t is not null")

    needle_keys = materialize(own.select("n", "bare", "kind").mapInArrow(_anchored(None), "id string, h long"), "needle_keys")
    wanted = needle_keys.select("h").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= ANCHORS else wanted
    text_keys = rows.select("doc", _bare(F.col("t")).alias("bare"), F.lit(0).alias("kind")).mapInArrow(_anchored(kinds), "id long, h long")
    hits = materialize(text_keys.join(wanted, "h", "left_semi").select(F.col("id").alias("doc"), "h"), "hits")

    counts = hits.groupBy("h").agg(F.count("*").alias("c"))
    rarest = needle_keys.join(counts, "h", "left").groupBy(F.col("id").alias("n")).agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h")).alias("m"))
    # a needle one of whose anchors is in no text is in no text
    rarest = rarest.where("m.c > 0").select("n", F.col("m.h").alias("h"))
    may = materialize(hits.join(rarest, "h").select("doc", "n").distinct(), "candidates")
    many = may.groupBy("doc").agg(F.floor(F.count("*") / TOGETHER + 1).alias("parts"))
    shapes = own.select("n", "needle", _one_space(F.col("needle")).alias("one"), "bare")
    lists = may.join(many, "doc").join(shapes, "n").groupBy("doc", F.pmod(F.xxhash64("n"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("n", "needle", "one", "bare")).alias("needles"))

    def levels(t: Column) -> Column:
        level = lambda x: F.when(F.contains(t["t"], x["needle"]), 1).when(F.contains(t["one"], x["one"]), 2).when(F.contains(t["bare"], x["bare"]), 3)
        return F.transform("needles", lambda x: F.struct(x["n"].alias("n"), level(x).alias("level")))

    # few documents may hold anything: the others' texts stay where they are
    few = may.select("doc").distinct()
    if few.count() <= ANCHORS:
        rows = rows.join(F.broadcast(few), "doc", "left_semi")
    # the text's three forms are bound once for all needles of the row
    forms = F.array(F.struct("t", _one_space(F.col("t")).alias("one"), _bare(F.col("t")).alias("bare")))
    judged = rows.join(lists, "doc").select("doc", F.explode(F.flatten(F.transform(forms, levels))).alias("x")).where("x.level is not null")
    best = judged.groupBy("x.n").agg(F.min(F.struct(F.col("x.level").cast("long").alias("level"), "doc")).alias("m"))
    return given.select("item", "n").join(best, "n").groupBy("item").agg(F.min("m").alias("m")).select(F.col("item").alias("item_id"), F.col("m.level").alias("level"), F.col("m.doc").alias("doc_id"))
