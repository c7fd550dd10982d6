"""Text classifiers by character n-grams (sub-linear TF-IDF of the most frequent ones) and linear SVMs, with folds that keep groups together.

All fits of a job, whatever its tasks, seeds and folds, share their work. Documents and frequencies of a term are summed up by
(assignment, fold) in one pass, and those of a training set are the total less the fold's. A second pass writes the known terms of all labelled
texts in blocks. A small training set is fitted as a whole by one task; of larger ones, each step of all fits is one pass over the blocks, so every
row counts and no task holds more than a block. Models are small and go to all tasks, which score texts of any number.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

from tidemark.functions import text as T
from tidemark.operators.char_grams import Terms, cells, chunks, gram_counts
from tidemark.operators.order import with_index
from tidemark.sources.scratch import materialize

FEATURES = 8000
#: So many rows are fitted in their own coordinates, a matrix of FEATURES numbers a row; more as sparse rows.
DENSE_ROWS = 1000
#: Larger matrices are kept as sparse rows; 400 MB.
DENSE_CELLS = 50_000_000
#: Terms of all its texts, at most, of a training set that one task fits.
TASK_CELLS = 5_000_000
#: Blocks in which more than one of so many numbers is not 0 are multiplied as full matrices, so many rows at once.
FILLED, ROWS = 25, 512
#: Bytes of the tasks' gradients that the driver adds up at most; more are added up by tasks.
COLLECTED = 32_000_000


def with_grams(df: DataFrame, text_col: str, out: str = "grams") -> DataFrame:
    """Character 2- to 4-grams with multiplicity, lower-cased, runs of white space as one space."""
    t = F.lower(T.collapse_space(F.col(text_col)))
    return df.withColumn(out, F.concat(*[T.char_grams(t, n, distinct=False) for n in (2, 3, 4)]))


class SublinearTfidf:
    """The FEATURES most frequent terms of an array column, weighted (1 + ln tf) (ln((1 + n) / (1 + df)) + 1) and scaled to length 1."""

    def __init__(self, features: int = FEATURES):
        self.features = features

    def fit(self, df: DataFrame, terms: str) -> SublinearTfidf:
        counter = CountVectorizer(inputCol=terms, outputCol="_tf", vocabSize=self.features).fit(df)
        self.idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(df)).idf.toArray() + 1
        self.index = {t: i for i, t in enumerate(counter.vocabulary)}
        return self

    @classmethod
    def of(cls, terms: list[str], df: list[int], n: int) -> SublinearTfidf:
        """From terms, their numbers of documents, and the number of all documents."""
        out = cls(len(terms))
        out.n_cells = int(sum(df))
        out.index, out.idf = {t: i for i, t in enumerate(terms)}, np.log((1 + n) / (1 + np.array(df, float))) + 1
        return out

    def weights(self, terms: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of a text's terms."""
        return self.weights_of(Counter(terms or []))

    def weights_of(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter((self.index.get(t, -1) for t in counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))[at >= 0]
        at = at[at >= 0]
        order = np.argsort(at)
        at, w = at[order], ((1 + np.log(n)) * self.idf[at])[order]
        return at, w / np.sqrt(w @ w) if len(at) else w


class Weigher:
    """A text's weights for many sets of features; its terms are looked up once."""

    def __init__(self, features: dict):
        self.codes, self.features = {}, {}
        for f in features.values():
            for t in f.index:
                self.codes.setdefault(t, len(self.codes))
        for name, f in features.items():
            places = np.full(len(self.codes) + 1, -1, np.int64)  # the last one is for unknown terms
            places[[self.codes[t] for t in f.index]] = list(f.index.values())
            self.features[name] = places, f.idf

    def weights(self, terms: list[str], n: list[int], names: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, weights) by each of the named features, as SublinearTfidf gives them."""
        codes, logs, out = np.fromiter((self.codes.get(t, -1) for t in terms), np.int64, len(terms)), 1 + np.log(np.array(n, float)), []
        for name in names:
            places, idf = self.features[name]
            at = places[codes]
            known = at >= 0
            at, w = at[known], logs[known]
            order = np.argsort(at)
            at = at[order]
            w = w[order] * idf[at]
            out.append((at, w / np.sqrt(w @ w) if len(at) else w))
        return out


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(group, fold): each group whole in one fold, labels spread evenly. Groups are dealt by size to the fold with the fewest rows.

    Groups are ranked by tasks; what they count of each label comes to the driver once for all groups that have the same counts, and as one number
    a group (12 bytes). Folds are the least of k, the groups and the rarest label's groups. Groups of one size are dealt in an order that the
    seed sets (0: by name)."""
    spark, name = df.sparkSession, F.col(group).cast("string")
    mixed = F.xxhash64(name, F.lit(seed)) if seed else F.lit(0).cast("long")
    by_label = df.groupBy(group, label).agg(F.count("*").alias("n"))
    own = by_label.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("counts"), (-F.sum("n")).alias("_size"))
    own = materialize(own.withColumns({"_kind": F.to_json("counts"), "_mixed": mixed, "_name": F.coalesce(name, F.lit("None"))}), "groups")
    kinds = [(r[0], r[1], r[2]) for r in own.groupBy("_kind").agg(F.first("counts"), F.count("*")).orderBy("_kind").collect()]
    counts = [[(x["label"], x["n"]) for x in c] for _, c, _ in kinds]
    per_label: dict = {}
    for labels, (*_, groups) in zip(counts, kinds):
        for lab, _ in labels:
            per_label[lab] = per_label.get(lab, 0) + groups
    k = min(k, sum(x[2] for x in kinds), min(per_label.values(), default=0))
    if k < 2 or len(per_label) < 2 or sum(groups * n for labels, (*_, groups) in zip(counts, kinds) for _, n in labels) < 4:
        raise ValueError("too few groups, rows or labels for two folds")
    numbers = spark.createDataFrame([(x[0], i) for i, x in enumerate(kinds)], "_kind string, _number int")
    ranked = materialize(with_index(own.join(numbers, "_kind").select(group, "_number", "_size", "_mixed", "_name"), ["_size", "_mixed", "_name"]), "ranked")
    order = ranked.select("idx", "_number").toArrow()
    number = np.empty(order.num_rows, np.int32)
    number[order.column(0).to_numpy()] = order.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(_dealt(number, counts, k).tobytes())

    def folded(batches):
        for b in batches:
            fold = np.frombuffer(shared.value, np.int32)[b.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fold)], [group, "fold"])

    return ranked.select(group, "idx").mapInArrow(folded, df.select(group).schema.add("fold", IntegerType()))


def _dealt(number: np.ndarray, counts: list[list[tuple]], k: int) -> np.ndarray:
    """The fold of each group, in order; number: which of the counts a group has."""
    loads: list[dict] = [{} for _ in range(k)]
    rows, out = [0] * k, np.empty(len(number), np.int32)
    for i, kind in enumerate(number.tolist()):
        labels = counts[kind]
        # (load + n)^2 - load^2 is n (2 load + n)
        best = min(range(k), key=lambda f: (sum([n * (2 * loads[f].get(lab, 0) + n) for lab, n in labels]), rows[f], f))
        for lab, n in labels:
            loads[best][lab] = loads[best].get(lab, 0) + n
            rows[best] += n
        out[i] = best
    return out


def squared_hinge(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """(w, b) that minimise |w|^2 / 2 + b^2 / 2 + sum cost (max(0, 1 - y f))^2 over sparse rows, by limited-memory quasi-Newton steps."""
    n = len(y)
    if len(value) * 8 >= n * size and n * size <= DENSE_CELLS:
        x = np.zeros((n, size))
        np.add.at(x, (row, col), value)
        scores, back = (lambda t: x @ t[:size] + t[size]), (lambda d: np.append(d @ x, d.sum()))
    else:
        by_row, by_col = np.argsort(row, kind="stable"), np.argsort(col, kind="stable")
        one, two = (col[by_row], value[by_row]), (row[by_col], value[by_col])
        rows, cols = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (row[by_row], col[by_col]))
        own_rows, own_cols = row[by_row][rows], col[by_col][cols]

        def summed(values, starts, own, length):
            out = np.zeros(length)
            out[own] = np.add.reduceat(values, starts) if len(starts) else 0.0
            return out

        scores, back = (lambda t: summed(one[1] * t[one[0]], rows, own_rows, n) + t[size]), (lambda d: np.append(summed(two[1] * d[two[0]], cols, own_cols, size), d.sum()))
    t = _minimised(scores, back, y, cost, size + 1)
    return t[:size], float(t[size])


class RowSpace:
    """The same problem for rows that are fewer than features, in coordinates of the rows: they keep all inner products, so the minimum is the same."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, size: int):
        self.x = np.zeros((n, size + 1))
        np.add.at(self.x, (row, col), value)
        self.x[:, size] = 1.0
        scale, q = np.linalg.eigh(self.x @ self.x.T)
        keep = scale > 1e-10 * scale.max()
        self.q, self.root = q[:, keep], np.sqrt(scale[keep])
        self.z = self.q * self.root

    def squared_hinge(self, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
        t = _minimised(lambda t: self.z @ t, lambda d: self.z.T @ d, y, cost, len(self.root))
        w = self.x.T @ (self.q @ (t / self.root))
        return w[:-1], float(w[-1])


def _minimised(scores, back, y: np.ndarray, cost: np.ndarray, size: int) -> np.ndarray:
    """The t with the least |t|^2 / 2 + sum cost (max(0, 1 - y scores(t)))^2; back is the transpose of scores."""

    def at(t):
        m = np.maximum(0.0, 1 - y * scores(t))
        return 0.5 * float(t @ t) + float(cost @ (m * m)), t + back(-2 * cost * y * m)

    steps = _descent(size)
    t = next(steps)
    while True:
        try:
            t = steps.send(at(t))
        except StopIteration as done:
            return done.value


def _descent(size: int, scale: np.ndarray | None = None, kept: int = 10, rounds: int = 1000, tolerance: float = 1e-4):
    """Yields points, gets their (loss, gradient), and returns the least one found: limited-memory quasi-Newton steps, from so many kept
    ones. scale: second derivatives; coordinates are stretched by their fourth roots, which took the fewest steps."""
    by = 1.0 if scale is None else scale**-0.25
    t = np.zeros(size)  # in units of by
    loss, g = yield t
    first, g, pairs = float(np.abs(g).max()), g * by, []
    for _ in range(rounds):
        if np.abs(g / by).max() <= tolerance * max(first, 1e-12):
            break
        q, alphas = g.copy(), []
        for s, u, r in reversed(pairs):
            alphas.append(r * float(s @ q))
            q -= alphas[-1] * u
        if pairs:
            s, u, _ = pairs[-1]
            q *= float(s @ u) / float(u @ u)
        for (s, u, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * float(u @ q)) * s
        slope, step = -float(g @ q), 1.0 if pairs else min(1.0, 1.0 / float(np.abs(g).sum()))
        while step > 1e-12:
            new, g2 = yield (t - step * q) * by
            if new <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, u = -step * q, g2 * by - g
        if float(s @ u) > 1e-12:
            pairs = [*pairs, (s, u, 1.0 / float(s @ u))][-kept:]
        t, loss, g = t + s, new, g2 * by
    return t * by


Fit = tuple[str, int]  # an assignment of folds, and the fold that its training set leaves out


class FoldModels:
    """One-against-rest linear SVMs (squared hinge), rows weighted inversely to their label's share, one for each fit.

    models: fit -> (features, coefficients, intercepts, labels); errors: fit -> why it has no model. What the driver holds is
    FEATURES terms and FEATURES numbers a label for each fit, whatever the number of texts."""

    def __init__(self, c: float = 1.0):
        self.c = c

    def fit(self, texts: DataFrame, roles: DataFrame, fits: list[Fit]) -> FoldModels:
        """texts: _row long, _t string (as grams_of gives it). roles: assignment, _row, label, fold of the labelled rows, each once an assignment. A fit
        learns from all rows of its assignment in other folds."""
        spark, fits = texts.sparkSession, [tuple(f) for f in fits]
        counts = {(r[0], r[1], r[2]): r[3] for r in roles.groupBy("assignment", "fold", "label").count().collect()}
        self.models, self.errors, self.features = {}, {}, {}
        plan = _Plan(fits, counts, self.c)
        numbers = spark.createDataFrame(plan.roles, "assignment string, fold int, label string, role int")
        own = roles.join(F.broadcast(numbers), ["assignment", "fold", "label"]).groupBy("_row").agg(F.collect_list("role").alias("roles"))
        own = materialize(texts.join(own, "_row").select("_t", "roles"), "texts")
        for f, chosen in _chosen(own, plan).items():
            self.features[f] = SublinearTfidf.of(*chosen, plan.rows(f))
        for f in fits:
            labels = plan.labels[f]
            if len(labels) < 2:
                self.errors[f] = "fewer than two labels" if labels else "no rows"
        plan.learn({f: self.features[f] for f in fits if f not in self.errors})
        if plan.fits:
            blocks = materialize(own.mapInArrow(plan.packed(), _BLOCKS), "blocks")
            small = [f for f in plan.fits if plan.cells[f] <= TASK_CELLS]
            found = _fit_in_tasks(blocks, plan, small) | _fit_by_passes(blocks, plan, [f for f in plan.fits if f not in small])
            for f, (w, b) in found.items():
                self.models[f] = self.features[f], w, b, plan.labels[f]
        del self.features
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df (assignment, fold, _t and whatever else) with scores (map, by label) and pred (string), by the model that left out the row's fold.

        Rows of an assignment and fold without a model are left out; see errors."""
        shared = df.sparkSession.sparkContext.broadcast(self.models)

        def run(batches):
            scorer = _Scorer(shared.value)
            for b in batches:
                name, fold, text = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("assignment", "fold", "_t"))
                fit = [scorer.numbers.get(x, -1) for x in zip(name, fold)]
                keep = [k for k, x in enumerate(fit) if x >= 0]
                own, text, fit = b.take(pa.array(keep, pa.int64())), [text[k] for k in keep], np.array([fit[k] for k in keep], np.int64)
                for i, j in chunks(text):
                    yield pa.RecordBatch.from_arrays([*own.slice(i, j - i).columns, *scorer.scored(text[i:j], fit[i:j])], [*b.schema.names, "scores", "pred"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("scores", MapType(StringType(), DoubleType())), StructField("pred", StringType())]))


class _Scorer:
    """Scores texts by the models of their fits; a text's terms are found once, and once for rows of one text that follow one another."""

    def __init__(self, models: dict):
        self.numbers = {f: k for k, f in enumerate(models)}
        codes: dict[str, int] = {}
        for features, *_ in models.values():
            for t in features.index:
                codes.setdefault(t, len(codes))
        self.terms, self.models, self.labels = Terms(list(codes)), [], [lab for *_, labels in models.values() for lab in labels]
        for features, w, b, labels in models.values():
            at, idf = [codes[t] for t in features.index], np.zeros(len(codes))
            idf[at] = features.idf
            weights = np.zeros((w.shape[1], len(codes)))
            weights[:, at] = (w * features.idf[:, None]).T
            self.models.append((idf, weights, b, len(labels)))
        self.firsts = np.cumsum([0, *(m[3] for m in self.models)])

    def scored(self, text: list[str | None], fit: np.ndarray) -> tuple[pa.Array, pa.Array]:
        new = [k == 0 or text[k] != text[k - 1] for k in range(len(text))]
        place = np.cumsum(new) - 1
        sizes, code, n = self.terms.rows([t for t, x in zip(text, new) if x])
        owner, value = np.repeat(np.arange(len(sizes)), sizes), 1 + np.log(n)
        many = np.array([m[3] for m in self.models], np.int64)[fit]
        ends = np.cumsum(many)
        items, keys, best = np.empty(int(many.sum())), np.empty(int(many.sum()), np.int64), np.empty(len(text), np.int64)
        for f in np.unique(fit):
            idf, weights, b, labels = self.models[f]
            rows = np.flatnonzero(fit == f)
            own = np.zeros(len(sizes), bool)
            own[place[rows]] = True
            there = own[owner]
            c, v, r = code[there], value[there], owner[there]
            norm = np.sqrt(np.bincount(r, (v * idf[c]) ** 2, minlength=len(sizes)))
            norm[norm == 0] = 1.0
            s = np.stack([np.bincount(r, v * x[c], minlength=len(sizes)) / norm + y for x, y in zip(weights, b)], axis=1)[place[rows]]
            s = np.concatenate((-s, s), axis=1) if labels == 2 else s
            at = (ends[rows] - labels)[:, None] + np.arange(labels)
            items[at], keys[at], best[rows] = s, self.firsts[f] + np.arange(labels), self.firsts[f] + s.argmax(axis=1)
        labels = pa.array(self.labels, pa.string())
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        return pa.MapArray.from_arrays(offsets, labels.take(pa.array(keys)), pa.array(items)), labels.take(pa.array(best))


_BLOCKS = "sizes binary, code binary, n binary, roles binary, norms binary"


class _Plan:
    """What the passes over labelled texts share. A place is an (assignment, fold), a role a place and a label; a text has a role in each assignment
    that it takes part in."""

    def __init__(self, fits: list[Fit], counts: dict, c: float):
        self.c, self.counts = c, counts
        self.places = {p: k for k, p in enumerate(sorted({(a, f) for a, f, _ in counts}))}
        self.names = {a: k for k, a in enumerate(sorted({a for a, *_ in counts}))}
        self.label_codes = {lab: k for k, lab in enumerate(sorted({lab for *_, lab in counts}))}
        self.roles = [(a, f, lab, self.places[a, f] * len(self.label_codes) + self.label_codes[lab]) for a, f, lab in counts]
        self.slots = np.array([self.names[a] for a, _ in self.places], np.int64)
        self.labels = {f: sorted({lab for a, fold, lab in counts if a == f[0] and fold != f[1]}) for f in fits}
        self.all_fits = fits

    def rows(self, f: Fit, label: str | None = None) -> int:
        return sum(n for (a, fold, lab), n in self.counts.items() if a == f[0] and fold != f[1] and label in (None, lab))

    def learn(self, features: dict) -> None:
        """Takes over the fits' terms: codes of all of them, and each fit's."""
        codes: dict[str, int] = {}
        for f in features.values():
            for t in f.index:
                codes.setdefault(t, len(codes))
        self.terms, self.fits = list(codes), list(features)
        self.at = {name: np.array([codes[t] for t in f.index], np.int64) for name, f in features.items()}
        self.idf = {name: f.idf for name, f in features.items()}
        self.cells = {name: f.n_cells for name, f in features.items()}

    def wide(self, f: Fit, values: np.ndarray) -> np.ndarray:
        """A fit's numbers by the code of all terms, 0 where it has not the term."""
        out = np.zeros(len(self.terms))
        out[self.at[f]] = values
        return out

    def role_of(self, column: pa.Array) -> np.ndarray:
        """A role or -1 of each text and assignment."""
        out = np.full((len(column), max(1, len(self.names))), -1, np.int32)
        role = column.flatten().to_numpy()
        out[pc.list_parent_indices(column).to_numpy(), self.slots[role // len(self.label_codes)]] = role
        return out

    def totals(self):
        """A function from texts and roles to their terms, each with its number and its texts by place."""
        k, labels = len(self.places), len(self.label_codes)

        def run(batches):
            for b in batches:
                texts = b.column(0).to_pylist()
                for i, j in chunks(texts):
                    role = self.role_of(b.column(1).slice(i, j - i))
                    terms, term, row, n = cells(texts[i:j])
                    many, df = np.zeros(len(terms) * k), np.zeros(len(terms) * k)
                    for slot in range(role.shape[1]):
                        own = (role[:, slot] // labels)[row]
                        use = own >= 0
                        at = term[use] * k + own[use]
                        many += np.bincount(at, n[use], len(many))
                        df += np.bincount(at, minlength=len(df))
                    found = [pa.array(x.astype(np.int64).reshape(-1, k)[:, p]) for x in (many, df) for p in range(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *found], ["term", *(f"{x}{p}" for x in "nd" for p in range(k))])

        return run

    def packed(self):
        """A function from texts and roles to blocks of the texts' known terms, with each text's norm for each fit."""
        known = [self.wide(f, self.idf[f]) for f in self.fits]

        def run(batches):
            terms = Terms(self.terms)
            for b in batches:
                texts = b.column(0).to_pylist()
                for i, j in chunks(texts):
                    sizes, code, n = terms.rows(texts[i:j])
                    owner, value = np.repeat(np.arange(j - i), sizes), 1 + np.log(n)
                    norms = np.stack([np.sqrt(np.bincount(owner, (value * x[code]) ** 2, j - i)) for x in known], axis=1).astype(np.float32)
                    norms[norms == 0] = 1.0
                    kinds = (np.int32, np.uint16 if len(self.terms) < 1 << 16 else np.uint32, np.uint8 if n.max(initial=0) < 256 else np.uint32)
                    columns = [x.astype(t).tobytes() for x, t in zip((sizes, code, n), kinds)] + [self.role_of(b.column(1).slice(i, j - i)).tobytes(), norms.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], ["sizes", "code", "n", "roles", "norms"])

        return run

    def opened(self, batch: pa.RecordBatch):
        """Of each block: sizes, codes, 1 + ln n, roles by text and assignment, norms by text and fit."""
        for k in range(batch.num_rows):
            sizes, code, n, roles, norms = (batch.column(c)[k].as_buffer() for c in range(5))
            sizes = np.frombuffer(sizes, np.int32)
            code = np.frombuffer(code, np.uint16 if len(self.terms) < 1 << 16 else np.uint32).astype(np.int64)
            n = np.frombuffer(n, np.uint8 if n.size == len(code) else np.uint32)
            yield sizes, code, 1 + np.log(n.astype(float)), np.frombuffer(roles, np.int32).reshape(len(sizes), -1), np.frombuffer(norms, np.float32).reshape(len(sizes), -1)

    def trained(self, f: Fit, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a fit learns from each text, and the text's label code."""
        own = roles[:, self.names[f[0]]]
        return (own >= 0) & (own // len(self.label_codes) != self.places.get(f, -1)), own % len(self.label_codes)


def _chosen(texts: DataFrame, plan: _Plan) -> dict[Fit, tuple[list[str], list[int]]]:
    """Each fit's FEATURES most frequent terms, and their numbers of texts in its training set."""
    spark, k, out = texts.sparkSession, len(plan.places), {f: ([], []) for f in plan.all_fits}
    if not k:
        return out
    names = [f"{x}{p}" for x in "nd" for p in range(k)]
    totals = texts.mapInArrow(plan.totals(), "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    totals = materialize(totals, "terms")
    # a training set's counts are the total less those of the fold left out
    own = {i: [p for (a, fold), p in plan.places.items() if a == f[0] and fold != f[1]] for i, f in enumerate(plan.all_fits)}
    added = lambda x, places: sum((F.col(f"{x}{p}") for p in places[1:]), F.col(f"{x}{places[0]}"))
    each = [F.struct(F.lit(i).alias("fit"), added("n", p).alias("n"), added("d", p).alias("df")) for i, p in own.items() if p]
    if not each:
        return out
    left = materialize(totals.select("term", F.explode(F.array(*each)).alias("x")).select("term", "x.*").where("n > 0"), "train_terms")
    # the least frequency that is taken is read off counts of ranges of frequencies, so that few more terms than those taken are ranked
    rough = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log("n") * 50) + 1000)
    cuts: dict[int, tuple[int, int]] = {}
    for fit, _, n, least in left.groupBy("fit", rough.alias("r")).agg(F.count("*"), F.min("n")).orderBy("fit", F.col("r").desc()).collect():
        above, cut = cuts.get(fit, (0, 0))
        cuts[fit] = (above + n, least) if above < FEATURES else (above, cut)
    least = spark.createDataFrame([(f, cut) for f, (_, cut) in cuts.items()], "fit int, cut long")
    first = F.row_number().over(Window.partitionBy("fit").orderBy(F.col("n").desc(), "term"))
    taken = left.join(F.broadcast(least), "fit").where("n >= cut").withColumn("place", first).where(f"place <= {FEATURES}")
    rows = taken.groupBy("fit").agg(F.sort_array(F.collect_list(F.struct("place", "term", "df"))).alias("x"))
    for fit, terms, df in rows.select("fit", F.col("x.term"), F.col("x.df")).collect():
        out[plan.all_fits[fit]] = list(terms), list(df)
    return out


def _fit_in_tasks(blocks: DataFrame, plan: _Plan, fits: list[Fit]) -> dict[Fit, tuple[np.ndarray, np.ndarray]]:
    """(coefficients, intercepts) of fits whose training sets one task holds each."""
    if not fits:
        return {}

    def parts(batches):
        places = [plan.wide(f, np.arange(1, len(plan.at[f]) + 1)).astype(np.int64) - 1 for f in fits]
        for b in batches:
            for sizes, code, value, roles, norms in plan.opened(b):
                owner, out = np.repeat(np.arange(len(sizes)), sizes), []
                for k, f in enumerate(fits):
                    use, label = plan.trained(f, roles)
                    at = places[k][code]
                    there = use[owner] & (at >= 0)
                    w = value[there] * plan.idf[f][at[there]] / norms[owner[there], plan.fits.index(f)]
                    row = (np.cumsum(use) - 1)[owner[there]]
                    out.append((k, int(use.sum()), row.astype(np.int32).tobytes(), at[there].astype(np.int32).tobytes(), w.tobytes(), label[use].astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["fit", "rows", "row", "at", "w", "label"])

    def one(key, table):
        k = key[0].as_py()
        rows, row, at, w, label = (table.column(c).to_pylist() for c in ("rows", "row", "at", "w", "label"))
        first = np.cumsum([0, *rows])
        row = np.concatenate([np.frombuffer(x, np.int32) + i for x, i in zip(row, first)])
        at, w, label = (np.frombuffer(b"".join(x), t) for x, t in ((at, np.int32), (w, float), (label, np.int32)))
        models = _one_against_rest(row, at.astype(np.int64), w, label, [plan.label_codes[x] for x in plan.labels[fits[k]]], len(plan.at[fits[k]]), plan.c)
        return pa.table({"fit": pa.array([k], pa.int32()), "w": pa.array([np.stack([m[0] for m in models], axis=1).tobytes()], pa.binary()), "b": pa.array([[m[1] for m in models]], pa.list_(pa.float64()))})

    # numbers of partitions of their own, so that fits are not put together into few tasks
    weighed = blocks.mapInArrow(parts, "fit int, rows int, row binary, at binary, w binary, label binary").repartition(4 * len(fits), "fit")
    found = weighed.groupBy("fit").applyInArrow(one, "fit int, w binary, b array<double>").collect()
    return {fits[r["fit"]]: (np.frombuffer(bytes(r["w"])).reshape(-1, len(r["b"])), np.array(r["b"])) for r in found}


def _one_against_rest(row: np.ndarray, col: np.ndarray, value: np.ndarray, label: np.ndarray, labels: list[int], size: int, c: float) -> list[tuple[np.ndarray, float]]:
    """A model for each label, or for the second of two."""
    few = RowSpace(row, col, value, len(label), size) if len(label) <= min(DENSE_ROWS, size) else None
    models = []
    for lab in labels[1:] if len(labels) == 2 else labels:
        y = np.where(label == lab, 1.0, -1.0)
        share = (y > 0).mean()
        cost = c * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        models.append(few.squared_hinge(y, cost) if few else squared_hinge(row, col, value, y, cost, size))
    return models


def _fit_by_passes(blocks: DataFrame, plan: _Plan, fits: list[Fit]) -> dict[Fit, tuple[np.ndarray, np.ndarray]]:
    """(coefficients, intercepts) of fits of any number of texts. A step of all models is one pass over the blocks: tasks add up their blocks' losses and
    gradients, a number a term and model."""
    spark, models = blocks.sparkSession, []  # (fit, label code, cost of its rows, cost of the others)
    for f in fits:
        labels = plan.labels[f]
        for lab in labels[1:] if len(labels) == 2 else labels:
            share = plan.rows(f, lab) / plan.rows(f)
            models.append((f, plan.label_codes[lab], plan.c * 0.5 / share, plan.c * 0.5 / (1 - share)))
    tasks, common = spark.sparkContext.defaultParallelism, spark.sparkContext.broadcast((plan, models))

    def passed(points: dict[int, np.ndarray] | None) -> dict[int, tuple[float, np.ndarray]]:
        """Loss and gradient of each model at its point; without points, the diagonal of the second derivatives where all rows count."""
        own = list(points) if points else list(range(len(models)))
        idf = [plan.wide(models[j][0], plan.idf[models[j][0]] if points else plan.idf[models[j][0]] ** 2) for j in own]
        at = np.stack([x * plan.wide(models[j][0], points[j][:-1]) for x, j in zip(idf, own)], axis=1) if points else None
        shared = spark.sparkContext.broadcast((at, np.array([points[j][-1] for j in own]) if points else None))

        def run(batches):
            plan, models = common.value
            found = _Gradients(plan, [models[j] for j in own], *shared.value)
            for b in batches:
                for block in plan.opened(b):
                    found.add(*block)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found.loss), pa.array([x.tobytes() for x in np.vstack((found.sums, found.last)).T], pa.binary())], ["model", "loss", "sums"])

        def added(key, table):
            sums = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
            return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "loss": [sum(table.column("loss").to_pylist())], "sums": pa.array([sums.tobytes()], pa.binary())})

        schema = "model int, loss double, sums binary"
        parts = blocks.coalesce(tasks).mapInArrow(run, schema)
        if tasks * len(own) * len(plan.terms) * 8 > COLLECTED:
            parts = parts.groupBy("model").applyInArrow(added, schema)
        rows: dict[int, list] = {}
        for part in parts.collect():
            rows.setdefault(part[0], []).append((part[1], np.frombuffer(bytes(part[2]))))
        shared.destroy()
        out = {}
        for j, found in rows.items():
            loss, sums = sum(x for x, _ in found), np.sum([x for _, x in found], axis=0)
            g = np.append(sums[:-1] * idf[own.index(j)], sums[-1])[np.append(plan.at[models[j][0]], len(sums) - 1)]
            out[j] = (loss + 0.5 * float(points[j] @ points[j]), points[j] + g) if points else (0.0, 1 + g)
        return out

    if not models:
        return {}
    scales = passed(None)
    steps = {j: _descent(len(s), s, 20) for j, (_, s) in scales.items()}
    points, ends = {j: next(s) for j, s in steps.items()}, {}
    while points:
        for j, x in passed(points).items():
            try:
                points[j] = steps[j].send(x)
            except StopIteration as done:
                ends[j] = done.value
                del points[j]
    out = {}
    for f in fits:
        own = [ends[j] for j in range(len(models)) if models[j][0] == f]
        out[f] = np.stack([t[:-1] for t in own], axis=1), np.array([t[-1] for t in own])
    return out


class _Gradients:
    """Sums of losses and gradients over blocks; weights are those of the models by term, with the terms' idf. Without weights, of second derivatives."""

    def __init__(self, plan: _Plan, models: list, weights: np.ndarray | None, intercepts: np.ndarray | None):
        self.plan, self.models, self.weights, self.intercepts = plan, models, weights, intercepts
        self.fits = [plan.fits.index(m[0]) for m in models]
        self.loss, self.last, self.sums = np.zeros(len(models)), np.zeros(len(models)), np.zeros((len(plan.terms), len(models)))
        self.full = None

    def add(self, sizes: np.ndarray, code: np.ndarray, value: np.ndarray, roles: np.ndarray, norms: np.ndarray) -> None:
        y, cost = np.empty((len(sizes), len(self.models))), np.empty((len(sizes), len(self.models)))
        for j, (f, label, own, other) in enumerate(self.models):
            use, labels = self.plan.trained(f, roles)
            y[:, j] = np.where(labels == label, 1.0, -1.0)
            cost[:, j] = np.where(use, np.where(labels == label, own, other), 0.0)
        norm = norms[:, self.fits].astype(float)
        if self.weights is None:
            value, norm = value * value, norm * norm
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if len(code) * FILLED < len(sizes) * len(self.plan.terms):
            self._sparse(owner, code, value, y, cost, norm)
            return
        if self.full is None:
            self.full = np.zeros((ROWS, len(self.plan.terms)), np.float32)
            self.narrow = None if self.weights is None else self.weights.astype(np.float32)
        ends = np.cumsum(sizes)
        for i in range(0, len(sizes), ROWS):
            j = min(i + ROWS, len(sizes))
            there = slice(ends[i] - sizes[i], ends[j - 1])
            x, at = self.full[: j - i], (owner[there] - i) * self.full.shape[1] + code[there]
            x.ravel()[at] = value[there]  # a view
            d = self._pulls(None if self.weights is None else x @ self.narrow, y[i:j], cost[i:j], norm[i:j])
            self.sums += x.T @ d.astype(np.float32)
            x.ravel()[at] = 0.0

    def _sparse(self, owner, code, value, y, cost, norm) -> None:
        scores = None
        if self.weights is not None:
            scores = np.stack([np.bincount(owner, value * np.ascontiguousarray(w)[code], len(y)) for w in self.weights.T], axis=1)
        d = self._pulls(scores, y, cost, norm)
        for j, x in enumerate(d.T):
            self.sums[:, j] += np.bincount(code, value * np.ascontiguousarray(x)[owner], len(self.sums))

    def _pulls(self, scores, y, cost, norm) -> np.ndarray:
        """Adds up losses; what each row and model adds to the sums of the row's terms."""
        if scores is None:
            d = 2 * cost
        else:
            m = np.maximum(0.0, 1 - y * (scores / norm + self.intercepts))
            self.loss += (cost * m * m).sum(axis=0)
            d = -2 * cost * y * m
        self.last += d.sum(axis=0)
        return d / norm


def grams_of(text_col: str):
    """The text that n-grams are taken from: lower-cased, runs of white space as one space."""
    return F.lower(T.collapse_space(F.col(text_col)))


def _numbered(df: DataFrame) -> DataFrame:
    """df with _row, written once so that numbers stay."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _roles(rows: DataFrame, name: str, label: str, fold: str = "fold") -> DataFrame:
    return rows.where(F.col(label).isNotNull()).select(F.lit(name).alias("assignment"), "_row", F.col(label).cast("string").alias("label"), F.col(fold).alias("fold"))


def _folds_of(folds: DataFrame) -> list[int]:
    return sorted(r[0] for r in folds.select("fold").distinct().collect())


def cross_validate(df: DataFrame, text_col: str, label: str, group: str, k: int = 5, c: float = 1.0, seed: int = 0) -> DataFrame:
    """df's rows with fold, pred and scores, each predicted by a model that saw none of its group."""
    folds = group_folds(df, group, label, k, seed)
    rows = _numbered(df.join(folds, group).withColumn("_t", grams_of(text_col)))
    models = FoldModels(c).fit(rows.select("_row", "_t"), _roles(rows, "", label), [("", f) for f in _folds_of(folds)])
    if models.errors:
        raise ValueError(min(models.errors.values()))
    found = models.predict(rows.withColumn("assignment", F.lit("")))
    return found.withColumn("pred", F.col("pred").cast(df.schema[label].dataType)).drop("_row", "_t", "assignment")


def learning_curve(df: DataFrame, text_col: str, label: str, group: str, ratios: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), fold: int = 0, k: int = 5) -> DataFrame:
    """(ratio, n_train, n_test, hits) on one fold, trained on nested subsets of the other folds' groups: the first of them in the order of a
    hash, as many as the ratio says, and more until there are two labels."""
    folds = group_folds(df, group, label, k)
    rows = _numbered(df.join(folds, group).withColumn("_t", grams_of(text_col)))
    test = F.col("fold") == fold
    own = rows.where(~test).groupBy(F.col(group).alias("g")).agg(F.collect_set(label).alias("labels")).withColumn("h", F.xxhash64(F.col("g").cast("string")))
    ranked = materialize(with_index(own, ["h", "g"]), "ranked")
    n_groups = ranked.count()
    firsts = sorted(r[1] for r in ranked.select("idx", F.explode("labels").alias("label")).groupBy("label").agg(F.min("idx")).collect())
    roles, names = None, {}
    for ratio in ratios:
        n = max(math.ceil(ratio * n_groups), firsts[1] + 1 if len(firsts) > 1 else n_groups)
        names[str(ratio)] = float(ratio)
        chosen = ranked.where(F.col("idx") < n).select(F.col("g").alias(group))
        part = _roles(rows.where(~test).join(chosen, group, "left_semi").unionByName(rows.where(test)).withColumn("_f", F.when(test, 0).otherwise(1)), str(ratio), label, "_f")
        roles = part if roles is None else roles.unionByName(part)
    roles = materialize(roles, "roles")
    models = FoldModels().fit(rows.select("_row", "_t"), roles, [(n, 0) for n in names])
    if models.errors:
        raise ValueError(min(models.errors.values()))
    tested = models.predict(roles.where("fold = 0").join(rows.select("_row", "_t"), "_row"))
    hits = tested.groupBy("assignment").agg(F.count("*").alias("n_test"), F.count_if(F.col("pred") == F.col("label")).alias("hits"))
    trained = roles.groupBy("assignment").agg(F.count_if(F.col("fold") == 1).alias("n_train"))
    return trained.join(hits, "assignment").select(F.col("assignment").cast("double").alias("ratio"), "n_train", "n_test", "hits").orderBy("ratio")


def report_tone(scored: DataFrame, report: str, pred: str, plus: str, minus: str, values: dict[str, list]) -> DataFrame:
    """Per report: mean(plus) - mean(minus) over rows whose prediction is in each list of values, and the lists' sizes; missing if either mean is."""
    aggs = [F.count("*").alias("n_sentences")]
    for name, labels in values.items():
        own = F.lit(True) if not labels else F.col(pred).isin(labels)
        aggs += [(F.avg(F.when(own, F.col(plus))) - F.avg(F.when(own, F.col(minus)))).alias(f"{name}_mean"), F.count_if(own).alias(f"n_{name}")]
    return scored.groupBy(report).agg(*aggs)


def crossfit_tones(sentences: DataFrame, labelled: DataFrame, text_col: str, label: str, report: str, sentence_id: str, plus: str, minus: str, k: int = 5, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Every sentence of the reports that have labels, for each seed of the folds, scored by a model that saw no row of its report: (seed, report,
    sentence_id, fold, pred, plus_score, minus_score, manual), manual being the sentence's own label or ''.

    labelled: (report, sentence_id, text, label, group); reports of one group are kept in one fold. The seeds' fits share their work."""
    train = _numbered(labelled.withColumn("_t", grams_of(text_col)))
    roles, of_report, fits = None, None, []
    for seed in seeds:
        folds = group_folds(labelled, "group", label, k, seed)
        own = train.join(folds, "group")
        fits += [(str(seed), f) for f in _folds_of(folds)]
        part, reports = _roles(own, str(seed), label), own.groupBy(report).agg(F.min("fold").alias("fold")).withColumn("assignment", F.lit(str(seed)))
        roles, of_report = (part, reports) if roles is None else (roles.unionByName(part), of_report.unionByName(reports))
    models = FoldModels().fit(train.select("_row", "_t"), materialize(roles, "roles"), fits)
    if models.errors:
        raise ValueError(min(models.errors.values()))
    scored = models.predict(sentences.withColumn("_t", grams_of(text_col)).join(of_report, report).select(report, sentence_id, "assignment", "fold", "_t"))
    out = scored.select(F.col("assignment").cast("int").alias("seed"), report, sentence_id, "fold", "pred", F.col("scores")[plus].alias("plus_score"), F.col("scores")[minus].alias("minus_score"))
    manual = labelled.groupBy(report, sentence_id).agg(F.min(F.col(label).cast("string")).alias("manual"))
    return out.join(manual, [report, sentence_id], "left").withColumn("manual", F.coalesce("manual", F.lit("")))


def crossfit_tone(sentences: DataFrame, labelled: DataFrame, text_col: str, label: str, report: str, sentence_id: str, plus: str, minus: str, k: int = 5, seed: int = 0) -> DataFrame:
    """crossfit_tones for one seed, without its column."""
    return crossfit_tones(sentences, labelled, text_col, label, report, sentence_id, plus, minus, k, (seed,)).drop("seed")


def predicted_counts(scored: DataFrame, report: str, labels: list) -> DataFrame:
    """(report, n_<label>...): how many sentences of each report have each predicted label."""
    return scored.groupBy(report).agg(*[F.count_if(F.col("pred") == x).alias(f"n_{x}") for x in labels])


def evaluate_tasks(df: DataFrame, tasks: dict[str, tuple[str, str | None]], text_col: str, group: str, least: int = 10, k: int = 5) -> DataFrame:
    """(task, n, accuracy, macro_f1, error) of cross-validated classifiers; tasks: name -> (label column, condition or none).

    A task of fewer than `least` rows, or whose rows do not allow two folds, has its error and no figures. All tasks' fits share their work."""
    from .metrics import labels_of, overall_metrics

    spark, schema = df.sparkSession, "task string, n long, accuracy double, macro_f1 double, error string"
    rows = _numbered(df.withColumn("_t", grams_of(text_col)))
    sizes, errors, fits, roles = {}, {}, [], None
    for name, (label, condition) in tasks.items():
        own = rows.where(F.col(label).isNotNull())
        own = own.where(condition) if condition else own
        sizes[name] = own.count()
        try:
            if sizes[name] < least:
                raise ValueError(f"fewer than {least} rows")
            folds = group_folds(own, group, label, k)
        except ValueError as e:
            errors[name] = str(e)
            continue
        fits += [(name, f) for f in _folds_of(folds)]
        part = _roles(own.join(folds, group), name, label)
        roles = part if roles is None else roles.unionByName(part)
    out = None
    if roles is not None:
        roles = materialize(roles, "roles")
        models = FoldModels().fit(rows.select("_row", "_t"), roles, fits)
        errors |= {name: e for (name, _), e in models.errors.items()}
        found = models.predict(roles.join(rows.select("_row", "_t"), "_row")).select("assignment", F.col("label").alias("true"), "pred")
        found = materialize(found, "predicted")
        for name in tasks:
            if name not in errors:
                own = found.where(F.col("assignment") == name)
                labels = sorted(r[0] for r in labels_of(own, ["true", "pred"]).collect())
                one = overall_metrics(own, "true", "pred", labels).select(F.lit(name).alias("task"), F.lit(sizes[name]).cast("long").alias("n"), "accuracy", "macro_f1", F.lit(None).cast("string").alias("error"))
                out = one if out is None else out.unionByName(one)
    failed = spark.createDataFrame([(n, sizes[n], None, None, e) for n, e in errors.items()], schema)
    return failed if out is None else out.unionByName(failed)


def seed_summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Over seeds: how many, mean, deviation, least, largest and the share of positive values."""
    v = F.col(value)
    return values.groupBy(*by).agg(F.count(v).alias("n_seeds"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg((v > 0).cast("double")).alias("share_positive"))
