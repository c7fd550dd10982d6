"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise part is taken in
time linear in the words as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Features are words hashed to
BUCKETS (weight 1 + ln(count), scaled to length 1), statistics of the text's form, and any numeric
metadata columns that are named. The model is fitted on the driver on at most SAMPLE labelled rows,
those with the smallest hashes of their ids; scoring covers every row and the whole text.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, sliced

BUCKETS = 1 << 16
RANK = 8
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 9000
EPOCHS = 12
WORD_CACHE = 120_000

# byte classes: other, lower, upper, digit, space, line end, sentence mark, other ASCII mark, non-ASCII
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b > 127 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:?'" else 7 if _c.isprintable() else 0
STATISTICS = ["log_bytes", "log_words", "upper", "digit", "space", "line_end", "sentence", "mark", "non_ascii", "control", "word_length", "distinct", "most_common", "repeated_next", "marked_words", "upper_words", "short_words", "long_words", "line_words", "word_entropy"]
_NO_MARKS = bytes(b for b in range(256) if _CLASS[b] != 7)


class _Buckets(dict):
    """word -> bucket, its length and whether it has an unusual mark or is all capitals, in one integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        bare = word.lower().strip(b".,;:?!'\"()")
        code = zlib.crc32(bare) % BUCKETS | min(len(word), 255) << 24 | bool(word.translate(None, _NO_MARKS)) << 32 | (len(word) > 1 and word.isupper()) << 33
        self[word] = code
        return code


_buckets = _Buckets()


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their values, statistics) of a whole text; a null or empty one has no words and zero statistics."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    stats = np.zeros(len(STATISTICS), np.float32)
    words = data.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32), stats
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) / len(data)
    codes = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    n = len(words)
    lengths, of = (codes >> 24) & 255, codes & (BUCKETS - 1)
    ids, counts = np.unique(of, return_counts=True)
    p = counts / n
    stats[:] = [
        math.log1p(len(data)), math.log1p(n), kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[0],
        lengths.mean(), len(ids) / n, p.max(), (of[1:] == of[:-1]).mean() if n > 1 else 0.0, ((codes >> 32) & 1).mean(), ((codes >> 33) & 1).mean(),
        (lengths <= 3).mean(), (lengths >= 14).mean(), math.log1p(n / (1 + data.count(b"\n"))), -(p * np.log2(p)).sum() / max(1.0, math.log2(n)),
    ]
    values = (1 + np.log(counts)).astype(np.float32)
    return ids.astype(np.int32), values / np.float32(math.sqrt(float(values @ values))), stats


def _metadata(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Named numeric columns, the last of the batch, as signed logarithms; null and non-finite count as 0."""
    out = np.zeros((batch.num_rows, len(columns)), np.float32)
    for k in range(len(columns)):
        v = batch.column(batch.num_columns - len(columns) + k).to_numpy(zero_copy_only=False).astype(np.float64)
        v = np.where(np.isfinite(v), v, 0)
        out[:, k] = np.sign(v) * np.log1p(np.abs(v))
    return out


class Model:
    """Weights of a fitted machine; statistics and metadata are standardised and follow the word buckets."""

    def __init__(self, extra: int, seed: int = 7):
        n = BUCKETS + len(STATISTICS) + extra
        self.b, self.w = 0.0, np.zeros(n, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((n, RANK)) * 0.02).astype(np.float32)
        self.mean, self.sd = np.zeros(n - BUCKETS, np.float32), np.ones(n - BUCKETS, np.float32)

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.sd, -4, 4) / np.float32(math.sqrt(max(1, len(self.mean))))

    def score(self, ids: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        d = self.dense(stats)
        v, vd = self.v[ids], self.v[BUCKETS:]
        q = values @ v + d @ vd
        square = float((values * values) @ (v * v).sum(axis=1)) + float((d * d) @ (vd * vd).sum(axis=1))
        z = self.b + float(values @ self.w[ids]) + float(d @ self.w[BUCKETS:]) + 0.5 * (float(q @ q) - square)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], extra: int = 0, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adagrad on the log loss, in batches; rows are (buckets, values, statistics, label). No rows give the score 0.5."""
    model = Model(extra, seed)
    if not rows:
        model.v[:] = 0
        return model
    stats = np.stack([r[2] for r in rows])
    model.mean, model.sd = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    dense = model.dense(stats)
    y = np.array([r[3] for r in rows], np.float32)
    share = min(max(float(y.mean()), 0.01), 0.99)
    model.b = math.log(share / (1 - share))
    rng, gw, gv, gb, rate = np.random.default_rng(seed), np.full(len(model.w), 1e-6, np.float32), np.full(model.v.shape, 1e-6, np.float32), 1e-6, 0.1
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            ids = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
            x = np.concatenate([rows[i][1] for i in part])
            at = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            d, vd = dense[part], model.v[BUCKETS:]
            v = model.v[ids] * x[:, None]
            q = d @ vd
            s2 = (d * d) @ (vd * vd).sum(axis=1)
            z = model.b + d @ model.w[BUCKETS:]
            for c in range(RANK):
                q[:, c] += np.bincount(at, v[:, c], len(part))
            s2 = s2 + np.bincount(at, (v * v).sum(axis=1), len(part))
            z = z + np.bincount(at, model.w[ids] * x, len(part)) + 0.5 * ((q * q).sum(axis=1) - s2)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            gb += float(g.sum()) ** 2
            model.b -= rate * float(g.sum()) / math.sqrt(gb)
            hit, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, g[at] * x, len(hit)).astype(np.float32) + 1e-6 * model.w[hit]
            dv = np.stack([np.bincount(back, g[at] * x * (q[at, c] - v[:, c]), len(hit)) for c in range(RANK)], axis=1).astype(np.float32) + 1e-5 * model.v[hit]
            for where, a, b in ((hit, dw, dv), (slice(BUCKETS, None), g @ d + 1e-6 * model.w[BUCKETS:], d.T @ (g[:, None] * q) - ((d * d).T @ g)[:, None] * vd + 1e-5 * vd)):
                gw[where] += a * a
                gv[where] += b * b
                model.w[where] -= rate * a / np.sqrt(gw[where])
                model.v[where] -= rate * 0.3 * b / np.sqrt(gv[where])
    return model


def held_out(id_col):
    """Whether crc32 of the id as text leaves 1 modulo 3; null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows that are not held out. Null labels and ids are left out; a doc_id with both labels counts with both.

    Rows that repeat a doc_id are one row, the one with the smallest text, so that at most `sample` rows reach the driver."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches):
        claim("quality", _buckets.clear)
        for b in sliced(batches):
            found = [text_features(t) for t in b.column(1).to_pylist()]
            more = _metadata(b, list(metadata))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()), pa.array([np.concatenate((f[2], m)).astype(np.float32).tobytes() for f, m in zip(found, more)], pa.binary())], ["label", "ids", "vals", "stats"])

    # chosen has at most `sample` rows of two numbers, so it may be broadcast at any size of docs
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(m).cast("double").alias(f"_m{k}") for k, m in enumerate(metadata)]).join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id", "label").agg(F.min(F.struct("text", *[f"_m{k}" for k in range(len(metadata))])).alias("row"))
    taken = one.select("label", "row.*").mapInArrow(run, "label int, ids binary, vals binary, stats binary").collect()
    rows = [(np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["vals"]), np.float32), np.frombuffer(bytes(r["stats"]), np.float32), int(r["label"])) for r in taken]
    rows.sort(key=lambda r: (r[3], r[0].tobytes(), r[1].tobytes()))
    return fit(rows, len(metadata))


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts are scored from their (empty) features, null ids stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("quality", _buckets.clear)
        m = shared.value
        for b in sliced(batches):
            more = _metadata(b, list(metadata))
            scores = [m.score(i, v, np.concatenate((s, x))) for (i, v, s), x in zip(map(text_features, b.column(1).to_pylist()), more)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(f"_m{k}") for k, c in enumerate(metadata)])
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ()) -> DataFrame:
    """Rows of docs, all columns, that the model does not reject. The text is scored where the row is read, without a join.

    metadata: numeric columns of docs that are features too."""
    model = train(docs, labels, metadata=metadata)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        claim("quality", _buckets.clear)
        m = shared.value
        for b in sliced(batches):
            more = _metadata(b.select([names.index(c) for c in metadata]), list(metadata))
            good = [m.score(i, v, np.concatenate((s, x))) >= 0.5 for (i, v, s), x in zip(map(text_features, b.column(names.index("text")).to_pylist()), more)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
