"""Quality classifier: a second-order factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), so the interactions of all pairs
cost time linear in the features. It is fitted on the driver on at most 2 * PER_CLASS labelled rows (the documented
bound); the features of those rows are made by tasks. Every document is then scored whole, in Arrow batches.

Defined cases: null and empty texts are scored by their statistics; with labels of one class, or none, every score is the share of
label 1 among them (1 without labels: nothing is known against a text); repeated rows get equal scores; very long texts are scored whole; score and predicted are replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.tables import fold, table
from pairforge.llm.words import bucketed, labelled, small, words

BUCKETS, RANK, PER_CLASS, EPOCHS, BATCH, RATE, DECAY = 1 << 15, 8, 3000, 16, 256, 0.08, 1e-5
LEAST = 0.3
STATS = 16
#: The end of a piece that ends in a sign, and a piece of signs only.
_SIGN_END, _SIGNS_ONLY = re.compile(rb"[^A-Za-z0-9\x80-\xff\s](?!\S)"), re.compile(rb"(?<!\S)[^A-Za-z0-9\x80-\xff\s]+(?!\S)")


def statistics(text: bytes, found: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Shares of byte classes, repetition and lengths of a text; zeros for an empty one."""
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    n, parts = max(1.0, raw.sum()), max(1, len(found))
    lower, upper, high = raw[97:123].sum(), raw[65:91].sum(), raw[128:].sum()
    count = lambda s: raw[list(s)].sum()
    counts = np.unique(ids, return_counts=True)[1] if len(ids) else np.zeros(1)
    pieces = text.split()
    same = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
    return np.array(
        [
            upper / max(1.0, lower + upper),
            high / n,
            raw[48:58].sum() / n,
            count(b".,;:?'\"") / n * 5,
            count(b"!") / n * 5,
            count(b"#$%&*@^~<>=+_/\\") / n * 5,
            count(b"|[]{}()-") / n * 5,
            raw[10] / n * 10,
            n / max(1, len(pieces)) / 10,
            len(counts) / parts,
            counts.max() / parts,
            same,
            np.log1p(n) / 10,
            np.log1p(parts) / 10,
            len(_SIGN_END.findall(text)) / max(1, len(pieces)),
            len(_SIGNS_ONLY.findall(text)) / max(1, len(pieces)),
        ]
    )


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids with equal weights of unit norm together, then the statistics' own ids."""
    found = words(text)
    ids = bucketed(found, BUCKETS)
    unique = np.unique(ids)
    value = np.full(len(unique), 1 / np.sqrt(max(1, len(unique))))
    return np.concatenate([unique, np.arange(BUCKETS, BUCKETS + STATS)]), np.concatenate([value, statistics(text or b"", found, ids)])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        made = [features(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "ids": pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), "values": pa.array([v.tobytes() for _, v in made], pa.binary())})


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def standard(self, values: np.ndarray) -> np.ndarray:
        """The statistics at the end of a row's values, standardised."""
        return np.concatenate([values[:-STATS], np.clip((values[-STATS:] - self.mean) / self.scale, -6, 6) / np.sqrt(STATS)])

    def logit(self, ids: np.ndarray, x: np.ndarray) -> float:
        p = self.v[ids] * x[:, None]
        return float(self.w0 + self.w[ids] @ x + 0.5 * ((p.sum(0) ** 2).sum() - (p**2).sum()))

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids, self.standard(values)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> Machine:
    """Adagrad on the logistic loss. Rows are weighted so that label 1 counts for its share `prior`, whatever the sample holds."""
    stats = np.array([v[-STATS:] for _, v, _ in rows])
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(BUCKETS + STATS), np.random.default_rng(7).normal(0, 0.01, (BUCKETS + STATS, RANK)), stats.mean(0), stats.std(0) + 1e-3)
    data = [(i, m.standard(v), y) for i, v, y in rows]
    share = np.mean([y for _, _, y in rows])
    weight = {1: prior / share, 0: (1 - prior) / (1 - share)}
    g0, gw, gv = 1e-6, np.full(m.w.shape, 1e-6), np.full(m.v.shape, 1e-6)
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(data))
        for at in range(0, len(data), BATCH):
            part = [data[i] for i in shuffled[at : at + BATCH]]
            sizes = np.array([len(i) for i, _, _ in part])
            starts, row = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(part)), sizes)
            ids, x = np.concatenate([i for i, _, _ in part]), np.concatenate([v for _, v, _ in part])
            p = m.v[ids] * x[:, None]
            s = _sums(p, starts)
            logit = m.w0 + _sums(m.w[ids] * x, starts) + 0.5 * ((s**2) - _sums(p**2, starts)).sum(1)
            y = np.array([t for _, _, t in part])
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * np.where(y == 1, weight[1], weight[0]) / len(part)
            e = err[row] * x
            step_w = np.bincount(ids, e, len(m.w)) + DECAY * m.w
            step_v = np.stack([np.bincount(ids, e * (s[row, f] - p[:, f]), len(m.w)) for f in range(RANK)], 1) + DECAY * m.v
            g0, gw, gv = g0 + err.sum() ** 2, gw + step_w**2, gv + step_v**2
            m.w0 -= RATE * err.sum() / np.sqrt(g0)
            m.w -= RATE * step_w / np.sqrt(gw)
            m.v -= RATE * step_v / np.sqrt(gv)
    return m


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Machine | float:
    """The machine, or a constant score where labels of one class, or none, are there to learn from."""
    learn = [k for k in range(folds) if k != held_out]
    sample = labelled(docs, labels, "quality", folds, learn, per_class).mapInArrow(_featurise, "doc_id long, y int, ids binary, values binary")
    # In the order of ids, so that the fit is the same whatever the partitions.
    rows = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.values), r.y) for r in sorted(sample.collect(), key=lambda r: r.doc_id)]
    known = labels.where(fold(F.col("doc_id"), folds).isin(learn)).agg(F.avg(F.col("quality").cast("double")).alias("p")).first().p
    if len({y for _, _, y in rows}) < 2:
        return 1.0 if not rows else float(rows[0][2])
    return fit(rows, min(max(known, 0.01), 0.99))


def score_quality(docs: DataFrame, model: Machine | float, text: str = "text") -> DataFrame:
    """docs with score (double) and predicted (int: 1 at a score of LEAST or more)."""
    docs = docs.drop("score", "predicted")  # columns of these names are replaced
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model)).withColumn("predicted", (F.col("score") >= LEAST).cast("int"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x (rank + 1) doubles
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches):
            scores = [m.score(*features(t)) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    out = docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
