"""Toxicity: a sparse logistic classifier of words, regularised by counterfactuals.

Features are the presence of hashed words and of hashed word beginnings, weighted by their rarity in the labelled sample. Sentences of the labelled documents that name a
group are copied with the group swapped for another of its kind, and the fit penalises the squared change of the score under
each swap, so naming a group cannot carry toxicity by itself. L1 shrinkage leaves weights to telling words only, which
keeps long clean documents clean. The fit runs on the driver over at most 2 * PER_CLASS labelled rows (the documented bound).

Defined cases: null and empty texts get the score of a text without telling words; with labels of one class, or none, every score is
that class (0 without labels); repeated rows get equal scores; very long texts are scored whole; score and predicted are replaced, other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.tables import fold, table
from pairforge.llm.words import bucketed, labelled, small, words
from pairforge.plans.scratch import Scratch

BUCKETS, PER_CLASS, STEPS, BATCH, RATE, SHRINK, SWAP_PENALTY = 1 << 18, 4000, 640, 256, 0.1, 1e-3, 1.0
#: Lengths in bytes of the beginnings of words that are features; letters with accents have two.
LEAST, BEGINNINGS = 0.7, (3, 4, 5, 6, 7, 8)

#: Terms that name a group, by language, kind and number. A swap puts another term of the same list in place.
IDENTITIES = [
    # English
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["black", "white", "asian", "latino", "arab"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrant", "refugee", "foreigner"],
    ["immigrants", "refugees", "foreigners"],
    ["african", "american", "mexican", "chinese", "indian", "european"],
    ["young", "old", "elderly", "disabled"],
    # German
    ["frauen", "männer", "mädchen", "jungen"],
    ["frau", "mann"],
    ["schwarze", "weiße", "asiatische", "arabische"],
    ["muslimische", "christliche", "jüdische", "hinduistische", "buddhistische"],
    ["muslime", "christen", "juden", "buddhisten", "atheisten"],
    ["schwule", "lesbische", "bisexuelle", "heterosexuelle"],
    ["einwanderer", "flüchtlinge", "ausländer"],
    ["afrikaner", "amerikaner", "mexikaner", "chinesen", "inder", "europäer"],
    # French
    ["femmes", "hommes", "filles", "garçons"],
    ["femme", "homme", "fille", "garçon"],
    ["noirs", "blancs", "asiatiques", "arabes"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["homosexuels", "hétérosexuels", "bisexuels"],
    ["immigrés", "réfugiés", "étrangers"],
    ["africains", "américains", "mexicains", "chinois", "indiens", "européens"],
    # Spanish
    ["mujeres", "hombres", "niñas", "niños"],
    ["mujer", "hombre", "niña", "niño"],
    ["negros", "blancos", "asiáticos", "árabes"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["homosexuales", "heterosexuales", "bisexuales"],
    ["inmigrantes", "refugiados", "extranjeros"],
    ["africanos", "americanos", "mexicanos", "chinos", "indios", "europeos"],
]
_SWAP = {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in IDENTITIES for i, a in enumerate(kind)}


def present(found: list[bytes]) -> np.ndarray:
    kinds = set(found)
    return np.unique(bucketed([*kinds, *(b"^%d" % k + w[:k] for w in kinds for k in BEGINNINGS if len(w) > k)], BUCKETS))


def swaps(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features of a sentence, features with its group terms swapped) for every sentence that names a group."""
    out = []
    for sentence in text.replace(b"\n", b".").split(b"."):
        found = words(sentence)
        if not _SWAP.keys().isdisjoint(found):
            out.append((present(found), present([_SWAP.get(w, w) for w in found])))
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, changes = [], []
        for t in batch.column("text").cast(pa.binary()).to_pylist():
            ids.append(present(words(t)).astype(np.int32).tobytes())
            changes.append([{"plus": np.setdiff1d(b, a).astype(np.int32).tobytes(), "minus": np.setdiff1d(a, b).astype(np.int32).tobytes()} for a, b in swaps(t)])
        kind = pa.list_(pa.struct([("plus", pa.binary()), ("minus", pa.binary())]))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "ids": pa.array(ids, pa.binary()), "changes": pa.array(changes, kind)})


Swap = tuple[np.ndarray, np.ndarray, int]


def fit(rows: list[tuple[np.ndarray, int]], swapped: list[Swap], penalty: float = SWAP_PENALTY) -> tuple[float, np.ndarray]:
    """(bias, weights) by proximal Adagrad, both classes weighing alike. swapped: features that a swap adds and takes away, and how often it occurs.

    The penalty is the mean squared change of the logit over all swaps, of which a step takes the whole gradient.
    """
    n = len(rows)
    y = np.array([t for _, t in rows])
    df = np.bincount(np.concatenate([i for i, _ in rows]), minlength=BUCKETS)
    rarity = np.where((df >= 2) & (df < 0.3 * n), np.log((n + 1) / np.maximum(df, 1)), 0.0) / 4
    used = np.flatnonzero(rarity)  # the features that carry a weight, numbered anew
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    rarity, m = rarity[used], len(used)
    known = lambda ids: place[ids][place[ids] >= 0]
    found = [known(i) for i, _ in rows]
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    parts = [(known(a), known(b), c) for a, b, c in swapped]
    of = np.repeat(np.arange(len(parts)), [len(a) + len(b) for a, b, _ in parts]).astype(np.int64)
    at = np.concatenate([np.empty(0, np.int64), *(x for a, b, _ in parts for x in (a, b))]).astype(np.int64)
    sign = np.concatenate([np.empty(0), *(x for a, b, _ in parts for x in (np.ones(len(a)), -np.ones(len(b))))]) * rarity[at]
    often = np.array([c for _, _, c in parts], float) / max(1, sum(c for _, _, c in parts))
    bias, w = -1.0, np.zeros(m)
    gb, gw = 1e-3, np.full(m, 1e-3)
    order = np.random.default_rng(5)
    epochs = -(-STEPS // -(-n // BATCH))  # as many steps whatever the number of rows
    for epoch in range(epochs):
        shuffled, rate = order.permutation(n), RATE * (1 - epoch / epochs)
        for start in range(0, n, BATCH):
            part = shuffled[start : start + BATCH]
            sizes = np.array([len(found[i]) for i in part])
            row, ids = np.repeat(np.arange(len(part)), sizes), np.concatenate([found[i] for i in part])
            logit = bias + np.bincount(row, rarity[ids] * w[ids], len(part))
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) * weight[part] / weight[part].sum()
            change = np.bincount(of, sign * w[at], len(parts)) * often
            grad = np.bincount(ids, rarity[ids] * err[row], m) + 2 * penalty * np.bincount(at, sign * change[of], m)
            gb, gw = gb + err.sum() ** 2, gw + grad**2
            bias -= rate * err.sum() / np.sqrt(gb)
            step = rate / np.sqrt(gw)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK, 0)
    out = np.zeros(BUCKETS)
    out[used] = w * rarity
    return bias, out


def calibrated(rows: list[tuple[np.ndarray, int]], swapped: list[Swap], prior: float) -> tuple[float, np.ndarray]:
    """fit(), with its logits stretched and moved so that they are probabilities for texts it has not seen.

    A third of the rows is scored by a fit on the others; a logistic curve of those logits, with label 1 weighing for its
    share `prior`, gives the stretch and the shift.
    """
    part = np.arange(len(rows)) % 3 == 0
    others, unseen = [[r for r, p in zip(rows, part, strict=True) if p == side] for side in (False, True)]
    stretch, shift = 1.0, 0.0
    if len({t for _, t in others}) == 2 and len({t for _, t in unseen}) == 2:
        bias, w = fit(others, swapped)
        y, logit = np.array([t for _, t in unseen]), np.array([bias + w[i].sum() for i, _ in unseen])
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        for _ in range(3000):
            err = (1 / (1 + np.exp(-np.clip(stretch * logit + shift, -30, 30))) - y) * weight / weight.sum()
            stretch, shift = max(0.1, stretch - 2 * (err * logit).sum()), shift - 2 * err.sum()
    bias, w = fit(rows, swapped)
    return float(stretch * bias + shift), stretch * w


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> tuple[float, np.ndarray]:
    learn = [k for k in range(folds) if k != held_out]
    scratch = Scratch(docs.sparkSession)
    sample = labelled(docs, labels, "toxic", folds, learn, per_class)
    made = scratch.keep(sample.mapInArrow(_featurise, "doc_id long, y int, ids binary, changes array<struct<plus:binary,minus:binary>>"))
    got = sorted(made.select("doc_id", "y", "ids").collect(), key=lambda r: r.doc_id)
    if len({r.y for r in got}) < 2:
        return (30.0 if got and got[0].y else -30.0), np.zeros(BUCKETS)
    # The same swap recurs in many sentences; the different ones are few.
    changes = made.select(F.explode("changes").alias("c")).groupBy("c.plus", "c.minus").agg(F.count("*").alias("n")).collect()
    read = lambda b: np.frombuffer(b, np.int32)
    prior = labels.where(fold(F.col("doc_id"), folds).isin(learn)).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
    swapped = [(read(r.plus), read(r.minus), r.n) for r in sorted(changes, key=lambda r: (bytes(r.plus), bytes(r.minus)))]
    return calibrated([(read(r.ids), r.y) for r in got], swapped, min(max(prior, 0.01), 0.99))


def score_toxicity(docs: DataFrame, model: tuple[float, np.ndarray], text: str = "text") -> DataFrame:
    """docs with score (double) and predicted (int: 1 at a score of LEAST or more)."""
    docs = docs.drop("score", "predicted")  # columns of these names are replaced
    telling = np.flatnonzero(model[1])
    shared = docs.sparkSession.sparkContext.broadcast((model[0], telling, model[1][telling]))  # at most BUCKETS weights
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, some = shared.value
        w = np.zeros(BUCKETS)
        w[at] = some
        for batch in small(batches):
            logits = np.array([bias + w[present(words(t))].sum() for t in batch.column(text).cast(pa.binary()).to_pylist()])
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))), pa.float64())], names=[*names, "score"])

    out = docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
