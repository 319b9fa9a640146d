"""Mixing by soft membership: documents are repeated or thinned until expected domain tokens meet target weights.

1. A naive Bayes classifier of hashed words is fitted on documents that the labels table covers, PER_DOMAIN of each domain
   at most (the documented bound). The words of a text repeat each other, so n of them count as sqrt(n) at any n, and posteriors stay soft.
2. For documents d with t_d words and posteriors p_d, the rates r_d >= least minimise |sum t_d r_d p_d - target|; of those that do, the rates nearest to 1 (sum t_d (r_d - 1)^2). These are
   r_d = max(least, 1 - p_d . y) for K multipliers y, which Newton's method finds: a step solves (S + ridge) step = gradient, S = sum t_d p_d p_d' over the
   documents above least, and is halved until the convex dual falls. A pass is one aggregate of K sums over the table of (t_d, p_d), so nothing is joined back
   and no lineage grows. It ends when the target is met to CLOSE, or when no step lowers the dual; what is left of the target is returned, and logged if over CLOSE.
3. A document is repeated floor(r_d + u) times, u in [0, 1) hashed from its id.

Defined cases: null and empty texts have no words, the prior as posteriors, and weigh nothing; very long texts are read whole; columns with the
names of results are replaced, others stay; a domain with target 0 gets as little as `least` allows; without labelled documents posteriors are
uniform; null ids hash alike; repeated rows get equal rates; an empty table, or one without words, has rate 1 everywhere.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.tables import table, unused
from pairforge.llm.words import bucketed, small, words
from pairforge.plans.scratch import Scratch

BUCKETS, PER_DOMAIN, CLOSE = 1 << 15, 500, 1e-4
RIDGE = 1e-6
WEIGHTS = {"en": 0.40, "de": 0.22, "fr": 0.22, "es": 0.16}


@dataclass
class Membership:
    domains: list[str]
    prior: np.ndarray
    table: np.ndarray  # log P(bucket | domain), buckets x domains

    def posteriors(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        logit = np.log(self.prior)
        if n:
            logit = logit + self.table[ids].sum(0) / np.sqrt(n)
        p = np.exp(logit - logit.max())
        return p / p.sum()


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        made = [bucketed(words(t), BUCKETS).astype(np.int32).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch({"domain": batch.column("domain"), "ids": pa.array(made, pa.binary())})


def fit_membership(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = "lang", per_domain: int = PER_DOMAIN) -> Membership:
    covered = labels.where("doc_id is not null").select("doc_id").distinct()
    known = docs.where(F.col("text").isNotNull() & F.col(domain).isin(domains)).select("doc_id", F.col(domain).alias("domain"), F.xxhash64("text").alias("h"))
    known = known.join(covered, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    some = None
    for d in domains:
        one = known.where(F.col("domain") == d).orderBy(*order).limit(per_domain)
        some = one if some is None else some.unionByName(one)
    ids = some.select("doc_id", "domain").distinct()
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("text", "domain")
    counts = np.full((BUCKETS, len(domains)), 0.1)
    seen = np.ones(len(domains))
    for r in sample.mapInArrow(_ids, "domain string, ids binary").collect():
        counts[:, domains.index(r.domain)] += np.bincount(np.frombuffer(r.ids, np.int32), minlength=BUCKETS)
    for r in known.groupBy("domain").count().collect():  # all labelled documents; only the words are learned from a sample
        seen[domains.index(r["domain"])] += r["count"]
    return Membership(domains, seen / seen.sum(), np.log(counts / counts.sum(0)))


def with_membership(docs: DataFrame, shared: Broadcast, text: str = "text") -> DataFrame:
    """docs with tokens (long) and posteriors (array<double>, in the order of the model's domains) added. shared: a Membership of fixed size."""
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small(batches):
            counts, posts = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(m.domains)))
            for i, t in enumerate(batch.column(text).cast(pa.binary())):
                ids = bucketed(words(t.as_py()), BUCKETS)
                counts[i], posts[i] = len(ids), m.posteriors(ids)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(m.domains)
            yield pa.record_batch([*batch.columns, pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(posts.ravel()))], names=[*names, "tokens", "posteriors"])

    fields = [T.StructField("tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]
    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, *fields]))


def rate(posteriors: Column, steps: list[np.ndarray], least: float) -> Column:
    """The rate after all steps so far."""
    if not steps:
        return F.lit(1.0)
    one = lambda y: F.aggregate(F.zip_with(posteriors, y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    past = F.array(*[F.array(*[F.lit(float(v)) for v in y]) for y in steps])
    return F.aggregate(past, F.lit(1.0), lambda r, y: F.greatest(F.lit(float(least)), r - one(y)))


@dataclass
class Fit:
    steps: list[np.ndarray]  # for rate(): the multipliers, or none if all rates are 1
    residual: float  # |tokens by domain - target| / |target|
    passes: int


def solve_rates(table: DataFrame, weights: np.ndarray, least: float = 0.0, cover: bool = False) -> Fit:
    """The multipliers for table(tokens, posteriors). cover: the total is raised until no domain has to shrink (of those with a target over 0); else it stays."""
    k = len(weights)
    p = [F.col("posteriors")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(y: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens by domain, S over the documents not below floor, and the documents' part of the dual."""
        u = F.lit(1.0)
        for i in range(k):
            u = u - p[i] * F.lit(float(y[i]))
        rows = table.select("tokens", "posteriors", u.alias("u")).withColumn("r", F.greatest(F.lit(float(floor)), F.col("u")))
        t, u, r = F.col("tokens"), F.col("u"), F.col("r")
        free = F.when(u >= F.lit(float(floor)), t).otherwise(0)
        parts = [t * r * p[i] for i in range(k)] + [free * p[i] * p[j] for i, j in pairs] + [t * (r * u - r * r / 2)]
        got = np.array([v or 0.0 for v in rows.agg(*[F.sum(x).alias(f"_{i}") for i, x in enumerate(parts)]).first()])
        s = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:-1], strict=True):
            s[i, j] = s[j, i] = v
        return got[:k], s, got[-1]

    return newton(sums, weights, least, cover)


def newton(sums: Callable, weights: np.ndarray, least: float, cover: bool) -> Fit:
    """solve_rates on sums(y, floor)."""
    now, whole, _ = sums(np.zeros(len(weights)), -np.inf)
    ridge = RIDGE * np.trace(whole) / len(weights)
    if now.sum() <= 0:
        return Fit([], 0.0, 1)
    target = weights * ((now[weights > 0] / weights[weights > 0]).max() if cover else now.sum())
    goal = CLOSE * np.linalg.norm(target)
    y = centre = np.zeros(len(weights))
    now, free, part = sums(y, least)
    passes, best = 2, np.inf
    # RIDGE keeps a step bounded where few documents are above least, and keeps the tokens ridge (y - centre) off the
    # target; the centre follows y until that is nothing, or, if no rates meet the target, until they come no closer.
    while (left := np.linalg.norm(now - target)) > goal:
        slope = target - now + ridge * (y - centre)
        dual = part + target @ y + ridge / 2 * (y - centre) @ (y - centre)
        step = -np.linalg.solve(free + ridge * np.eye(len(y)), slope)
        fall, share, found = -slope @ step, 1.0, None
        while np.linalg.norm(slope) > goal / 10 and fall * share > 1e-13 * abs(dual) and found is None:
            z = y + share * step
            found = sums(z, least)
            passes += 1
            if found[2] + target @ z + ridge / 2 * (z - centre) @ (z - centre) > dual - 1e-4 * share * fall:
                found, share = None, share / 2
        if found is not None:
            y, (now, free, part) = z, found
        elif left < 0.9 * best:
            best, centre = left, y
        else:
            break
    return Fit([y] if y.any() or least > 1 else [], float(left / np.linalg.norm(target)), passes)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], least: float = 0.0, cover: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with tokens, posteriors and rate added, or replaced; without text if keep_text is not set."""
    return mix_with_fit(docs, labels, weights, least, cover, keep_text)[0]


def mix_with_fit(docs: DataFrame, labels: DataFrame, weights: dict[str, float], least: float = 0.0, cover: bool = False, keep_text: bool = True) -> tuple[DataFrame, Fit]:
    """What mix returns, and how far the expected tokens are from the target. Every text is scored once."""
    docs = docs.drop("tokens", "posteriors", "rate")
    domains = list(weights)
    w = np.array([weights[d] for d in domains]) / sum(weights.values())
    scratch = Scratch(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit_membership(docs, labels, domains))
    scored = with_membership(docs, shared)
    scored = scratch.keep(scored if keep_text else scored.drop("text"))
    shared.destroy()
    fit = solve_rates(scored.select("tokens", "posteriors"), w, least, cover)
    if fit.residual > CLOSE:
        logging.getLogger(__name__).warning("no rates of %s or more meet the target: residual %.2g after %d passes", least, fit.residual, fit.passes)
    return scored.withColumn("rate", rate(F.col("posteriors"), fit.steps, least)), fit


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row floor(rate + u) times."""
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("mix")), 11).cast("double") / F.lit(float(2**53))
    copies = F.floor(F.col("rate") + u).cast("int")
    (copy,) = unused(mixed, "copy")
    return mixed.select("*", F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).drop(copy)


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, keep_text=False).select("doc_id", "tokens", "posteriors", "rate")
