"""Ranked lexical search against SQL and a plain loop."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pairforge.llm import norm_buckets
from tests.sides import duck, rows_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def plain(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, terms(t)) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, all_ = len(counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(w for _, c in counts for w in c), []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // all_
            s = sum(t * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, t in terms(text).items() if c[w])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return out


def invented(seed, n, words=400, least=0):
    draw = random.Random(seed)
    stock = [f"W{i}" if i % 3 else f"ü{i}Ä" for i in range(words)]
    common = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(draw.choices(stock, common, k=draw.randint(least, 60))) + draw.choice(["", ".", " !"])) for i in range(n)]


@pytest.fixture()
def buckets_of_few(monkeypatch):
    for name, value in (("BUCKET", 16), ("SEED", 64), ("FOCUS", 3)):
        monkeypatch.setattr(norm_buckets, name, value)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert rows_of(norm_buckets.op13_norm_buckets(spark, folder).toPandas()) == rows_of(duck(norm_buckets.sql(), folder))


@pytest.mark.parametrize("k", [1, 5, 20])
def test_search_equals_a_plain_loop(spark, buckets_of_few, k):
    docs, items = invented(1, 700), invented(2, 40)
    got = norm_buckets.top_documents(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(docs, items, k))


def test_odd_rows_ties_repeats_and_empty_tables(spark, tmp_path, buckets_of_few):
    docs = [(1, None), (2, ""), (3, " .\n-"), (None, "b c"), (5, "b c"), (5, "b c"), (4, "B, C!"), (6, "b " * 100_000), (7, "É é b"), (None, None), (None, "b c")]
    items = [(1, "b c c"), (1, "b c c"), (2, None), (3, ""), (None, "é"), (4, "nowhere"), (5, "b " * 300)]
    a = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n", "'x' AS places", "2 AS score", "3 AS rank")
    b = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "'y' AS df")
    want = sorted(map(str, plain(docs, items)))
    assert sorted(str(tuple(r)) for r in norm_buckets.top_documents(a, b).collect()) == want
    a.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(str, con.execute(norm_buckets.sql()).fetchall())) == want
    for x, y in ((a, b.where("false")), (a.where("false"), b), (a, b.where("item_id = 2"))):
        empty = norm_buckets.top_documents(x, y)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.collect() == []


def test_items_in_parts(spark, monkeypatch, buckets_of_few):
    monkeypatch.setattr(norm_buckets, "PART_CHARS", 1500)
    docs, items = invented(3, 200), invented(4, 30)
    got = norm_buckets.top_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(docs, items))


def test_bounds_skip_buckets_and_documents_and_lose_none(monkeypatch):
    """Vectors of very different lengths: short ones are never added up, and most others fail the coordinate bound."""
    draw = np.random.default_rng(0)
    queries = [norm_buckets.Query(i, np.arange(0, 40) * 5 + i % 5, np.sort(draw.integers(1, 20_000, 40))[::-1]) for i in range(10)]
    lengths, made = [], []
    for _ in range(4000):
        places = np.sort(draw.choice(200, 20, replace=False))
        impact = (draw.integers(1, 1000, 20) * draw.choice([1, 10, 900])).astype(np.int64)
        made.append((places, impact))
        lengths.append(math.sqrt((impact.astype(float) ** 2).sum()))
    order = np.argsort(lengths)[::-1]
    pieces, seen = [order[a : a + 100] for a in range(0, 4000, 100)], 0
    best, left = norm_buckets.Best(np.zeros(10, np.int64), 5), queries
    for piece in pieces:
        bucket = norm_buckets.Bucket(piece, np.array(lengths)[piece], np.array([20] * len(piece)), np.concatenate([made[i][0] for i in piece]), np.concatenate([made[i][1] for i in piece]))
        left = best.search(bucket, left)
        seen += len(left)
    assert seen < 0.6 * 10 * len(pieces)
    for q in queries:
        weight = dict(zip(q.places.tolist(), q.weights.tolist(), strict=True))
        exact = sorted(((sum(weight.get(int(p), 0) * int(x) for p, x in zip(*made[i], strict=True)), -i) for i in range(4000)), reverse=True)[:5]
        assert sorted(best.heaps[q.number], reverse=True) == exact
