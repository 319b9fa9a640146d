"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At each level every child of the node that was reached draws
ln(u) / weight with u in (0, 1) hashed from the row's key and the child's path, and the largest draw
wins, so children are chosen in proportion to weight. A child's draw depends on its own path and weight
alone: a changed weight moves rows only into or out of that child's subtree. A new shard that opens
a region of its own therefore takes rows only into itself.

Columns of docs with the name of a result are replaced. Defined cases: a null key hashes as the empty text; rows with one key share a shard; a null text has
size 16 and crc32 0; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.llm.tables import table, unused

Tree = dict[str, dict[str, dict[int, float]]]

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]

#: Rows that one sort of slots holds, about.
SLOT_GROUP_ROWS = 50_000


def tree_of(shards: int, regions: int = 4, racks: int = 2) -> Tree:
    """The production tree: equal weights, shards dealt over regions x racks in order."""
    each = shards // (regions * racks)
    if each * regions * racks != shards:
        raise ValueError(f"{shards} shards do not fill {regions} x {racks} racks evenly")
    return {f"g{g}": {f"k{k}": {(g * racks + k) * each + i: 1.0 for i in range(each)} for k in range(racks)} for g in range(regions)}


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    n = sum(len(s) for r in tree.values() for s in r.values())
    return tree | {f"g{len(tree)}": {"k0": {n: weight}}}


def _draw(key: Column, path: Column, weight: Column) -> Column:
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), path).cast("binary")), 1, 13), 16, 10).cast("double")
    return F.log((u + 0.5) / F.lit(float(2**52))) / weight


def _winner(key: Column, children: Column) -> Column:
    """children: array<struct<path, weight>>. Ties go to the later path."""
    return F.array_max(F.transform(children, lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path"))))["path"]


def _level(children: dict[str, dict[str, float]]) -> Column:
    one = lambda kids: F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for p, w in kids.items()])
    return F.create_map(*[x for parent, kids in children.items() for x in (F.lit(parent), one(kids))])


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key (a string column). A node weighs what its shards weigh together."""
    mass = lambda t: sum(mass(x) if isinstance(x, dict) else x for x in t.values())
    regions = _level({"": {r: mass(racks) for r, racks in tree.items()}})
    racks = _level({r: {f"{r}/{k}": mass(shards) for k, shards in racks.items()} for r, racks in tree.items()})
    shards = _level({f"{r}/{k}": {f"{r}/{k}/{i}": w for i, w in shards.items()} for r, racks in tree.items() for k, shards in racks.items()})
    at = F.lit("")
    for level in (regions, racks, shards):
        at = _winner(key, F.element_at(level, at))
    return F.element_at(F.split(at, "/"), -1).cast("int")


def shard(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard added.

    Slots count from 0 in each shard without gaps, in the order of (md5 of the key, key, crc32, size).
    A shard is cut by leading digits of the md5 into groups that fit a sort; a group's first slot is the sum
    of the counts before it, so no task sorts a whole shard, whatever its size.
    """
    docs = docs.drop(*COLUMNS[1:])
    md5, part, row, start = unused(docs, "md5", "part", "row", "start")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n_shards = sum(len(s) for r in tree.values() for s in r.values())
    digits, n = 1, docs.count()
    while n > n_shards * 16**digits * SLOT_GROUP_ROWS:
        digits += 1
    rows = docs.select(
        "*",
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(name, tree).alias("shard"),
        place(name, grown(tree)).alias("grown_shard"),
        F.md5(name.cast("binary")).alias(md5),
    ).withColumn(part, F.substring(md5, 1, digits))
    inside = W.partitionBy("shard", part).orderBy(md5, F.col(key), "text_crc32", "size")
    before = W.partitionBy("shard").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", part).agg(F.count("*").alias("n")).select("shard", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    placed = rows.withColumn(row, F.row_number().over(inside)).join(starts, ["shard", part])
    return placed.withColumn("slot", F.col(start) + F.col(row) - 1).select(*docs.columns, *COLUMNS[1:])


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The text is read for its size and checksum only; it does not travel with the ids.
    return shard(docs, tree_of(40)).select(*COLUMNS)


def _sql_level(key: str, at: str, options: list[tuple[str, float]]) -> str:
    draws = ", ".join(f"{{'d': ln((CAST(CAST('0x' || substr(md5({key} || '/{p}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / {w}, 'p': '{p}'}}" for p, w in options)
    return f"list_max([{draws}]).p"


def sql() -> str:
    """DuckDB SQL: one CASE a level; CRC-32 by its bitwise rule, a byte at a time, over a generated table."""

    def placed(tree: Tree, name: str) -> tuple[str, str, str]:
        mass = lambda t: sum(mass(x) if isinstance(x, dict) else x for x in t.values())
        region = _sql_level("k", "", [(r, mass(x)) for r, x in tree.items()])
        rack = "CASE " + " ".join(f"WHEN {name}_r = '{r}' THEN {_sql_level('k', r, [(f'{r}/{q}', mass(s)) for q, s in x.items()])}" for r, x in tree.items()) + " END"
        leaf = "CASE " + " ".join(f"WHEN {name}_k = '{r}/{q}' THEN {_sql_level('k', q, [(f'{r}/{q}/{i}', w) for i, w in s.items()])}" for r, x in tree.items() for q, s in x.items()) + " END"
        return region, rack, leaf

    a, b = placed(tree_of(40), "a"), placed(grown(tree_of(40)), "b")
    crc_step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    return f"""
WITH RECURSIVE bits(i, c, n) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, {crc_step}, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, k, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
  CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT) FOR i IN range(length(h) // 2)]),
    lambda c, x: xor(c >> 8, t[CAST(xor(c & 255::UBIGINT, x) AS BIGINT) + 1]))) AS BIGINT) AS text_crc32 FROM d, crc),
p0 AS (SELECT *, {a[0]} AS a_r, {b[0]} AS b_r FROM e),
p1 AS (SELECT *, {a[1]} AS a_k, {b[1]} AS b_k FROM p0),
p2 AS (SELECT *, {a[2]} AS a_s, {b[2]} AS b_s FROM p1),
p3 AS (SELECT *, CAST(string_split(a_s, '/')[3] AS INTEGER) AS shard, CAST(string_split(b_s, '/')[3] AS INTEGER) AS grown_shard FROM p2)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM p3
"""
