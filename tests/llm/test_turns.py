"""Repair of conversations against all edits of short ones, and against SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from pairforge.llm import turn_repair
from tests.sides import duck, rows_of

ROWS = "conv_id long, turn long, role string, text string"
WHOLE, PART = re.compile("(s?(ua)+)?"), re.compile("(s?(ua)*u?)?")


def after_damage(rows):
    """conv_id -> rows (turn, role, text) in order, as the contract words it."""
    out = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out.setdefault(c, []).extend([(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        found = re.findall("[^\\x20\\x09-\\x0D]", text)
        out.append(1 if not found else 2 if any(r[1:] == (role, text) for r in rows[:i]) else 3 if found[-1] not in ".!?" else 0)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying all edits."""
    kind, best = faults(rows), [(10**9, "", [])]

    def go(i, cost, audit, roles, lines, inserts):
        if cost > best[0][0] or not PART.fullmatch(roles):
            return
        if i == len(rows) and WHOLE.fullmatch(roles) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, lines)
        if inserts < 3:
            for r in ("user", "assistant"):
                go(i, cost + 3, audit + "I", roles + r[0], [*lines, f"{r}:"], inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            if kind[i] not in (1, 2):
                late = 3 * (kind[i] == 3)
                go(i + 1, cost + late, audit + "K", roles + (role[:1] or "?"), [*lines, f"{role}:{text}"], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 3 + late, audit + "R", roles + r[0], [*lines, f"{r}:{text}"], 0)
            go(i + 1, cost + 4, audit + "D", roles, lines, 0)

    go(0, 0, "", "", [], 0)
    return best[0]


def expected(rows):
    out = {}
    for c, kept in after_damage(rows).items():
        turns, kind, initials = [t for t, _, _ in kept if t is not None], faults(kept), [r[1][:1] for r in kept]
        cost, audit, lines = cheapest(kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[c] = (gaps, *(kind.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def invented(n, seed, most=6):
    draw = random.Random(seed)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None], ["Well.", "No!", "so", "", " \n\x0b", "x", None, "\xa0", "Why? ", "a.b"]
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, most)):
            rows.append((c, draw.choice([t, t, t, t * 3, None]), draw.choice(roles[: draw.choice([4, 8])]), draw.choice(texts)))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Oh."), (2**60 + 1, 2**60, "user", "a."), (2**60 + 2, 2**60 + 5, "user", "b."), (2**60 + 2, 2**60 + 7, "assistant", "b.")]


@pytest.fixture(scope="module")
def report(spark):
    rows = invented(400, 1)
    got = turn_repair.repair_report(turn_repair.damage(spark.createDataFrame(rows, ROWS).repartition(3)))
    return rows, {r.conv_id: tuple(r[1:]) for r in got.collect()}


def test_reports_equal_all_edits(report):
    rows, got = report
    want = expected(rows)
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in got if got[c] != want[c]} == {}


def test_sql_equals_the_query(spark, tmp_path):
    for name, rows in (("rows", invented(150, 2)), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows, ROWS).write.parquet(f"{folder}/conversations.parquet")
        got = turn_repair.op12_turn_repair(spark, str(folder))
        assert got.count() == len({r[0] for r in rows})
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
        wanted = con.execute(turn_repair.sql())
        assert [d[0] for d in wanted.description] == got.columns
        assert sorted(map(str, wanted.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert rows_of(turn_repair.op12_turn_repair(spark, folder).toPandas()) == rows_of(duck(turn_repair.sql(), folder))


def test_repaired_rows_make_the_digest_and_keep_the_grammar(spark):
    rows = turn_repair.damage(spark.createDataFrame(invented(100, 3), ROWS).selectExpr("*", "'x' AS fault", "'y' AS same", "1 AS edit"))
    report = {r.conv_id: r for r in turn_repair.repair_report(rows).collect()}
    lines = {}
    for r in turn_repair.repaired(rows).orderBy("conv_id", "position").collect():
        lines.setdefault(r.conv_id, []).append(r)
    for c, r in report.items():
        mine = lines.get(c, [])
        assert [x.position for x in mine] == list(range(len(mine)))
        assert "".join(x.edit for x in mine) == r.audit.replace("D", "") and WHOLE.fullmatch("".join(x.role[0] for x in mine))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256


def test_a_conversation_over_many_batches_spills_and_equals_the_one_in_memory(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(7, t, draw.choice(["user", "assistant", "tool"]), f"text {draw.randint(0, 3000)}{draw.choice(['.', '!', ''])}") for t in range(8000)]
    rows += [(8, 0, "user", "One."), (8, 1, "assistant", "Two.")]
    df = turn_repair.damage(spark.createDataFrame(rows, ROWS))
    whole = sorted(turn_repair.repair_report(df).collect())
    steps = turn_repair.Steps()
    inside = turn_repair.Conversation("7", steps)
    for r in turn_repair._streamed(df.where("conv_id = 7")).collect():
        inside.add(int(r.turn), r.role, r.text, r.fault, r.copies)
    monkeypatch.setattr(turn_repair, "SPILL_ROWS", 700)
    spilled = turn_repair.Conversation("7", steps)
    for r in turn_repair._streamed(df.where("conv_id = 7")).collect():
        spilled.add(int(r.turn), r.role, r.text, r.fault, r.copies)
        assert len(spilled.rows) <= 702
    assert spilled.rows_file is not None and len(steps.states) < 200
    assert spilled.report() == inside.report() == ("7", *whole[0][1:])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        assert sorted(turn_repair.repair_report(df).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_shuffle(spark):
    plan = turn_repair._streamed(turn_repair.damage(spark.createDataFrame(invented(5, 5), ROWS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


def test_very_long_texts(spark):
    rows = [(1, 0, "user", " " * 300_000 + "x" + " " * 300_000), (1, 1, "assistant", "?" + "\t" * 300_000), (2, 0, "user", "\n" * 300_000)]
    got = {r.conv_id: r for r in turn_repair.repair_report(spark.createDataFrame(rows, ROWS)).collect()}
    assert (got[1].audit, got[1].cost, got[1].truncated) == ("KK", 3, 1) and (got[2].audit, got[2].blank) == ("D", 1)
