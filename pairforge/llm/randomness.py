"""Secret scan: known credential patterns, and a randomness test battery for the rest. Column functions only.

Candidates of the battery are runs of 20 or more key characters. Each gets an encoding (hex, base32,
base62, base64, base64url) from the characters that it holds, and three tests on its symbols' places in that alphabet:

* chi-squared of the symbol counts against a uniform alphabet,
* runs of one character class (digits, small letters, capitals, signs) against their number in uniform text,
* lag-1 serial correlation.

Each is turned round into a test whose null is "as uneven as text": words repeat letters, stay in
one part of the alphabet and follow each other, and those effects grow with length, so a long
random key is told from a long word better than a short one. Stouffer's rule joins the three. Within each
band of lengths a Benjamini-Hochberg threshold at rate q is found from a histogram of the
joint statistic over all candidates of the corpus (a bounded table: bands x bins), at bin edges, on the safe side.

Defined cases: a null or empty text has no spans, and the digest of the empty text; repeated rows get equal
results; without candidates no threshold is needed; rows are independent, so ids may be null or repeat; other
columns do not matter, those with the names of results are replaced; very long texts and runs are read whole, in time that grows with their length. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.tables import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Capitals before, between and after lower-case letters, each found at its first place: one pass over a run of any length.
TURNS = "^[^A-Z]*+[A-Z][^a-z]*+[a-z][^A-Z]*+[A-Z][^a-z]*+[a-z][^A-Z]*+[A-Z]"
KINDS = ["assign", "access", "hex", "random"]

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base32": UPPER + "234567",
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Under the null the squared unevenness (A * sum p^2 - 1), the serial correlation, and the share of the expected runs.
UNEVEN = {"hex": 0.5, "HEX": 0.5, "base32": 0.8, "base62": 2.0, "base64": 2.0, "base64url": 2.0}
SERIAL, RUNS = 0.4, 0.65
#: The chance that two symbols of an alphabet are of different classes.
SWITCH = {k: 1 - sum((sum(c in part for c in a) / len(a)) ** 2 for part in (DIGITS, LOWER, UPPER, "+/-_")) for k, a in ALPHABETS.items()}
#: First length of each band, the rate of false discoveries, and the bins of the statistic.
BANDS, RATE, BIN, TOP = [20, 24, 32, 48], 0.01, 0.05, 400
CHUNK = 256


def _hits(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, guard: str | None = None) -> Column:
    """array<struct<start, kind, end, value>> of all leftmost matches: gaps between matches come from a split."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int,value:string>>))")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        item = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    # Matches are put together CHUNK at a time, and the chunks then, so that a text of many matches does not copy all of them for each.
    first = F.expr("named_struct('at', 0, 'out', cast(array() as array<array<struct<start:int,kind:int,end:int,value:string>>>))")

    def chunk(acc: Column, xs: Column) -> Column:
        one = F.aggregate(xs, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return _let(one, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def chunks(all_: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        return F.transform(cuts, lambda c: F.slice(all_, c * CHUNK + 1, CHUNK))

    many = lambda all_: F.flatten(F.aggregate(chunks(all_), first, chunk, lambda acc: acc["out"]))
    found = _let(parts, lambda all_: F.when(F.size(all_) <= CHUNK, F.aggregate(all_, start, step, lambda acc: acc["out"])).otherwise(many(all_)))
    found = F.filter(found, lambda x: F.length(x["value"]) >= least) if least else found
    return F.when(text.rlike(guard or pattern), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    assign = _hits(text, ASSIGN, 0, group=2, least=6, guard="(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]")
    return F.array_sort(F.concat(assign, _hits(text, ACCESS, 1, guard="AKIA"), _hits(text, HEX, 2)))


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, value>>; text: no null."""
    return _hits(text, RUN, 3)


def _encoding(core: Column) -> Column:
    """The smallest alphabet that holds the run; null for words, plain numbers and mixed signs."""
    digit, lower, upper = core.rlike("[0-9]"), core.rlike("[a-z]"), core.rlike("[A-Z]")
    # A capital before lower-case letters is a word, not a mixture.
    mixed = (digit & (lower | upper)) | core.rlike(TURNS)
    return (
        F.when(core.rlike("^[0-9a-f]+$") & digit & lower, "hex")
        .when(core.rlike("^[0-9A-F]+$") & digit & upper, "HEX")
        .when(core.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(core.rlike("^[A-Za-z0-9]+$") & mixed, "base62")
        .when(core.rlike("^[A-Za-z0-9+/]+$") & mixed, "base64")
        .when(core.rlike("^[A-Za-z0-9_-]+$") & mixed, "base64url")
    )


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _neighbours(xs: Column, f) -> Column:
    return F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), f)


def statistic(value: Column) -> Column:
    """The joint statistic of a run, high for random ones; null for runs without an encoding."""
    lookup = lambda d, e: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), e)
    core = F.regexp_replace(value, "=+$", "")

    kind = lambda x: F.when(x.between("a", "z"), 1).when(x.between("A", "Z"), 2).when(x.between("0", "9"), 3).otherwise(4)

    def joint(enc: Column, chars: Column, at: Column) -> Column:
        size, n, uneven = F.length(lookup(ALPHABETS, enc)).cast("double"), F.size(at).cast("double"), lookup(UNEVEN, enc)
        squares = _sum(F.transform(F.array_distinct(at), lambda c: F.pow(F.size(F.filter(at, lambda x: x == c)).cast("double"), F.lit(2.0))))
        z_chi = (size - 1 + n * uneven - (size / n * squares - n)) / F.sqrt(2 * (size - 1 + 2 * n * uneven))
        serial = _let(_sum(at) / n, lambda mean: _let(F.transform(at, lambda x: x - mean), lambda dev: _sum(_neighbours(dev, lambda a, b: a * b)) / F.greatest(_sum(F.transform(dev, lambda x: x * x)), F.lit(1e-9))))
        switches = F.size(F.filter(_neighbours(F.transform(chars, kind), lambda a, b: a != b), lambda x: x)).cast("double")
        ratio = (switches + 1) / (1 + (n - 1) * lookup(SWITCH, enc))
        return (z_chi + (F.lit(SERIAL) - F.abs(serial)) * F.sqrt(n) + (ratio - F.lit(RUNS)) * F.sqrt(n)) / math.sqrt(3)

    places = lambda chars, enc: F.transform(chars, lambda x: F.instr(lookup(ALPHABETS, enc), x).cast("double"))
    tested = lambda chars, enc: _let(places(chars, enc), lambda at: joint(enc, chars, at))
    return _let(core, lambda c: _let(_encoding(c), lambda enc: F.when(enc.isNotNull(), _let(F.split(c, ""), lambda chars: tested(chars, enc)))))


def _band(value: Column) -> Column:
    return sum((F.length(F.regexp_replace(value, "=+$", "")) >= first).cast("int") for first in BANDS[1:])


def thresholds(histogram: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, float]:
    """(band, bin, count) of all candidates -> the least z that is a discovery, by band."""
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    out = {}
    for band in {b for b, _, _ in histogram}:
        counts = {k: n for b, k, n in histogram if b == band}
        m, above, found = sum(counts.values()), 0, math.inf
        for k in sorted(counts, reverse=True):
            above += counts[k]
            if m * tail(k * BIN) <= rate * above:
                found = k * BIN
        out[band] = found
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """docs with base_spans and all_spans (arrays of struct<start, kind, end, value>), spans, n_assign, n_access, n_hex, base_sha256.

    Two passes over the texts without a shuffle of them: the first fills the histogram, the second applies its thresholds.
    """
    docs = docs.drop("base_spans", "all_spans", "spans", "n_assign", "n_access", "n_hex", "base_sha256")  # replaced
    body = F.coalesce(F.col(text), F.lit(""))
    runs = docs.select(F.explode(candidates(body)).alias("_r")).select(F.col("_r.value").alias("value"))
    scored = runs.select(_band(F.col("value")).alias("band"), statistic(F.col("value")).alias("z")).where("z is not null")
    place = F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.floor(F.col("z") / BIN))).cast("int")
    # At most bands x bins rows come to the driver, whatever the size of the corpus.
    least = thresholds([tuple(r) for r in scored.groupBy("band", place.alias("bin")).agg(F.count("*").alias("n")).collect()], rate)
    bars = F.array(*[F.lit(float(least.get(i, math.inf))) for i in range(len(BANDS))])

    def kept(r: Column) -> Column:
        apart = ~F.exists("base_spans", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        bar = F.element_at(bars, _band(r["value"]) + 1)
        return apart & F.coalesce(statistic(r["value"]) >= bar, F.lit(False))

    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    out = docs.withColumn("base_spans", base_spans(F.col(text)))
    out = out.withColumn("all_spans", F.array_sort(F.concat("base_spans", F.filter(candidates(body), kept))))
    return out.withColumns({"n_assign": n(0), "n_access": n(1), "n_hex": n(2), "base_sha256": F.sha2(_joined(F.col("base_spans")), 256), "spans": _joined(F.col("all_spans"))})


def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def sql(rate: float = RATE) -> str:
    """DuckDB SQL: matches placed by the gaps between them, symbols of a run as rows, the normal tail by Simpson's rule on a grid."""
    either = lambda x: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x)
    assign = ASSIGN.replace("(?i:", "(?:").replace("password|passwd|secret|token|api_?key", either("password|passwd|secret|token|api_?key")).replace("'", "''")
    run = RUN.replace("(?<![A-Za-z0-9+/_-])", "")  # a greedy run begins after no key character anyway

    def hits(kind: int, pattern: str, value: str = "m") -> str:
        """Ids repeat at will: r tells rows apart."""
        matches = f"regexp_extract_all(text, '{pattern}')"
        return f"""
  SELECT r, {kind} AS kind, m, {value} AS value, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop
  FROM (SELECT r, unnest({matches}) AS m, unnest(string_split_regex(text, '{pattern}')[:len({matches})]) AS g, generate_subscripts({matches}, 1) AS i FROM docs)"""

    has = lambda x: f"regexp_matches(core, '{x}')"
    mixed = f"({has('[0-9]')} AND {has('[A-Za-z]')} OR {has('[A-Z].*[a-z].*[A-Z].*[a-z].*[A-Z]')})"
    whole = lambda x: f"regexp_full_match(core, '{x}')"
    encoding = f"""CASE WHEN {whole('[0-9a-f]+')} AND {has('[0-9]')} AND {has('[a-z]')} THEN 'hex' WHEN {whole('[0-9A-F]+')} AND {has('[0-9]')} AND {has('[A-Z]')} THEN 'HEX'
    WHEN {whole('[A-Z2-7]+')} AND {has('[0-9]')} AND {has('[A-Z]')} THEN 'base32' WHEN {whole('[A-Za-z0-9]+')} AND {mixed} THEN 'base62'
    WHEN {whole('[A-Za-z0-9+/]+')} AND {mixed} THEN 'base64' WHEN {whole('[A-Za-z0-9_-]+')} AND {mixed} THEN 'base64url' END"""
    alphabets = ", ".join(f"('{k}', '{a}', {float(len(a))}::DOUBLE, {UNEVEN[k]}::DOUBLE, {SWITCH[k]!r}::DOUBLE)" for k, a in ALPHABETS.items())
    band = " + ".join(f"CAST(length(core) >= {b} AS INTEGER)" for b in BANDS[1:])
    bell = lambda x: f"exp(-({x}) * ({x}) / 2)"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop), '')"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (SELECT r, kind, stop - length(m) AS start, stop FROM (
{hits(0, assign, f"regexp_extract(m, '{assign}', 2)")} UNION ALL {hits(1, ACCESS)} UNION ALL {hits(2, HEX)}) WHERE kind > 0 OR length(value) >= 6),
runs AS MATERIALIZED (SELECT *, row_number() OVER () AS c FROM (SELECT *, {encoding} AS enc, {band} AS band FROM (
  SELECT r, kind, stop - length(m) AS start, stop, regexp_replace(m, '=+$', '') AS core FROM ({hits(3, run)}))) WHERE enc IS NOT NULL),
alphabets(enc, symbols, size, uneven, switch) AS (VALUES {alphabets}),
chars AS (SELECT c, unnest(string_split(core, '')) AS x, generate_subscripts(string_split(core, ''), 1) AS i FROM runs),
places AS (SELECT c, x, i, CAST(instr(symbols, x) AS DOUBLE) AS place,
  CASE WHEN x BETWEEN 'a' AND 'z' THEN 1 WHEN x BETWEEN 'A' AND 'Z' THEN 2 WHEN x BETWEEN '0' AND '9' THEN 3 ELSE 4 END AS class FROM chars JOIN runs USING (c) JOIN alphabets USING (enc)),
counts AS (SELECT c, sum(k * k)::DOUBLE AS squares FROM (SELECT c, x, count(*) AS k FROM places GROUP BY c, x) GROUP BY c),
devs AS (SELECT *, place - avg(place) OVER (PARTITION BY c) AS dev FROM places),
steps AS (SELECT c, dev, lag(dev) OVER w AS dev0, class <> lag(class) OVER w AS switched FROM devs WINDOW w AS (PARTITION BY c ORDER BY i)),
sums AS (SELECT c, count(*)::DOUBLE AS n, coalesce(sum(dev * dev0), 0) / greatest(sum(dev * dev), 1e-9) AS serial, (count(*) FILTER (switched))::DOUBLE AS switches FROM steps GROUP BY c),
scored AS MATERIALIZED (SELECT r, kind, start, stop, band, ((size - 1 + n * uneven - (size / n * squares - n)) / sqrt(2 * (size - 1 + 2 * n * uneven))
  + ({SERIAL}::DOUBLE - abs(serial)) * sqrt(n) + ((switches + 1) / (1 + (n - 1) * switch) - {RUNS}::DOUBLE) * sqrt(n)) / sqrt(3::DOUBLE) AS z
  FROM runs JOIN alphabets USING (enc) JOIN counts USING (c) JOIN sums USING (c)),
grid AS (SELECT i, sum(({bell('i / 200.0::DOUBLE')} + 4 * {bell('(i + 0.5::DOUBLE) / 200')} + {bell('(i + 1) / 200.0::DOUBLE')}) / 1200 / sqrt(2 * pi())) OVER (ORDER BY i DESC) AS tail
  FROM range({-TOP * 10}, {TOP * 20}) g(i)),
bins AS (SELECT band, k, sum(n) OVER (PARTITION BY band) AS m, sum(n) OVER (PARTITION BY band ORDER BY k DESC) AS above FROM (
  SELECT band, greatest({-TOP}, least({TOP}, CAST(floor(z / {BIN}::DOUBLE) AS INTEGER))) AS k, count(*) AS n FROM scored GROUP BY band, k)),
bars AS (SELECT band, min(k) * {BIN}::DOUBLE AS bar FROM bins JOIN grid ON grid.i = 10 * k WHERE m * tail <= {rate} * above GROUP BY band),
found AS (SELECT r, kind, start, stop FROM scored s JOIN bars USING (band) WHERE z >= bar
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s.stop AND s.start < b.stop)),
of_base AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed} AS base FROM base GROUP BY r),
of_all AS (SELECT r, {listed} AS spans FROM (FROM base UNION ALL FROM found) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN of_base USING (r) LEFT JOIN of_all USING (r)
"""
