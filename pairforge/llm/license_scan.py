"""Licence scan by canonical digests.

A text is put in canonical form (lower case; copyright lines out; every run of characters other than letters and digits is
one space; equivalent spellings made equal) and hashed, a whole text with SHA-256, a line with a 64-bit hash. Whole documents and whole lines are hash-joined
to the digests of known whole texts. The known table is small by nature (a row for each licence text), and
is left to Spark to broadcast or shuffle by its size.

Defined cases: null texts, and texts without a letter or digit, have a null digest and no licence; two known texts with one
canonical form give the smaller license_id; repeated rows get equal results; very long texts are read
whole; columns with the names of results are replaced, others stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.licenses import EQUIVALENT, KNOWN, more_whole_texts
from pairforge.llm.tables import table, unused
from pairforge.plans.joins import salted_join
from pairforge.plans.scratch import Scratch

COPYRIGHT = "copyright (?:\\(c\\)|[0-9]{4})|\\(c\\) [0-9]{4}|all rights reserved"
#: Lines that begin with the word or the sign and go on to a year or a name. A licence's own lines may be
#: broken before "copyright notice" or "copyright holders", and (c) may number a clause, so these words, and (c) without a year, are no names.
#: Repetitions are possessive: they take no time by going back, and no stack.
NO_NAME = "notices?|holders?|owners?|laws?|licen[cs]e[sd]?|and|or|in|of|is|are|on|to|as|a(?!\\.)|an|any|this|that|which|if|be|it|for|from|with|under|shall|may|must|will|has|interests?|statements?|protection|acts?|treaty|treaties|disclaimers?|information|permissions?|claims?|grants?|infringements?|status|material|works?|line|page|year"
HEAD, BETWEEN = "^[^\\p{L}\\p{N}(©]*", "(?:copyright|©)(?:[\\s:,©]|\\(c\\))*"
HOLDER = f"{HEAD}+(?:{BETWEEN}+(?:[0-9]{{4}}|(?!(?:{NO_NAME})\\b)\\p{{L}})|\\(c\\).*\\b[0-9]{{4}}\\b)"


def _line(line: Column) -> Column:
    """A lower-case line without other signs than letters and digits; nothing of a copyright line."""
    return F.when(line.rlike(COPYRIGHT) | (line.rlike("copyright|©|\\(c\\)") & line.rlike(HOLDER)), "").otherwise(F.trim(F.regexp_replace(line, "[^\\p{L}\\p{N}]+", " ")))


def _rule(found: str, put: str):
    # Few texts hold the letters that a rule begins with, and a search for fixed letters is cheap.
    start = found.split("(")[0].split("[")[0]
    return lambda p: F.when(F.contains(p, F.lit(start)), F.regexp_replace(p, f"\\b{found}\\b", put)).otherwise(p)


def _respelt(plain: Column) -> Column:
    for found, put in EQUIVALENT:
        plain = F.element_at(F.transform(F.array(plain), _rule(found, put)), 1)  # a name for the text so far, which a rule uses three times
    return plain


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), "\n"), _line)


def canonical(lines: Column) -> Column:
    """The canonical text of canonical lines."""
    return _respelt(F.concat_ws(" ", F.filter(lines, lambda x: x != "")))


def known_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, line_key, license_id), one row a canonical text; line_key is null for texts of several lines."""
    rows = spark.createDataFrame(known if known is not None else KNOWN + more_whole_texts(), "license_id string, text string").select("license_id", canonical(canonical_lines(F.col("text"))).alias("c"))
    rows = rows.where("c != ''").groupBy("c").agg(F.min("license_id").alias("license_id"))
    return rows.select(F.unhex(F.sha2("c", 256)).alias("digest"), F.xxhash64("c").alias("line_key"), "license_id")


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """docs with text replaced by digest (hex), license_id (of the whole text), notices (array<struct<license_id, n>>: whole lines) and n_notices.

    Texts are read once, for a 256-bit digest of the whole and a 64-bit key of every line; they do not travel. Line hits are
    keyed by the text's hash and length, so copies of a text share one set of hits.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("digest", "license_id", "notices", "n_notices")  # columns of these names are replaced
    h, n, l = unused(docs, "h", "n", "l")  # noqa: E741
    read = docs.select(*[c for c in docs.columns if c != text], F.xxhash64(text).alias(h), F.length(text).alias(n), canonical_lines(F.col(text)).alias(l))
    c = canonical(F.col(l))
    hashed = F.transform(F.array(c), lambda x: F.when(x != "", F.unhex(F.sha2(x, 256))))
    read = read.withColumn("digest", F.element_at(hashed, 1)).withColumn(l, F.transform(l, lambda x: F.when(x != "", F.xxhash64(_respelt(x)))))
    read = scratch.keep(read)
    lines = read.select(h, n, F.posexplode(l).alias("pos", "line_key")).where("line_key is not null")
    hits = lines.join(known.select("line_key", "license_id"), "line_key").select(h, n, "pos", "license_id").distinct()
    hits = hits.groupBy(h, n, "license_id").agg(F.count("*").alias("times")).groupBy(h, n).agg(F.array_sort(F.collect_list(F.struct("license_id", F.col("times").alias("n")))).alias("notices"))
    whole = read.drop(l).join(known.select("digest", "license_id"), "digest", "left").withColumn("digest", F.lower(F.hex("digest")))
    found = salted_join(whole, hits, [h, n], "left").drop(h, n)
    found = found.withColumn("notices", F.coalesce("notices", F.array().cast("array<struct<license_id:string,n:long>>")))
    return found.withColumn("n_notices", F.size("notices").cast("long"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, known_table(spark))
    notices = F.concat_ws(",", F.transform("notices", lambda x: F.concat_ws(":", x["license_id"], x["n"].cast("string"))))
    return found.select("doc_id", "digest", "license_id", notices.alias("notices"), "n_notices")


def sql(known: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL with the same texts and rules. Its expressions know no look-ahead, so a name that is none is a second test."""

    def canon(x: str) -> str:
        no_name = NO_NAME.replace("a(?!\\.)", "a(?:[^.\\w]|$)")
        starts = lambda y: f"regexp_matches(x, '{HEAD}{y}')"
        holder = f"({starts(BETWEEN + '[0-9]{4}')} OR ({starts(BETWEEN + chr(92) + 'p{L}')} AND NOT {starts(BETWEEN + f'(?:{no_name})' + chr(92) + 'b')}) OR {starts(chr(92) + '(c' + chr(92) + ').*' + chr(92) + 'b[0-9]{4}' + chr(92) + 'b')})"
        line = f"CASE WHEN regexp_matches(x, '{COPYRIGHT}') OR {holder} THEN '' ELSE trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END"
        out = f"array_to_string(list_filter(list_transform(string_split(lower({x}), chr(10)), lambda x: {line}), lambda x: x <> ''), ' ')"
        for found, put in EQUIVALENT:
            out = f"regexp_replace({out}, '\\b{found}\\b', '{put.replace('$', chr(92))}', 'g')"
        return out

    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in (known if known is not None else KNOWN + more_whole_texts()))
    return f"""
WITH k0 AS (SELECT license_id, {canon("text")} AS c FROM (VALUES {values}) v(license_id, text)),
k AS (SELECT sha256(c) AS digest, min(license_id) AS license_id FROM k0 WHERE c <> '' GROUP BY 1),
t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, {canon("line")} AS c FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM t)),
h AS (SELECT text, license_id, count(*) AS n FROM l JOIN k ON sha256(l.c) = k.digest WHERE l.c <> '' GROUP BY ALL),
g AS (SELECT text, string_agg(license_id || ':' || n, ',' ORDER BY license_id) AS notices, CAST(count(*) AS BIGINT) AS n_notices FROM h GROUP BY text),
w AS (SELECT text, {canon("text")} AS c FROM t)
SELECT d.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, k.license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM documents d LEFT JOIN w ON d.text = w.text LEFT JOIN k ON k.digest = CASE WHEN c <> '' THEN sha256(c) END LEFT JOIN g ON g.text = d.text
"""
