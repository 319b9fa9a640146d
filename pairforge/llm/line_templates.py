"""Line dedup by a log-template tree of fixed depth. DataFrame and SQL functions only.

A line is trimmed and cut at spaces; tokens that hold a digit become <*>. The tree's path to a leaf is the token count, then the
first DEPTH tokens. A line weighs as many different texts as hold it, and recurs if they reach its bar: as many texts as hold WEIGHT
tokens of it together, LEAST_TEXTS at least, so the longer a line, the fewer texts. In a leaf, lines that do not recur as they are get a template: a token stays if lines of its leaf
that hold it at its place reach the bar together, any other becomes <*>. So a leaf makes as many templates as it has messages, and a line
always matches its own. A template in which fewer than SIMILAR percent of the tokens stay is void; others recur if different texts with lines of that template reach the bar.
Lines that recur, as they are or by their template, are dropped from every document. Copies of one text count once, so a copied document
does not lose its lines for being copied. A field's value that itself reaches the bar in its leaf makes a template of its own.

Lines are told apart by two 64-bit hashes and their token count, texts by a hash and their length. Defined cases: null texts stay null with no lines; blank lines, and lines of
<*> only, are kept; repeated rows are treated alike; ids may be null or repeat, as documents are told apart by their texts; very long texts and lines are
read whole, in time that grows with their length; columns with the names of results are replaced, others stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.tables import meet, table, unused
from pairforge.plans.joins import salted_join
from pairforge.plans.scratch import Scratch

DEPTH, SIMILAR = 3, 70
#: A line recurs in as many different texts as give this many tokens together, in LEAST_TEXTS at least.
WEIGHT, LEAST_TEXTS = 40, 2


def masked(text: Column) -> Column:
    """Tokens that hold a digit as <*>, in all lines of a text at once."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, "(?<![^ \\n])[^ \\n0-9]*+[0-9][^ \\n]*+", "<*>")).otherwise(text)


def _constant(template: Column) -> Column:
    """Whether it holds more than variable fields."""
    return F.when(F.contains(template, F.lit("<*>")), F.trim(F.replace(template, F.lit("<*>"), F.lit(""))) != "").otherwise(template != "")


def _bar(k: Column, weight: int) -> Column:
    """How many different texts a line of k tokens has to recur in."""
    return F.greatest(F.lit(LEAST_TEXTS), F.floor((F.lit(weight - 1) + k) / k)).cast("int")


def _copy(text: Column) -> Column:
    """What tells texts apart: a 64-bit hash and the length."""
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(copy, pos, masked, m, leaf, k) of lines that may recur. leaf, k and m, the hashes of the path and of the line, tell lines apart."""
    lines = docs.select(_copy(F.col(text)).alias("copy"), F.posexplode(F.split(masked(F.col(text)), "\n")).alias("pos", "line"))
    lines = lines.select("copy", "pos", F.btrim("line", F.lit(" \t\r")).alias("masked")).where(_constant(F.col("masked")))
    k = F.size(F.split("masked", " "))
    return lines.select("copy", "pos", "masked", F.xxhash64("masked").alias("m"), F.xxhash64(F.substring_index("masked", " ", DEPTH)).alias("leaf"), k.alias("k"))


LINE = ["leaf", "k", "m"]


def recurring(docs: DataFrame, lines: DataFrame, scratch: Scratch, text: str = "text", weight: int = WEIGHT) -> DataFrame:
    """(leaf, k, m, template: null if the line recurs as it is, n_texts) of every line that recurs.

    lines: those of docs without masked, as drop_templates keeps them. Only lines that need a template are read as texts again.
    """
    bar = _bar(F.col("k"), weight)
    own = scratch.keep(lines.select(*LINE, "copy").distinct().groupBy(*LINE).agg(F.count("*").alias("n")))
    rest = own.where(F.col("n") < bar)
    # A leaf that all these lines together leave short of its bar has no template.
    leaves = rest.groupBy("leaf", "k").agg(F.sum("n").alias("w"), F.count("*").alias("kinds")).where((F.col("w") >= bar) & (F.col("kinds") > 1))
    near = scratch.keep(meet(rest, scratch.keep(leaves.select("leaf", "k")), ["leaf", "k"]))
    near = scratch.keep(meet(lines_of(docs, text).select(*LINE, "masked"), near, LINE).groupBy(*LINE).agg(F.first("masked").alias("masked"), F.first("n").alias("n")))
    tokens = near.select(*LINE, "n", F.posexplode(F.split("masked", " ")).alias("pos", "token")).withColumn("at", F.xxhash64("leaf", "k", "pos", "token"))
    stay = scratch.keep(tokens.groupBy("at").agg(F.sum("n").alias("w"), F.first("k").alias("k")).where(F.col("w") >= bar).select("at", F.lit(1).alias("same")))
    words = meet(tokens, stay, ["at"], "left")
    word = F.struct("pos", F.when(F.col("same") == 1, F.col("token")).otherwise("<*>").alias("word"))
    shaped = words.groupBy(*LINE, "n").agg(F.count("same").alias("same"), F.array_sort(F.collect_list(word)).alias("words"))
    named = shaped.where(F.lit(100) * F.col("same") >= SIMILAR * F.col("k")).select(*LINE, "n", F.concat_ws(" ", F.transform("words", lambda x: x["word"])).alias("template"))
    named = scratch.keep(named.where(_constant(F.col("template"))).withColumn("t", F.xxhash64("template")))
    # A text may hold several lines of one template; it counts once.
    bound = named.groupBy("leaf", "k", "t").agg(F.sum("n").alias("most")).where(F.col("most") >= bar).select("leaf", "k", "t")
    named = scratch.keep(salted_join(named, bound, ["leaf", "k", "t"]))
    exact = meet(lines.select(*LINE, "copy"), named.select(*LINE, "t"), LINE).select("leaf", "k", "t", "copy").distinct().groupBy("leaf", "k", "t").agg(F.count("*").alias("n_texts"))
    found = salted_join(named, exact.where(F.col("n_texts") >= bar), ["leaf", "k", "t"]).select(*LINE, "template", "n_texts")
    as_is = own.where(F.col("n") >= bar).select(*LINE, F.lit(None).cast("string").alias("template"), F.col("n").alias("n_texts"))
    return scratch.keep(as_is.unionByName(found))


def drop_templates(docs: DataFrame, text: str = "text", weight: int = WEIGHT) -> DataFrame:
    """docs with the recurring lines cut out of text; adds, or replaces, n_lines and n_dropped (long)."""
    docs = docs.drop("n_lines", "n_dropped")
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(lines_of(docs, text).drop("masked"))
    bad = recurring(docs, lines, scratch, text, weight)
    # Lines meet the recurring ones by hash: a line's text does not travel.
    copy, dropped = unused(docs, "copy", "dropped")
    hit = meet(lines.select("copy", "pos", *LINE), bad.select(*LINE), LINE).select("copy", "pos")
    gone = hit.groupBy("copy").agg(F.collect_set("pos").alias(dropped)).withColumnRenamed("copy", copy)
    joined = salted_join(docs.withColumn(copy, _copy(F.col(text))), gone, [copy], "left", hint="merge").drop(copy)
    parts, gone = F.split(text, "\n"), F.coalesce(dropped, F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)  # by hashing, so in linear time
    kept = F.concat_ws("\n", F.element_at(F.transform(F.array(parts), lambda all_: F.transform(left, lambda i: all_[i])), 1))
    return joined.withColumns(
        {
            text: F.when(F.col(dropped).isNull(), F.col(text)).otherwise(kept),
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"),
            "n_dropped": F.size(gone).cast("long"),
        }
    ).drop(dropped)


def op3_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    bar = f"greatest({LEAST_TEXTS}, ({WEIGHT - 1} + k) // k)"
    constant = lambda x: f"trim(replace({x}, '<*>', '')) <> ''"
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l0 AS (SELECT DISTINCT text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
l1 AS (SELECT text, pos, regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l0),
l AS (SELECT text, pos, masked, string_split(masked, ' ') AS toks, len(toks) AS k, toks[1:{DEPTH}] AS lead FROM l1 WHERE {constant("masked")}),
own AS (SELECT masked, toks, k, lead, count(DISTINCT text) AS n FROM l GROUP BY ALL),
w AS (SELECT masked, k, lead, n, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM own WHERE n < {bar}),
stay AS (SELECT k, lead, pos, token, 1 AS same FROM w GROUP BY k, lead, pos, token HAVING sum(n) >= {bar}),
named AS (SELECT masked, k, string_agg(CASE WHEN same = 1 THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS template
  FROM w LEFT JOIN stay USING (k, lead, pos, token) GROUP BY masked, k HAVING 100 * count(same) >= {SIMILAR} * k),
t AS (SELECT k, template FROM named JOIN l USING (masked, k) WHERE {constant("template")} GROUP BY k, template HAVING count(DISTINCT text) >= {bar}),
bad AS (SELECT masked FROM own WHERE n >= {bar} UNION SELECT masked FROM named JOIN t USING (k, template)),
g AS (SELECT text, list(pos) AS gone FROM l WHERE masked IN (SELECT masked FROM bad) GROUP BY text)
SELECT d.doc_id, CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string([d.parts[i] FOR i IN range(1, len(d.parts) + 1) IF NOT list_contains(g.gone, i)], chr(10)) END AS text,
  CAST(coalesce(len(d.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN g ON d.text = g.text
"""
