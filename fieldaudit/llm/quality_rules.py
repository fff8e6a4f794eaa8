"""Operator 8: line-first cleaning, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import SPACE, free

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: White space between words, for translate().
BLANK = " \t\n\x0b\x0c\r"
#: Phrases of site boilerplate, in lower case.
BOILERPLATE = (
    "we use cookies", "accept cookies", "accept all cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "javascript is disabled", "enable javascript", "subscribe to our", "click here", "share this", "skip to main content", "back to top", "lorem ipsum",
)
#: Marks between the entries of a navigation line.
SEPARATORS = "|\u00bb\u203a\u2022\u00b7"
MIN_WORDS, REPEAT_PCT, LOST_PCT = 50, 50, 50


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a name inside the expression, which Spark doesn't paste in again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more. Windows are sorted by hash, and those of equal hash by their words, so the work
    is n log n however much repeats and windows of different words never count as equal."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def twice(order: Column, by: str) -> Column:
        """The entries whose neighbour has an equal value of by."""
        same = lambda x, i: F.coalesce(F.get(order, i)[by] == x[by], F.lit(False))
        return F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1))

    def spelled(order: Column) -> Column:
        gram = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2))
        return F.sort_array(F.transform(twice(order, "h"), lambda x: F.struct(gram(x["i"]).alias("g"), x["i"].alias("i"))))

    def marked(order: Column) -> Column:
        return _let(F.sort_array(F.transform(twice(order, "g"), lambda x: x["i"])), covered)

    def found(h: Column) -> Column:
        heavy = _let(_let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spelled), marked)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(heavy)

    runs = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(runs, found)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line goes. Punctuation: a mark such as ### or !! ends at least three words in ten. Navigation: three separators or more,
    and one for five other words or fewer. Boilerplate: a phrase of BOILERPLATE that is a quarter of the line or more, so that a sentence
    which names one stays. The words are only counted where a cheap count of characters leaves the rule open."""
    among = lambda chars: F.length(line) - F.length(F.translate(line, chars, ""))
    n = F.size(F.split(F.btrim(line, F.lit(BLANK)), f"[{SPACE}]+"))
    marks = F.regexp_count(line, F.lit(rf"(?:[#*$%&]{{2,}}|!{{2,}})(?=[{SPACE}]|$)"))
    bars = among(SEPARATORS)
    return (
        F.when(F.length(line) <= 4 * max(map(len, BOILERPLATE)), _let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(p) & (F.length(line) <= 4 * len(p)) for p in BOILERPLATE])))
        .otherwise(F.lit(False))
        | F.when(bars >= 3, 5 * bars >= n - bars).otherwise(F.lit(False))
        | F.when(among("#*$%&!") >= 2, 10 * marks >= 3 * n).otherwise(F.lit(False))
    )


def judge(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, lost_chars, cleaned, kept.

    cleaned is the text without the lines that fail (see line_fails); kept is false where the base rules fail or the lines removed hold
    more than LOST_PCT per cent of the characters in words. Null and empty texts have zero counts, an empty cleaned text and are not kept.
    Other columns pass through; a column of docs that has the name of a result is replaced. Rows are judged alone: no shuffle, no state.
    """
    blank = lambda c: F.translate(c, BLANK, "")
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))
    both = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))


    def cleaned(lines: Column) -> Column:
        full = _let(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        good = F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~line_fails(x))
        return _let(good, lambda x: F.struct(F.array_join(x, "\n").alias("text"), (F.size(lines) - F.size(x)).cast("long").alias("bad"), full.cast("long").alias("dup")))

    counted, clean = free(docs.columns, "counted", "clean")
    out = docs.withColumns({
        counted: both,
        clean: _let(F.split(text, "\n"), cleaned),
        "word_chars": F.length(blank(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    out = out.withColumns({"n_words": F.col(f"{counted}.n"), "n_repeat_words": F.col(f"{counted}.r"), "cleaned": F.col(f"{clean}.text"), "n_lines_removed": F.col(f"{clean}.bad"), "n_dup_lines": F.col(f"{clean}.dup")})
    out = out.withColumn("lost_chars", F.when(F.col("n_lines_removed") == 0, F.lit(0)).otherwise(F.col("word_chars") - F.length(blank(F.col("cleaned")))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOST_PCT * F.col("word_chars"))).drop(counted, clean)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that are kept, with their cleaned texts; n_chars, where there is one, follows the text. Columns of any names pass through."""
    out = judge(docs.select("text", F.struct(*docs.columns).alias("row"))).where("kept")
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l FROM d),
t AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g
      FROM w WHERE len(w) >= 3),
m AS (SELECT rid, i FROM t QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM m, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
x AS (SELECT rid, unnest(l) AS line FROM w),
y AS (SELECT rid, line, len(regexp_extract_all(line, '[^{SPACE}]+')) AS n, len(regexp_replace(line, '[{SPACE}]+', '', 'g')) AS chars,
             len(regexp_extract_all(line || ' ', '(?:[#*$%&]{{2,}}|!{{2,}})[{SPACE}]')) AS marks, len(line) - len(translate(line, '{SEPARATORS}', '')) AS bars, len(line) AS long FROM x),
z AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, sum(chars) AS chars, count(*) FILTER (n > 0 AND bad) AS removed,
             coalesce(sum(chars) FILTER (n > 0 AND bad), 0) AS lost
      FROM (SELECT *, (marks > 0 AND 10 * marks >= 3 * n) OR (bars >= 3 AND 5 * bars >= n - bars) OR {" OR ".join(f"(contains(lower(line), '{p}') AND long <= {4 * len(p)})" for p in BOILERPLATE)} AS bad FROM y)
      GROUP BY rid),
a AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(z.chars AS BIGINT) AS word_chars,
             CAST(len(w.text) - len(translate(w.text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(z.dup AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(z.removed AS BIGINT) AS n_lines_removed, CAST(z.lost AS BIGINT) AS lost_chars
      FROM w JOIN z USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= {LOST_PCT} * word_chars AS kept, n_lines_removed, lost_chars
FROM b
"""
