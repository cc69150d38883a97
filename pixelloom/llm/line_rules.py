"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: too few words, or too many words inside 5-word
windows that the text repeats. The cross-document rule finds boilerplate: lines
are normalised (lower case, digits as 0, white space as one space) and hashed,
distinct documents are counted for each (host, line), and a line that more than
``max_docs`` documents of its host hold is removed, however large the host: what a
host's pages have in common is its furniture, whether it has a hundred pages or
a billion. A document that loses more than ``max_removed`` of its words is depleted
and rejected; the others are returned without those lines.

Counts and line hashes of each text are written to the shared folder; the texts
themselves are read once more where the cleaned text is asked for. Counts are
partial aggregates, so a line that a third of all documents share costs one row
for each task, and the lines above the limit meet the others in a join with one
row for each (host, line) on its side, the hottest of them broadcast.

Defined results: null texts have no words and fail; their cleaned text is empty.
A null host is a host of its own. Each row counts as a document, repeated rows
too. Very long texts are read whole. Further columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

GRAM = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{shared.SPACE}+"), lambda w: w != "")


def _covered(grams: Column) -> Column:
    """Words under those of the ``GRAM``-word windows with the given hashes that occur twice or more."""

    def positions(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x["p"]))

    def width(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get(at, i + 1) - p, F.lit(GRAM))).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(let(ordered, positions), width)


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``GRAM`` words that occur twice or more in the text."""
    window = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)]))
    grams = let(F.transform(words, lambda w: F.xxhash64(w)), window)
    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(g)))
    return F.when(F.size(words) >= GRAM, some).otherwise(F.lit(0).cast("long"))


def normal_lines(text: Column) -> Column:
    """The normalised lines that have a word, as (hash, words, number of the line)."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")
    lines = F.transform(F.split(flat, "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("at")))
    # one space between two words
    n = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int")
    return F.transform(F.filter(lines, lambda x: x["x"] != ""), lambda x: F.struct(F.xxhash64(x["x"]).alias("h"), n(x["x"]).alias("n"), x["at"].alias("at")))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Base metrics and normalised lines of every row."""
    text = F.coalesce(shared.field(text_col).cast("string"), F.lit(""))
    host = shared.field(host_col).cast("string")
    rows = shared.boxed(docs).select("_row", shared.field(id_col).alias("id"), host.isNull().alias("no_host"), F.coalesce(host, F.lit("")).alias("host"), text.alias("text"))
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(shared.NOT_SPACE))
    return rows.withColumn("words", words_of(F.col("text"))).select(
        "_row",
        "id",
        "no_host",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{shared.SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        normal_lines(F.col("text")).alias("lines"),
    )


LINE = ["no_host", "host", "h"]


def removed_lines(rows: DataFrame, max_docs: int) -> DataFrame:
    """(_row, n_removed_words, gone): the words and the numbers, in order, of each row's
    lines above the limit. ``rows`` has host and lines."""
    once = rows.select("no_host", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    common = shared.cut(once.groupBy(*LINE).agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs), "frequent")
    lines = rows.select("_row", "no_host", "host", F.explode("lines").alias("x")).select("_row", "no_host", "host", "x.h", "x.n", "x.at")
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    hit = shared.join_side(lines, common, LINE, "docs", total)
    return hit.groupBy("_row").agg(F.sum("n").alias("n_removed_words"), F.sort_array(F.collect_list("at")).alias("gone"))  # a text's own lines


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines that ``gone`` numbers, in order: what lies between them, joined."""

    def between(lines: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
        part = lambda b, i: F.slice(lines, b + 2, F.get(bounds, i + 1) - b - 1)
        return F.array_join(F.flatten(F.transform(F.slice(bounds, 1, F.size(bounds) - 1), part)), "\n")

    return F.when(F.size(gone) > 0, let(F.split(text, "\n"), between)).otherwise(text)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, max_removed: float = 0.8) -> DataFrame:
    """Metrics, verdict and cleaned text (``clean_text``) of every row of ``docs``, a scan of files."""
    rows = shared.cut(measured(docs, id_col, text_col, host_col), "measured")
    gone = shared.cut(removed_lines(rows.select("_row", "no_host", "host", "lines"), max_docs), "gone")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = rows.drop("lines").join(gone, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    text = shared.boxed(docs).select("_row", F.coalesce(shared.field(text_col).cast("string"), F.lit("")).alias("text"))
    clean = without_lines(F.col("text"), F.coalesce("gone", F.array().cast("array<int>")))
    return judged.join(text, "_row").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"), "n_removed_words",
        (~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words"))).alias("kept"), clean.alias("clean_text"),
    )


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(shared.documents(spark, sf_dir))
    return rows.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded FROM d
), grams AS (
  SELECT r, i, list_slice(words, i, i + 4) AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY r
), raw AS (
  SELECT r, host, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), lines AS (
  SELECT r, host, x, pos, trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS line FROM raw
), common AS (
  SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT r) > 10
), marked AS (
  SELECT l.r, x, pos, l.line, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.host IS NOT DISTINCT FROM c.host AND l.line = c.line
), gone AS (
  SELECT r, count_if(gone)::BIGINT AS lines, coalesce(sum(len(regexp_extract_all(line, '[^ ]+'))) FILTER (gone), 0) AS n,
         sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_sha256 FROM marked GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(worded) - len(list_distinct(worded)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, g.lines AS n_removed_lines, g.n::BIGINT AS n_removed_words, clean_sha256
  FROM w LEFT JOIN covered c USING (r) LEFT JOIN gone g ON w.r = g.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words, clean_sha256,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words <= 0.8 * n_words AS kept
FROM m
"""
