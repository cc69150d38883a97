"""Audit of how quality filters overlap, by replaying them in every order.

Each document's failures are one bit mask. Every mask meets all orders of the
filters (120 for five, a broadcast table whose size is the factorial of the
number of filters), the first failure under each order is computed, its steps are
exploded, and conditional counts are combined on the map side: what is shuffled
are (orders x steps x parts) rows a task, whatever the number of documents.

A filter is a letter and a predicate on the text that is true where a document
fails. ``repeats`` is the letter of the filter that fails a document whose text
some smaller id has, in the whole table and removed or not: texts are grouped by
SHA-256 with map-side minima, and the ids that stay meet the documents by id, so
groups of copies of any size put no task under strain.

Defined results: a null text is empty; a null part is the empty string; a null
id is neither smaller than another nor has a smaller one, and has no labels. Rows
that repeat an id and its text count each, and none of them is a copy of the other.
Of labels that repeat an id, the largest value counts; null labels count as 0.
Texts are read whole, however long. Only the named columns are read, so further
columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{shared.SPACE}+"), "")


#: Letter -> what fails a document, as a function of its text and its words.
FILTERS = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
#: The filter on repeated texts.
REPEATS = "E"


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping = FILTERS, repeats: str | None = REPEATS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, good, toxic) of every document; bit i of ``fails`` is the i-th filter's
    by letter. ``labels``: id, quality, toxic."""
    letters = sorted([*filters, *([repeats] if repeats else [])])
    bit = {x: 1 << i for i, x in enumerate(letters)}
    text = F.coalesce(shared.named(text_col).cast("string"), F.lit(""))
    rows = docs.select(shared.named(id_col).alias("id"), F.coalesce(shared.named(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    fails = sum((F.when(f(F.col("text"), F.col("words")), bit[x]).otherwise(0) for x, f in filters.items()), F.lit(0))
    rows = shared.cut(rows.select("id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")

    marks = labels.select(shared.named(id_col).alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    named, nameless = rows.where("id is not null"), rows.where("id is null")  # null ids look for no partner
    out = named.join(marks, "id", "left")
    if repeats:
        stays = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("stays", F.lit(True))  # one row a text
        out = out.join(stays, ["id", "digest"], "left")
        out = out.withColumn("fails", F.col("fails") + F.when(F.col("stays"), 0).otherwise(bit[repeats]))
    none = F.lit(False)
    out = out.select("part", "fails", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    return out.unionByName(nameless.select("part", "fails", none.alias("good"), none.alias("toxic")))


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(order_no, filter_order, bits): every order of the filters, and the filters' bits in it."""
    if len(letters) > 6:
        raise ValueError("the orders of more than six filters are too many to broadcast")
    bit = {x: 1 << i for i, x in enumerate(sorted(letters))}
    rows = [(i, "".join(p), [bit[x] for x in p]) for i, p in enumerate(permutations(sorted(letters)))]
    return spark.createDataFrame(rows, "order_no int, filter_order string, bits array<int>")


def replay(failed: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order and step (see the module) from ``failures``."""
    every, k = orders(failed.sparkSession, letters), len(letters)
    met = failed.crossJoin(F.broadcast(every.select("order_no", "bits")))
    first = F.coalesce(*[F.when(F.col("fails").bitwiseAND(F.col("bits")[i]) != 0, i + 1) for i in range(k)], F.lit(k + 1))
    steps = met.withColumn("first", first).select("part", "order_no", "fails", "good", "toxic", "first", F.posexplode("bits").alias("before", "bit"))
    step, own = F.col("before") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    here = F.col("first") == step
    counts = steps.groupBy("part", "order_no", step.alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(own & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    named = counts.join(F.broadcast(every.select("order_no", "filter_order")), "order_no")
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # one row an order
    return named.withColumn("shapley", F.sum("removed").over(of_filter)).drop("order_no")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping = FILTERS, repeats: str | None = REPEATS, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley (the removals of the step's filter, summed over all orders)."""
    letters = "".join(sorted([*filters, *([repeats] if repeats else [])]))
    return replay(failures(docs, labels, filters, repeats, **columns), letters)


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), m AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < w.doc_id THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN m USING (doc_id)
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step::INTEGER AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS earlier
  FROM o, range(1, 6) AS r(step)
), c AS (
  SELECT part, filter_order, step, count(*) FILTER ((fails & (own | earlier)) = 0) AS kept,
         count(*) FILTER ((fails & earlier) = 0 AND (fails & own) > 0) AS removed,
         count(*) FILTER ((fails & earlier) > 0 AND (fails & own) > 0) AS redundant, count(*) FILTER (fails = own) AS unique_fails,
         count(*) FILTER ((fails & earlier) = 0 AND (fails & own) > 0 AND good) AS good_lost,
         count(*) FILTER ((fails & earlier) = 0 AND (fails & own) > 0 AND toxic) AS toxic_lost
  FROM f, s GROUP BY part, filter_order, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM c
"""
