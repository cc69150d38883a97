"""Exact deduplication with a heavy-hitter split.

Texts are compared by the SHA-256 of their white-space-normalised form. Digests
that may be frequent are found by Misra-Gries summaries (one per partition,
merged by addition), their winners are verified by an exact aggregate and sent
to all tasks, so that the rows of hot groups are settled on the map side. The
other digests are shuffled in the ordinary way; each of those groups holds less
than 2/(counters+1) of the rows.

Defined results: null texts count as empty, and empty texts are equal to each
other. A null id ranks after every other id. Of rows that repeat the smallest
id of their group, the first one in the scan stays. Very long texts are hashed
whole. Columns of the input keep their names, whatever these are; only columns
named like the added ones (``keep_id``, ``kept`` ...) are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


def normalised(text) -> F.Column:
    """White-space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{shared.SPACE}+", " ")


def misra_gries(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """Candidates for the frequent values of ``column``: every value that occurs in
    2/(counters+1) of the rows or more is among them; at most ``counters`` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in batch.column(0).value_counts():
                key, more = item["values"].as_py(), item["counts"].as_py()
                held[key] = held.get(key, 0) + more
            while len(held) > counters:
                # take the (counters+1)-th largest count from all: the batch form of the decrement
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: n - least for k, n in held.items() if n > least}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    parts = digests.select(column).mapInArrow(summarise, "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256, mark_only: bool = False) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; one row each.

    mark_only leaves only the id column and these four, and reads the texts once.
    ``docs`` must be a scan of files (see ``shared.with_row``)."""
    digest = F.unhex(F.sha2(normalised(shared.field(text_col)), 256))
    rows = shared.boxed(docs)
    keys = shared.cut(rows.select("_row", shared.field(id_col).alias("_id"), digest.alias("_digest")), "digests")
    # the row that stays is the least of its group by this order
    winner = [F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("w"), F.count("*").alias("n")]

    frequent = F.broadcast(misra_gries(keys, "_digest", counters).withColumnRenamed("digest", "_digest"))  # at most `counters` rows
    heavy = shared.cut(keys.join(frequent, "_digest", "left_semi").groupBy("_digest").agg(*winner), "heavy")
    heavy_side = F.broadcast(heavy.select("_digest"))  # one row for each candidate
    light = keys.join(heavy_side, "_digest", "left_anti").groupBy("_digest").agg(*winner).where("n > 1")
    # written out, both join sides have exchanges of their own, and Spark can split what skew is left
    light = shared.cut(light, "light")

    heavy = heavy.select("_digest", F.col("w").alias("_hw"), F.col("n").alias("_hn"))
    light = light.select(F.col("_digest").alias("_ld"), F.col("w").alias("_lw"), F.col("n").alias("_ln"))
    joined = keys.join(F.broadcast(heavy), "_digest", "left")
    # rows of heavy groups look for no partner in the shuffle: they are spread by row, not by digest
    joined = joined.withColumn("_key", F.when(F.col("_hn").isNull(), F.col("_digest")).otherwise(F.col("_row").cast("string").cast("binary")))
    joined = joined.join(light, F.col("_key") == F.col("_ld"), "left")
    w, n = F.coalesce("_hw", "_lw"), F.coalesce("_hn", "_ln", F.lit(1).cast("long"))
    marks = [
        F.when(w.isNull(), F.col("_id")).otherwise(w["id"]).alias("keep_id"),
        n.alias("group_size"),
        (w.isNull() | (w["row"] == F.col("_row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    ]
    if mark_only:
        return joined.select(F.col("_id").alias(id_col), *marks)
    marked = joined.select("_row", *marks)
    return rows.join(marked, "_row").select(*shared.unboxed(docs.columns, ADDED), *ADDED)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.documents(spark, sf_dir), mark_only=True)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""
