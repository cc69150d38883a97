"""The corpus pipeline: five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's ``docs``. All stages but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom import store
from pixelloom.llm import exact_dedup, packing, shared, similar_texts, suffix_dedup, weak_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Stages run outside of ``run`` (the result of each is stored before the next begins).
_loose = store.Successive()


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no operator can meet their names."""
    rest = [shared.named(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_columns"))


def _restored(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns again, in order; ``new`` replaces some."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_columns").getField(c)
    return rows.select(*[new.get(c, own(c)).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps. Null and blank texts go; repeated rows are
    judged alike; texts of any length are judged whole; an empty table gives no rows."""
    with _loose.step(spark):
        return _restored(weak_labels.weak_label_quality(_carried(docs)).where("kept"), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id (a null id
    ranks last), of rows that repeat it the first in the scan. Null counts as empty; texts of any
    length are hashed whole; an empty table gives no rows."""
    with _loose.step(spark):
        return _restored(exact_dedup.exact_dedup(_carried(docs)).where("kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or
    more, verified exactly; candidates by SimHash, and by MinHash where fingerprints differ in
    too many bits): the one with the smallest id (a null id ranks last), of rows that repeat it
    the first in the scan. Texts without words, null ones too, are alike; texts of any length are
    compared whole; an empty table gives no rows."""
    with _loose.step(spark):
        rows = shared.with_row(docs.select("doc_id", "text"))  # rows, as ids may repeat or be null
        groups = shared.cut(similar_texts.similar_groups(rows.select("_row", "text"), id_col="_row").select(F.col("id").alias("_row"), F.col("root").alias("component_id")), "groups")
        groups = shared.cut(groups.join(rows.select("_row", "doc_id"), "_row"), "members")
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
        stays = shared.cut(groups.groupBy("component_id").agg(F.min(order).alias("stays"), F.count("*").alias("n")), "stays")
        dropped = shared.join_side(groups, stays, ["component_id"], "n", groups.count()).where("_row <> stays.row").select("_row")
        return shared.boxed(docs).join(dropped, "_row", "left_anti").select(*shared.unboxed(docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of repeated 200-byte strings; n_chars is counted anew. A null
    text stays null, and so does its n_chars; rows that repeat a text of that length all lose it,
    as each holds it; texts of any length are cut whole; an empty table gives no rows."""
    with _loose.step(spark):
        return _restored(suffix_dedup.remove_repeats(_carried(docs)), docs.columns, n_chars=F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of mixed sources; a null text is one end token. Rows that repeat
    each other are packed each; texts of any length are cut over sequences; an empty table
    gives no rows."""
    with _loose.step(spark):
        return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("suffix_array_dedup", passages),
    ("packing", packed),
]

#: Training a classifier and tokenising have no SQL form; tests/llm/test_pipeline.py compares
#: the stages with plain versions and planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, the result of each stored in the shared folder."""
    docs = shared.documents(spark, sf_dir).select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        path = shared.fresh_path(spark, f"pipeline-{name}")
        with shared.scope(spark):  # what the stage wrote on its way goes with it
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            shared.delete(spark, before)
        before = path
    return docs
