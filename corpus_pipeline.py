"""The corpus pipeline: training documents through the operators of ``ledgerframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import bpe, decontamination, pii, rule_ensemble, set_join
from ledgerframe.llm.common import only, read_table, stored
from ledgerframe.llm.queries import TOKENIZERS


def with_row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with the long column ``_row``, one value for each different (doc_id, text).

    That is the doc_id, but where it repeats or is null: there it is a number above all doc_ids, so
    that no stage judges one text by another that bears the same id.
    """
    doc_id, text = F.col("doc_id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return docs.withColumn("_row", doc_id)
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    again = again.withColumnRenamed("doc_id", "_again")
    marked = docs.withColumn("_digest", text).join(again.withColumn("_is", F.lit(True)), doc_id.eqNullSafe(F.col("_again")), "left")
    numbers = marked.filter("_is").select(doc_id.alias("_id"), F.col("_digest").alias("_of")).distinct()
    numbers = stored(numbers.withColumn("_number", F.monotonically_increasing_id() + F.lit(top) + 1), "row-ids")
    joined = marked.join(numbers, doc_id.eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left")
    return joined.select(*docs.columns, F.coalesce("_number", "doc_id").alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labelled ones among them.

    Rows without a doc_id have no label and are judged like all others; repeated rows are judged
    each; null and empty texts have a score too.
    """
    model = rule_ensemble.fit(docs, read_table(spark, sf_dir, "labels"))
    return only(rule_ensemble.score(docs, model), F.col("predicted") == 1).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Near-duplicate here: 5-word shingles, similarity 0.8 or more. Documents without words belong to
    no group and stay. Rows that repeat a doc_id with another text are documents of their own, and
    so are rows without a doc_id; of rows that repeat both one stays, the least by a hash of all columns.
    """
    rows = with_row_ids(docs)
    groups = set_join.jaccard_components(rows, percent=80, width=5, doc_id="_row")
    out = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("_row")).distinct()
    kept = rows.join(stored(out, "copies"), "_row", "left_anti")
    repeats = kept.groupBy("_row").agg(F.count("*").alias("n"), F.min(F.xxhash64(*docs.columns)).alias("_least")).filter("n > 1")
    repeats = stored(repeats.select("_row", "_least"), "repeats")
    if repeats.isEmpty():
        return kept.select(docs.columns)
    least = kept.join(repeats, "_row", "left").filter(F.col("_least").isNull() | (F.xxhash64(*docs.columns) == F.col("_least")))
    single, several = least.filter("_least IS NULL"), least.filter("_least IS NOT NULL")
    return single.select(docs.columns).unionByName(several.select(docs.columns).distinct())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; each text is judged for itself."""
    rows = with_row_ids(docs)
    found = decontamination.overlaps(rows, read_table(spark, sf_dir, "benchmark"), doc_id="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(stored(found, "overlaps"), "_row", "left_anti").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each personal datum or secret in its place; n_chars follows the text (null for null)."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of its ids and of the text they decode to.

    One row for each row: a null text is encoded as empty, repeated rows are encoded each.
    """
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), f"{TOKENIZERS}/byte_bpe_50k.json", with_ids=True)
    return done.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("redacted", redacted),
    ("tokens", tokens),
]

#: Learned models and tokenizers can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
