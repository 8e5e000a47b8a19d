"""From raw documents to token ids: toxic documents go, then exact and near copies, then sources are mixed to their
weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents. Rows are
found again by doc_id; where a table with text meets ids, the ids are broadcast if they take few enough bytes, so that
texts stay where they are; otherwise only those rows are shuffled that pass a filter of fixed size. Null texts count as
empty; rows with a null doc_id are kept by the two stages that look for copies, except that rows equal in doc_id and text
are one. Further columns pass through, whatever their names. run() deletes the intermediate tables of its own stages
that its documents no longer read, and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import op2_mix, op4_near, op7_exact, op9_bpe, op10_toxic
from pageloom.llm.common import WORD, Tables, fresh, table, text_of, with_keys, without_keys, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold."""
    score, spans = fresh("score", "spans")
    field = op10_toxic.train(docs, table(spark, sf_dir, "labels"))
    return op10_toxic.with_scores(docs, field, score, spans).filter(F.col(score) < op10_toxic.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    copies = written(op7_exact.dedup(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    rest = without_keys(docs, copies, "doc_id")
    # Rows that repeat an id with its text are kept by both; one stays.
    repeated = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return rest
    (digest,) = fresh("digest")
    nulls = F.col("doc_id").isNull()
    several = with_keys(rest, repeated.filter("doc_id IS NOT NULL"), "doc_id").select(*docs.columns).unionByName(rest.filter(nulls))
    once = several.withColumn(digest, F.sha2(text_of(), 256)).dropDuplicates(["doc_id", digest])
    return without_keys(rest.filter(~nulls), repeated, "doc_id").unionByName(once.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8."""
    copies = written(op4_near.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct())
    return without_keys(docs, copies, "doc_id")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix of its source takes it. A row is found again by doc_id and size."""
    size, key, copies, copy = fresh("size", "key", "copies", "copy")
    found = lambda n: F.concat_ws(":", n.cast("string"), F.col("doc_id").cast("string"))
    changed = op2_mix.mix(docs).filter("copies != 1").groupBy(found(F.col("size")).alias(key)).agg(F.min("copies").alias(copies))
    changed = written(changed)
    rows = docs.withColumn(size, F.regexp_count(text_of(), F.lit(WORD)).cast("long")).withColumn(key, found(F.col(size)))
    some = with_keys(rows, changed, key).filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return without_keys(rows, changed, key).select(*docs.columns).unionByName(some.select(*docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return op9_bpe.apply(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("byte-level BPE", encoding),
]

#: The field, the filters and the rounding have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Tables() as own:
        for k, (_, stage) in enumerate(STAGES, 1):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES):
                docs = written(docs)
                own.forget(spark, docs)
    return docs
