"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

toxicity removes documents that it rejects; the n-gram Jaccard join keeps one document of each group of near
copies; decontamination cuts benchmark passages; sanitisation masks personal data; mixing gives each
document the number of words that the mix takes from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import mixing, pii
from tallgrass.llm.decontaminate import remove_contamination
from tallgrass.llm.ngram_join import ngram_jaccard_components
from tallgrass.llm.session import Written, checkpoint, sized
from tallgrass.llm.toxicity import score_toxicity

#: The columns of documents; all stages but the last return these.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A score of which a document is rejected.
TOXIC = 0.3
#: Words of a shingle, and percent of similarity, of near copies.
SHINGLE, SIMILAR = 5, 80


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2, keep=COLUMNS)
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays, of the least id; a document without an id only if none of its group has one."""
    # ids can be null or used by several texts, so a document is known by id and text; null ids come last
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = ngram_jaccard_components(docs.select(key.alias("key"), "text"), id_col="key", n=SHINGLE, percent=SIMILAR)
    # a row a key: whether another document of its group stays, and how many rows have the key
    keys = groups.groupBy("key").agg(F.first(~F.col("key").eqNullSafe(F.col("component_id"))).alias("gone"), F.count("*").alias("rows"))
    keys = checkpoint(keys.where(F.col("gone") | (F.col("rows") > 1)).select(F.col("key.id").alias("id"), F.col("key.hash").alias("hash"), "gone"))
    gone, twice = keys.where("gone"), keys.where("not gone")

    def among(rows: DataFrame, some: DataFrame, n: int, how: str) -> DataFrame:
        some = sized(some, n)
        return rows.join(some, rows["doc_id"].eqNullSafe(some["id"]) & (F.xxhash64(rows["text"]) == some["hash"]), how)

    n_gone, n_twice = gone.count(), twice.count()
    kept = among(docs, gone, n_gone, "left_anti").select(*COLUMNS)
    if n_twice:  # of copies that share the id too, one
        kept = among(kept, twice, n_twice, "left_anti").union(among(kept, twice, n_twice, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(remove_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.sanitize(docs.select(*COLUMNS)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        written = Written(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted model and a search for near copies are not for SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
