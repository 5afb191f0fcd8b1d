"""A corpus pipeline: quality, line deduplication, near-duplicates, source mixing, tokens.

Each stage takes the session, its predecessor's documents and the folder of the
tables, and returns a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.llm import bpe, linededup, mixing, nearcopies, quality
from tiepoint.llm.common import checkpoint_dir, discard, materialise, quoted, read_table

#: SQL cannot express the stages; their tests compare them with brute force.
ORACLE_SQL = None
#: Words of a shingle where near-duplicates are sought.
SHINGLE = 5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null texts are judged as empty, repeated rows each by itself, and without labels all stay."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; later ones (by id, null last) without the blocks that they share with earlier ones. Null texts stay null; what loses all its lines stays with an empty text."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, whatever the rows' ids.

    It is the row with the smallest id (null: the last of all), of equal ids the one
    with the smallest hash of its text; of rows that are equal in both any one. Null texts
    are like empty ones, and all of these are one group.
    """
    keys = [F.col("doc_id").isNull().alias("last"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), nearcopies.text_hash(F.col("text")).alias("same")]
    names = ["last", "id", "same"]
    every = materialise(docs.select(*keys).groupBy(*names).agg(F.count("*").alias("n")))
    first = every.groupBy("same").agg(F.min(F.struct("last", "id")).alias("x")).join(nearcopies.groups(docs, shingle=SHINGLE), "same")
    first = first.groupBy("root").agg(F.min(F.struct("x.last", "x.id", "same")).alias("x"))
    stays = materialise(first.select("x.*").join(every, names))
    gone = materialise(every.join(stays, names, "left_anti").select(*names))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *keys)
    if gone.count() <= nearcopies.FEW:
        kept = rows.join(F.broadcast(gone), names, "left_anti")  # no text is shuffled
    else:
        kept = rows.join(stays.select(*names), names, "left_semi")
    twice = materialise(stays.where("n > 1").select(*names))
    if not twice.isEmpty():
        kept = kept.join(twice, names, "left_anti").unionByName(kept.join(twice, names, "left_semi").dropDuplicates(names))
    return kept.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none more than three times. Null texts have no words; null sources are a source; of equal rows as many stay as the budget has room for."""
    mixed = mixing.mix(docs)
    own, copies = [F.col(quoted(c)) for c in docs.columns], F.col(quoted(mixed.columns[-1]))["copies"]
    taken = mixed.where(copies > 0).select(F.struct(*own).alias("row"), F.explode(F.sequence(F.lit(1), copies)))
    return taken.select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's tokens, with their digest and that of the decoded text; a null text is encoded as an empty one, repeated rows each by itself."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, remembered=40_000)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("tokens", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the session's shared folder and read again.

    A stage's folder is dropped once the next one is written; the last one stays, as the
    result reads it.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            discard(spark, before)
        before = out
    return docs
