"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a table
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. A stage first lets go of what the one before has left in memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, gam, lines, minhash, mixing
from keelson.llm.common import checkpointed, ensure_checkpoint_dir, read, release, unused
from keelson.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of docs.

    Each row is judged by its own text: null and empty texts as texts without words, repeated rows
    alike, whatever their ids. Labels of null ids or values teach nothing. A score of just 0.5
    stays. An empty table gives an empty one; columns of any name are kept."""
    release(spark)
    return gam.keep(docs, gam.learn(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from every document; n_chars, where it is there, follows
    the text.

    Every row is a document of its own, also if its id is null or another's or the row is repeated.
    All rows stay: one that loses all its lines has an empty text, a null text stays null. Lines of
    just ten documents go. An empty table gives an empty one; columns of any name are kept."""
    release(spark)
    kept = lines.dedup_rows(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*_all(docs))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with a number of each row's own and a hash of all its columns, and their names. Ids may
    be null or repeated; a checkpoint holds the numbers."""
    row, code = unused(docs, "row"), unused(docs, "hash")
    return checkpointed(docs.select("*", F.xxhash64(*_all(docs)).alias(code), F.monotonically_increasing_id().alias(row))), row, code


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that of the smallest id.

    Rows are told apart by a key of their own: a null id comes last but is an id like others, and of
    rows that share an id (alike or not, repeated or not) each belongs to the class of its text.
    Of rows that tie, the one of the smallest hash of its columns stays. Null and empty texts are one
    class. An empty table gives an empty one; columns of any name are kept."""
    release(spark)
    keyed, row, code = _keyed(docs)
    classes = minhash.near_classes(keyed, id_col=row).select(F.col("id").alias(row), F.col("class_id").alias("class"))
    rows = keyed.select(F.col("doc_id").alias("id"), F.col(code).alias("code"), row)
    first = F.min(F.struct(F.col("id").isNull(), "id", "code", row)).alias("first")
    heads = rows.join(classes, row).groupBy("class").agg(first).select(F.col("first")[row].alias(row))
    return keyed.join(heads, row, "left_semi").select(*_all(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded: rows repeat where a source is
    taken more than once and go where it is taken less.

    Rows are told apart by a key of their own, so that null and repeated ids and repeated rows are
    each taken as often as their own words are. Texts without words go, a null source is one of its
    own. An empty table gives an empty one; columns of any name are kept."""
    release(spark)
    keyed, row, code = _keyed(docs)
    key, times, copy = (unused(keyed, x) for x in ("key", "times", "copy"))
    rows = keyed.select("doc_id", "text", "source", F.struct(F.col(code).alias("hash"), F.col(row).alias("row")).alias(key))
    often = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = mixing.mix(rows, key_col=key).select(F.col("key.row").alias(row), often.alias(times)).filter(F.col(times) > 0)
    return keyed.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*_all(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the digests of ids and of what they decode to: one row
    per row, also for null and repeated ids and repeated rows. A null text has no tokens. An empty
    table gives an empty one; further columns are left out."""
    release(spark)
    return bpe.encode_table(docs, tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("source mix", mix_sources), ("bpe encoding", encode)]

#: The classifier, the sampling and the automaton are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written goes when the next one has written its
    own; the last one's goes when the driver ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    return docs
