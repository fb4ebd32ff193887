"""From raw documents to token ids: quality, toxicity, near copies, benchmark leaks, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of `documents`.  run() writes every stage's result as Parquet to the folder that driver and executors share and
reads it again, so a lost executor never costs more than the stage at work; what the stage before it had written is then
removed.

Cases: a null or empty text is scored by what an empty one says and goes or stays by that; it is nobody's copy, leaks
nothing and has no ids.  Of rows that share id and text one stays, rows with a null id each stand for themselves.  Extra
columns go along through all stages but the last; an empty table gives no rows; without labels every score is 0.5: below
the threshold of quality and not below that of toxicity, so nothing stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import decontaminate, minhash, pieces, quality, toxicity
from nearfold.llm.texts import shared_folder

#: Words of a shingle of the near-copy stage.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not find toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return minhash.drop_near_copies(docs, width=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark, and in which no whole window of it does."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the text that the ids decode to."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pieces", to_ids),
]

#: Two stages are trained classifiers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
