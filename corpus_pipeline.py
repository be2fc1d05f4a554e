"""From raw documents to training text: five stages, each written as Parquet and read again.

1. toxicity: documents that the ordinal model rejects go.
2. line dedup: of near-equal lines one stays; a document of which no line is left goes.
3. n-gram Jaccard join: of documents linked at 0.8 over five-word runs, the one with the smallest id stays.
4. benchmark decontamination: documents that hold a benchmark item go.
5. SentencePiece: what is left becomes piece ids; `same` says that decoding gives the text back.

All but the last return the columns of their input. An empty table stays empty, rows with null ids or texts pass as the
operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forgetide.llm.op2_toxicity import fit, without_toxic
from forgetide.llm.op3_lines import without_repeated_lines
from forgetide.llm.op4_jaccard_join import one_of_each
from forgetide.llm.op7_pieces import encode_decode
from forgetide.llm.op8_decontamination import without_benchmark
from forgetide.llm.queries import prepare
from forgetide.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_repeated_lines(docs, shortest=1)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return one_of_each(docs, 5, (8, 10))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: A trained model, MinHash and piece ids cannot be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
