"""A corpus pipeline of five operators; each stage reads what the stage before it wrote.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last return the columns of documents:

1. language_id: a model is trained on the labelled rows; texts that it rejects, or without a letter, go.
2. near_dedup: of each SimHash component one row stays, that with the smallest id, nulls last; of rows with equal ids
   that with the smallest hash. Rows that share an id but are no near-duplicates are of different components and stay.
3. decontaminate: rows go in which words of a benchmark passage occur.
4. pii: personal data become pseudonyms; n_chars is counted anew.
5. tokenise: every text is encoded and decoded; columns of that name in the input give way to n_tokens, ids_sha256 and
   decoded_sha256.

All stages return an empty table for an empty one, keep extra columns, and treat a null text as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tritloom.llm import bpe, decontam, langid, pii, simhash
from tritloom.llm.common import Scratch, map_rows, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, found="__kinds")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__kinds") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    columns = [f"`{c}`" for c in docs.columns]
    schema = T.StructType([*docs.schema, T.StructField("n_tokens", T.LongType()), T.StructField("__ids", T.BinaryType()), T.StructField("__decoded", T.BinaryType())])
    out = map_rows(docs, columns, bpe.both_ways, schema, *bpe.vocabulary())
    return out.select(*columns, "n_tokens", F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", remove_pii), ("tokenise", tokenise)]
#: The stages hold a trained model, a hash that SQL lacks and a tokenizer: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, as a table in the shared folder; what the stages before it wrote is removed."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES:
            docs, path = written(stage(spark, docs, sf_dir), name)
        scratch.keep(path)
    return docs
