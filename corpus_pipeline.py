"""The corpus pipeline: five stages, each written as Parquet and read again.

toxicity (rejected documents go), MinHash near-duplicates (one document of each group stays),
benchmark decontamination (contaminated documents go), personal data (texts are sanitised) and
best-fit packing.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm import bestfit, decontam, minhash, pii, toxicity
from trustlens.llm.common import LONG_ROWS, store, table
from trustlens.llm.queries import held_out, tokenizer_file

SHINGLE_WORDS = 5  # near-duplicates of the corpus; op10_ has its own two


def _few_rows_a_batch(spark: SparkSession) -> None:
    """Rows are whole texts: they go to Python workers in batches of at most ``LONG_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= LONG_ROWS:
        spark.conf.set(key, str(LONG_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows_a_batch(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows_a_batch(spark)
    return minhash.keep_one_of_each(docs, words=SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows_a_batch(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows_a_batch(spark)
    out = pii.sanitise_documents(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows_a_batch(spark)
    return bestfit.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("personal_data", sanitise), ("packing", pack)]

# No stage but decontamination is expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
