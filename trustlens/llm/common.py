"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names.

    The setting is read from the session.  Where it is unset (tests), the folder that the
    session already checkpoints to is used, else one below the warehouse folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def store(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than the tasks it ran.  ``batch`` is the number of rows
    that go to a Python worker at a time meanwhile: few where rows are long."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/t", spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


LONG_ROWS = 1_000  # rows of a whole text or a whole set go in batches of so many


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores behind it, so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text):
    """Lower-case A-Z only.  ``lower`` is exact for pure ASCII rows and much cheaper."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
