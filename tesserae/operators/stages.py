"""Results that several steps read: written once into the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written under spark.checkpoint.dir and read back: lineage ends there, and a lost executor repeats nothing before it.

    A machine-local folder is used only where that setting is absent, as in tests.
    """
    base = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="tesserae-"))
        base = _fallback[0]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compiled(spark: SparkSession) -> SparkSession:
    """The session, set so that no step becomes one Java method of more than 8,000 bytes of code, which Java would interpret and never compile."""
    setting = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(setting, min(8_000, int(spark.conf.get(setting, "8000"))))
    return spark
