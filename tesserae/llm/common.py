"""Shared helpers: table access, materialised stages, small expression tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.workers import reachable

#: ASCII white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch of whole texts. Spark's default of 10,000 is meant for narrow rows.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_fallback_dir: list[str] = []


def for_texts(spark: SparkSession) -> SparkSession:
    """The session, set to Arrow batches of BATCH_ROWS rows at most: what a task holds of long texts stays small on both sides.

    Its workers can import the package from then on, so a stage of the pipeline needs no preparation by its caller.
    """
    reachable(spark)
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = for_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which the whole cluster sees.

    A machine-local folder is used only where that setting is absent, as in tests.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _fallback_dir:
            _fallback_dir.append("file://" + tempfile.mkdtemp(prefix="tesserae-"))
        base = _fallback_dir[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and hand it to body, all inside one row expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterable[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Batches in smaller parts, so that what is made of one part at a time stays small."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name
