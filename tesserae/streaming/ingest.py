"""New photos as a stream: each trigger reads the files that have come since the last one.

A file source can't see that files are gone, so a batch refresh stays the way to a complete index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesserae.plans import index
from tesserae.sources import images

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, glob: str = "*", fast: bool = True) -> StreamingQuery:
    """Appends index rows of new files below folder to target and stops when all are read.

    Batches carry their number, so that a batch that runs again after a failure replaces itself.
    """
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").toLocalIterator()]  # one trigger's files
        for n in range(0, len(paths), images.PATH_BATCH):
            rows = index.analyse(spark, paths[n : n + images.PATH_BATCH], f"{target.rstrip('/')}-work", fast)
            rows.write.mode("overwrite" if n == 0 else "append").parquet(f"{target.rstrip('/')}/batch={number}")

    return stream.select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
