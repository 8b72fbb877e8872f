"""The pipeline's stages, called one by one where nothing but the driver knows where the package lies."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.read.parquet(f"{sys.argv[2]}/documents.parquet")
for name, stage in corpus_pipeline.STAGES[:2]:
    docs = stage(spark, docs, sys.argv[2])
print("rows", docs.count())
"""


def test_workers_find_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "-c", RUN, str(ROOT), sf], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert int(ran.stdout.split()[-1]) > 0
