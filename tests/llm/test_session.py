import os
import subprocess
import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import session
from foliant.llm.textbatch import arrow_batches


def test_batches_are_bounded_by_bytes_and_by_rows(spark):
    session.bounded_batches(spark)

    def sizes(batches):
        for b in arrow_batches(batches):
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    long = spark.range(20, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    got = long.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 20 and max(r.bytes for r in got) <= session.ARROW_BYTES + (2 << 20)
    short = spark.range(5000, numPartitions=1).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in short) == 5000 and max(r.rows for r in short) == 512


def test_free_name(spark):
    df = spark.createDataFrame([(1, 2)], "__Fp int, __fp_ int")
    assert session.free_name(df, "__fp") == "__fp__" and session.free_name(df, "x") == "x"


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)


SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "4").getOrCreate()
import corpus_pipeline
from foliant.llm import queries
from cases import SF
for f in (queries.op3_token_files, queries.op10_simhash, queries.op11_resample, queries.op12_vectors, corpus_pipeline.run):
    assert f(spark, SF).count()
"""


def test_no_file_stays_when_the_driver_ends(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": f"{root}:{root}/tests/llm"}
    subprocess.run([sys.executable, "-c", SCRIPT, f"file:{tmp_path}"], check=True, cwd=root, env=env, timeout=400)
    for _ in range(100):  # its JVM ends a little later
        if not (left := [f for _, _, files in os.walk(tmp_path) for f in files]):
            break
        time.sleep(0.2)
    assert not left
