"""Session helpers: the shared work folder, tables that cut lineage, Arrow batch sizes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and the master is local (tests) a folder of this
    process is made, and removed in the end; a cluster without the setting fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = f"file://{path}"
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The plan restarts at the files, so lost executors cost one stage's
    recomputation at most and nothing is evaluated twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that nothing reads any more."""
    sc, home = df.sparkSession.sparkContext, shared_dir(df.sparkSession).removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if home in folder:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tuned(spark: SparkSession) -> None:
    """Keep Arrow batches to Python at a few MB, however long the rows, unless the session names a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "4m")
