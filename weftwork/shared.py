"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder is made and set, but only on a purely
    local master, where one machine holds the driver and every executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None, compression: str = "zstd", batch: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here.

    The folder's name is new for each call. A lost executor costs only the tasks it
    was running, since the files do not depend on it. by: a column of few values, each
    of which gets files of its own. compression: `uncompressed` for packed columns. batch: rows sent to Python at once, where texts of the usual
    number would take much memory. The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftwork/{name}-{uuid.uuid4().hex}"
    to = df.write.option("compression", compression)
    own = {CLEAN_UP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        (to.partitionBy(by) if by else to).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftwork_path = path
    return out


def remove(df: DataFrame, part: str = "") -> None:
    """Deletes a table that written() made, or of its parts one, that no later plan reads."""
    spark, path = df.sparkSession, df._weftwork_path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
