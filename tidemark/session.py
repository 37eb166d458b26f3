"""Session and storage settings shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings that the operators rely on; sizes are left to the cluster.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    conf = CONF | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with the package sent to its workers unless they find it by themselves.

    Workers look in the folders of PYTHONPATH and in the one that the driver runs in. Where the package is installed on
    all machines, this isn't needed.
    """
    root = Path(__file__).resolve().parents[1]
    known = {Path(p).resolve() for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]}
    context = spark.sparkContext
    if root not in known and not any("tidemark" in Path(p).name for p in context.listFiles):
        made = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted((root / "tidemark").rglob("*.py")):
                z.write(f, f.relative_to(root))
        context.addPyFile(str(made))
    return spark


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One of the Parquet tables below ``folder``.

    ``spread`` is for work that costs more than moving the rows: a table that is read in fewer parts than half of the
    cores, such as one small file, is dealt out to all of them. Larger tables stay as they are read.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() * 2 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a local session gets a temporary folder; a cluster gets an error,
    since a folder of one machine can't be read by the others.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    told = told or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        told = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def _forget(jvm, conf, path: str) -> None:
    try:
        _remove(jvm, conf, path)
    except Exception:  # the session's own process may be gone by now; what is left can be deleted by hand
        pass


_FOLDERS: set[str] = set()


def stored(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: work done once, lineage cut, no copy held by an executor.

    The tables of an application lie in one folder, which is deleted when its driver ends. ``instead`` is a stored table
    that nothing needs any more once this one is written, as in loops; it is deleted at once.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    folder = f"{shared_dir(spark)}/tidemark-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_forget, jvm, conf, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead is not None:
        _remove(jvm, conf, instead._stored_at)
    return out


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the place (from 1) of each row in a total order: sorted by ranges, so no task holds all rows."""
    row = F.monotonically_increasing_id()
    keys = [f"_order{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = placed.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", (before - F.col("_first") + 1).alias("_start"))
    return placed.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, F.col("_row") + F.col("_start")).drop(*keys, "_part", "_row", "_p", "_start")
