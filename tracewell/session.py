"""Session settings and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Sizing (shuffle partitions, split size) is
# left to the cluster; AQE coalesces or splits at run time.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

SPREAD_BYTES = 4 << 20
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders made below the checkpoint folder and not deleted yet.
_MADE: dict[str, SparkSession] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster.

    Only a local master, whose executors are this process, may go without: it gets a
    temporary folder. On a cluster executors would write to their own disks, so an
    unset folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tracewell-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder, seen by all executors.

    It is deleted when the driver ends; see :func:`drop_stage` for an earlier end.
    """
    path = f"{_checkpoint_root(spark).rstrip('/')}/tracewell/{purpose}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_MADE.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder stays for the cluster's own clean-up
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written copy survives the loss of any executor, and iterative operators
    keep a plan of constant size.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "stage")
    # The shuffles of a written stage are not read again, so their files need not wait for the driver's collector.
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    stage = spark.read.schema(df.schema).parquet(path)
    stage._tracewell_stage = path
    return stage


def drop_stage(*stages: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` and their :func:`union_stages` that nothing reads any more."""
    for stage in stages:
        for part in getattr(stage, "_tracewell_parts", [stage]):
            path = getattr(part, "_tracewell_stage", None)
            if path and _MADE.pop(path, None) is not None:
                _delete(part.sparkSession, path)


def union_stages(parts: list[DataFrame], stages: list[DataFrame] | None = None) -> DataFrame:
    """All rows of tables of :func:`cut_lineage`, or of views of such ``stages``; :func:`drop_stage` deletes them together."""
    whole = functools.reduce(DataFrame.unionByName, parts)
    whole._tracewell_parts = stages or parts
    return whole


def spread(df: DataFrame, by_size: bool = False) -> DataFrame:
    """Spread a scan over all cores if it has fewer splits than there are cores.

    Small tables in few files would otherwise keep a few cores busy with all the
    text work. A scan with enough splits is returned unchanged, unless ``by_size`` asks for parts of
    ``SPREAD_BYTES`` of the files: splits follow row groups, of which a table of short rows may have few large ones.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if not by_size:
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = [path(f) for f in df.inputFiles()]
    size = sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)))
