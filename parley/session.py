"""Session construction and cluster-safe scratch locations."""
from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "parley", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes: UTC, AQE,
    skew-join splitting, Arrow transfer, no UI server."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # local mode runs the executors inside the driver JVM: give it the memory
    conf["spark.driver.memory"] = os.environ.get("PARLEY_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (driver-built sessions)."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a running session
                pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``. A session on one
    machine that names none gets a fresh scratch folder; on a cluster that is an error,
    for a local folder of the driver is not seen by executors."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    d = tempfile.mkdtemp(prefix="parley-ckpt-", dir=os.environ.get("PARLEY_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    d = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Rows of a narrow table that are worth a file.
FILE_ROWS = 20_000


def few_files(df: DataFrame, rows: int) -> int | None:
    """Number of files for a table of about ``rows`` rows where that is less than the session's
    shuffle partitions, else None: small tables of iterative jobs need no file per partition."""
    n = max(1, -(-int(rows) // FILE_ROWS))
    return n if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


#: Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """For queries that end inside and are not run again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses do not compute it
    again, the lineage is cut, a lost executor costs nothing that was finished, and the shuffle
    files of the job go with its end. ``rows``, where the caller can tell about how many there
    are, bounds the number of files; the last stage of ``df`` then runs in as many tasks."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    files = None if rows is None else few_files(df, rows)
    with shuffles_removed(spark):
        (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``keep`` once no later job reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("kept-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to the session's shuffle partitions, for work on a row that costs far
    more than moving it. A file is read in no more tasks than it has row groups, often one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))


def suggest_shuffle_partitions(input_bytes: int, target_bytes: int = 128 * 1024 * 1024,
                               cores: int = 8, expansion: float = 1.0) -> int:
    """Shuffle partitions so each reduce partition holds about ``target_bytes``
    (``expansion`` scales input to shuffled bytes, e.g. 2.0 after an explode). Never
    fewer than the cores, rounded up to a multiple of them; AQE coalesces downward at
    run time, so erring high is cheap while erring low spills."""
    n = max(cores, -(-int(input_bytes * expansion) // target_bytes))
    return -(-n // cores) * cores


def size_for(spark: SparkSession, paths: list[str], expansion: float = 1.0) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the input size unless the cluster set it
    explicitly; returns the value in effect."""
    current = spark.conf.get("spark.sql.shuffle.partitions", None)
    explicit = spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions")
    if explicit and current:
        return int(current)
    jvm = spark._jvm
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        total += fs.getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    n = suggest_shuffle_partitions(total, cores=cores, expansion=expansion)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n
