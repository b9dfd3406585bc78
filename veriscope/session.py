"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "veriscope", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for; an existing session is reused."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if SparkSession.getActiveSession() is None:
        b = b.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
        b = b.config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(cpus))
        b = b.config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a table may be a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of our own is set only where the cluster names none, and only in local mode, where driver and
    executors are one process. On a cluster without the setting this raises: a machine-local folder would
    lose data with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="veriscope-")
    sc.setCheckpointDir(made)
    return made


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet below :func:`checkpoint_dir` and read back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed, so later reads prune columns. The
    folder outlives the call, as the result is read lazily; it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/veriscope-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)
