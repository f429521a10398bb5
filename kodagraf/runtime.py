"""Session settings and the lineage cut that the iterative operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "kodagraf") -> SparkSession:
    """A session for tests and local measurement; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own:
    on a cluster such a folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="kodagraf-")
    return _LOCAL_DIRS[sc.applicationId]


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike ``checkpoint()`` this computes the plan a single time, and the table it
    returns has real sizes, so the choice between broadcast and shuffle join that
    follows rests on them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: shuffled and merged, never gathered on the driver.

    The sizes that choose a broadcast are those of compressed blocks; rows of similar ids
    take tens of times more on the driver.
    """
    return df.hint("merge")


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a superseded :func:`cut` (iteration state)."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root.split(":", 1)[-1].lstrip("/") in folder:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
