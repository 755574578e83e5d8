"""Session construction and the few settings the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides single settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; on a local master without one, a folder of our own is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"strandloom-{os.getpid()}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        wanted = f"file://{own}"
    sc.setCheckpointDir(wanted)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor costs a re-read and not a re-run."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, path: str, to: str | None) -> None:
    """Move a folder within its storage, or delete it."""
    fs, p = _file_system(spark, path)
    done = fs.delete(p, True) if to is None else fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to))
    if not done:
        raise OSError(f"could not {'delete' if to is None else 'move'} {path}")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt out to all of them before costly work on its rows.
    Tables of more parts, as all large ones are, stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, however the driver came by it; once per application."""
    import strandloom

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(strandloom.__file__)))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp(prefix="strandloom-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "strandloom"), "zip", root, "strandloom"))
    _shipped.add(sc.applicationId)
