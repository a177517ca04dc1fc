"""Session helpers: sensible SQL settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Applied only where the session's owner has not chosen a value.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are wide rows: 4096 of them in one column batch can be gigabytes.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the :data:`TUNING` values that the session's owner left open."""
    chosen = spark.conf.getAll
    for key, value in TUNING.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "pagelake") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    shuffles = "8" if cpus == "*" else str(max(int(cpus), 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder the cluster names in ``spark.checkpoint.dir``. Only a session that
    runs in one process and lacks that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pagelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str = "table", work: str | None = None) -> str:
    """A fresh path below ``work``, a shared folder; without one below :func:`work_dir`."""
    return f"{work or work_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it names."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables, in whatever store it lies."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder to a place where there is none."""
    files, target = _file_system(spark, path)
    if not files.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot move {path} to {to}")


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder without entries at ``path``."""
    files, target = _file_system(spark, path)
    return files.exists(target) and len(files.listStatus(target)) == 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; readers find it whole or not at all."""
    files, target = _file_system(spark, f"{path}.part")
    stream = files.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    discard(spark, path)
    rename(spark, f"{path}.part", path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What :func:`write_text` wrote, or None."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stage(df: DataFrame, name: str = "stage", work: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet below ``work`` or the shared folder and read it back.

    Used where a costly result (parsed pages) has more than one reader: the pages
    are parsed once, every reader prunes columns on its own, and a lost executor
    never sends the job back to the raw pages.
    """
    path = work_path(df.sparkSession, name, work)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
