"""Session settings, the shared folder and materialised intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SHIPPED: set[str] = set()


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="marlstone-code-")  # on the driver; Spark hands the archive out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "marlstone.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".tsv"):
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a folder or file, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    fs, p = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; it appears whole or not at all, and replaces one that is there."""
    fs, p = filesystem(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, hadoop.Path(path), how)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or on a single machine one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_end, *filesystem(spark, path))
    return path


def _delete_at_end(fs, path) -> None:
    with suppress(Exception):  # the JVM may have ended before
        fs.delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh folder of the shared folder, deleted at the end of the block."""
    path = new_table_path(spark, name)
    try:
        yield path
    finally:
        delete(spark, path)


def materialise(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or to ``under``) and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{under}/{name}" if under else new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table of ``folder``."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def whole_words(text: str):
    """Column: lower-cased text, nulls as empty."""
    return F.lower(F.coalesce(F.col(text), F.lit("")))
