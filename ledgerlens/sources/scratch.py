"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder; any
    other master is refused, since executors would not see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    return _own[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/ledgerlens/{label}-{uuid.uuid4().hex[:12]}"


def _on_file_system(path: str):
    """The session's Hadoop file system for ``path``, and the path in it."""
    spark = SparkSession.builder.getOrCreate()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(text: str, path: str) -> None:
    """A small UTF-8 file, written where Spark itself would read the path; an old one is replaced."""
    files, at = _on_file_system(path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(path: str) -> str:
    """A small UTF-8 file from where Spark itself would read the path."""
    files, at = _on_file_system(path)
    source = files.open(at)
    try:
        return SparkSession.builder.getOrCreate().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    A lost executor then costs only re-reads; files appear by Spark's commit
    protocol, so a retried task cannot leave half a result.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
