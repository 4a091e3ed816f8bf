"""Intermediate tables in the folder the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: such a table
survives the loss of any executor, is columnar (later steps read only what they
need) and is a plain scan to the optimiser.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="skeinlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below the shared one."""
    return f"{shared_dir(spark)}/skeinlake/{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that weren't written yet can't be read afterwards."""
    delete(spark, session_dir(spark))


class Workspace:
    """A private folder below the shared one, with named tables in it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(nullable(schema)).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _fs(spark, path)
    fs.delete(hadoop_path, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path))


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _fs(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Make ``path`` with this text, whole and once: of several writers one succeeds, the others get FileExistsError.

    The text is written under a temporary name and then given its own by a step that fails where
    the name exists: a hard link on local file systems, elsewhere a rename without overwriting,
    which the file system must offer as an atomic step, as HDFS does.
    """
    jvm = spark._jvm
    fs, temporary = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    _, target = _fs(spark, path)
    stream = fs.create(temporary, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(place(target), place(temporary))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, options)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise
    finally:
        fs.delete(temporary, False)
