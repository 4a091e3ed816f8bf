"""The content store: files kept once under the digest of their bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions.scalars import content_path, file_sha256


def store(spark: SparkSession, folder: str, vault: str) -> DataFrame:
    """path, sha256, stored of the files under a folder, each stored at its content path below ``vault`` unless it is there.

    A content is written under a name of its own and then moved, so that no reader finds a part of
    it; of equal contents written at once the last move stays, which is the same. ``vault`` is a
    path or URI that all executors reach. Files are read into memory one by one; empty ones, which
    Spark's file source leaves out, are not stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(vault if "://" in vault else f"file://{vault}")
        for batch in batches:
            for row in batch.itertuples(index=False):
                target = f"{root.rstrip('/')}/{row.target}"
                missing = files.get_file_info(target).type == fs.FileType.NotFound
                if missing:
                    files.create_dir(target.rpartition("/")[0], recursive=True)
                    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
                    with files.open_output_stream(temporary) as out:
                        out.write(row.content)
                    files.move(temporary, target)
                yield pd.DataFrame({"path": [row.path], "sha256": [row.sha256], "stored": [missing]})

    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = read.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), "content", file_sha256("content").alias("sha256"))
    return rows.withColumn("target", content_path("sha256")).mapInPandas(run, "path string, sha256 string, stored boolean")
