"""SHA-256 manifests of saved artifacts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import list_files, opened

CHUNK = 8 * 1024 * 1024


def manifest(files: DataFrame) -> DataFrame:
    """`(path, sha256, size)` of files with binary `content`; each file is hashed where it is read."""
    return files.select("path", F.sha2(F.col("content"), 256).alias("sha256"), F.length("content").cast("bigint").alias("size"))


def manifest_of(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """`(path, sha256, size)` of the files under `path` whose name matches, of any size, empty ones too, in any depth of folders.

    Executors list the folders (`sources.files.list_files`) and then stream each file in pieces of `chunk` bytes, so
    memory does not grow with a file. A file that changes its size between the two is refused.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([
                    {"path": file["path"], "sha256": _stream_digest(file["path"], file["length"], chunk), "size": file["length"]}])

    files = list_files(spark, path, (glob,))
    return files.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(hashed, "path string, sha256 string, size bigint")


def _stream_digest(path: str, length: int, chunk: int) -> str:
    system, inside, _ = opened(path)
    digest, seen = hashlib.sha256(), 0
    with system.open_input_stream(inside, compression=None, buffer_size=0) as stream:
        while piece := stream.read(chunk):
            digest.update(piece)
            seen += len(piece)
    if seen != length:
        raise OSError(f"{path} had {length} bytes when it was listed and {seen} when it was read")
    return digest.hexdigest()


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """State of every path: ok, changed, missing, or not in the manifest."""
    want = expected.select("path", F.col("sha256").alias("want"))
    got = actual.select("path", F.col("sha256").alias("got"))
    state = (
        F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted")
        .when(F.col("want") == F.col("got"), "ok").otherwise("changed")
    )
    return want.join(got, "path", "full").select("path", state.alias("state"))
