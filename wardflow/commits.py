"""Files that are created once: how writers of one folder agree on who was first.

The folder must lie on a file system with an atomic rename that does not overwrite (a local disk, HDFS).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.mkdirs(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist. Names with a leading underscore or dot are not listed."""
    place, files = _hadoop(spark, path)
    if not files.exists(place):
        return []
    found = (s.getPath().getName() for s in files.listStatus(place))
    return sorted(n for n in found if not n.startswith(("_", ".")))


def read_text(spark: SparkSession, path: str) -> str:
    place, files = _hadoop(spark, path)
    opened = files.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that shows whole or not at all; False if the name was taken."""
    place, files = _hadoop(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid4().hex}")
    out = files.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(hidden), files.makeQualified(place), how)
        return True
    except Exception as error:
        files.delete(hidden, False)
        if files.exists(place) and "FileAlreadyExists" in str(error):
            return False
        raise


def remove_folder(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)
