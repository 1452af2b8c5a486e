"""File corpora as one row per file."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CHECKS, values_df
from ..session import cut_lineage

# --- Fixed values ---------------------------------------------------------------------------------
SKIPPED_FOLDERS = (".venv", "venv", "__pycache__", "site-packages", ".git", "node_modules")
MODEL_SUFFIXES = (".h5", ".keras")


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path inside it, and what to put before such a path to get the whole one."""
    scheme, split, rest = path.partition(":")
    if not split or "/" in scheme or scheme == "file":
        inside = path if not split or "/" in scheme else "/" + rest.lstrip("/")
        return fs.LocalFileSystem(), inside, "file:"
    authority, _, inside = rest.lstrip("/").partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    root = root.rstrip("/")  # the bucket, on file systems whose paths begin with it
    return system, f"{root}/{inside}", f"{scheme}://" if root else f"{scheme}://{authority}"


def whole_path(path: str) -> str:
    """A path as `list_files` and `read_files` write it."""
    _, inside, prefix = opened(path)
    return prefix + inside.rstrip("/")


def _entries(path: str) -> tuple[list[fs.FileInfo], str]:
    """What lies in a folder, or the file itself; links to folders are left out, so no folder is seen twice."""
    system, inside, prefix = opened(path)
    own = system.get_file_info(inside)
    found = system.get_file_info(fs.FileSelector(inside)) if own.type != fs.FileType.File else [own]
    local = isinstance(system, fs.LocalFileSystem)
    return [i for i in found if not (local and i.type == fs.FileType.Directory and os.path.islink(i.path))], prefix


def list_files(spark: SparkSession, path: str, names: Sequence[str] = ("*",)) -> DataFrame:
    """`(path, length)` of the files in any depth below path whose name matches, hidden ones too; a file stands for itself.

    Executors list the folders, one level of all of them at a time. Any file system that Arrow can open will do.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found, prefix = _entries(folder)
                rows = [{"path": prefix + i.path, "length": i.size or 0, "folder": i.type == fs.FileType.Directory} for i in found]
                kept = [r for r, i in zip(rows, found) if r["folder"] or r["path"] == folder or any(fnmatchcase(i.base_name, n) for n in names)]
                yield pa.RecordBatch.from_pylist(kept, pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())]))

    folders, levels = spark.createDataFrame([(whole_path(path),)], "path string"), []
    while not folders.isEmpty():
        entries = cut_lineage(folders.repartition(_width(spark), "path").mapInArrow(listed, "path string, length bigint, folder boolean"))
        levels.append(entries.filter("NOT folder").select("path", "length"))
        folders = entries.filter("folder").select("path")
    return reduce(DataFrame.unionByName, levels)


def _width(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism * 4


def _arrow_opens(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read_files(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """`(path, content)` of every file below path whose name matches one of `names`, or of path itself; a row is at most 2 GB.

    Names with a dot or an underscore in front count like others, as `__init__.py` does. Spark's own file reader leaves
    them out, so it is used only where Arrow cannot open the file system.
    """
    if not _arrow_opens(path):
        pattern = "{" + ",".join(names) + "}"
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                system, inside, _ = opened(file)
                with system.open_input_stream(inside, compression=None) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([stream.read()], pa.binary())], names=["path", "content"])

    files = list_files(spark, path, names).select("path")
    return files.repartition(_width(spark), "path").mapInArrow(contents, "path string, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """`(path, content)` with the bytes as UTF-8 text, NULL where they are not."""
    return files.select("path", F.expr("try_validate_utf8(cast(content AS STRING))").alias("content"))


def as_text(files: DataFrame) -> DataFrame:
    """The files that are UTF-8; `operators.unreadable` names the others."""
    return decoded(files).filter(F.col("content").isNotNull())


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Python files and notebooks, for the parse-based checks."""
    return as_text(read_files(spark, path, ("*.py", "*.ipynb")))


def read_install_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Notebooks and requirement lists, for the supply-chain check."""
    return as_text(read_files(spark, path, ("*.ipynb", "requirements*.txt")))


CORPUS = ("*.py", "*.ipynb", "requirements*.txt")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All inputs of all checks in one scan."""
    return as_text(read_files(spark, path, CORPUS))


def file_kind(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.endswith(".ipynb"), "notebook")
        .when(name.endswith(".py"), "python")
        .when(name.startswith("requirements") & name.endswith(".txt"), "requirements")
    )


def is_model_file(path: Column) -> Column:
    """Saved networks outside dependency folders."""
    parts = F.split(path, "/")
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in SKIPPED_FOLDERS]))
    suffix = path.endswith(MODEL_SUFFIXES[0]) | path.endswith(MODEL_SUFFIXES[1])
    return suffix & ~skipped


def find_model_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of saved networks; only the listing is touched, never the content."""
    names = tuple(f"*{suffix}" for suffix in MODEL_SUFFIXES)
    if _arrow_opens(path):
        listed = list_files(spark, path, names)
    else:
        listed = read_files(spark, path, names)  # the reader does not open what is not selected
    return listed.select("path").filter(is_model_file(F.col("path"))).orderBy("path")


def with_fixture_check(files: DataFrame, root: str) -> DataFrame:
    """Fixture files: the first folder below root names the check; other folders are left out."""
    rel = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    known = values_df(files.sparkSession, ("check",), [(c,) for c in CHECKS])
    return (
        files.withColumn("file", rel)
        .withColumn("check", F.element_at(F.split("file", "/"), 1))
        .filter((F.size(F.split("file", "/")) > 1) & F.col("file").rlike(r"\.(ipynb|py)$"))
        .join(known, "check", "left_semi")
    )
