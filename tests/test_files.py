"""Scans of real folders: hidden and underscored names, depth, single files, links, odd bytes."""

import pytest

from wardflow.sources import files as fs


@pytest.fixture
def root(tmp_path):
    for path, content in {
        "main.py": b"x", "pkg/__init__.py": b"y", "pkg/_private/.hidden.py": b"z", "pkg/empty.py": b"", "a b/c%20d.py": "ü".encode(), "pkg/bad.py": b"\xff\xfe",
        "n/run.ipynb": b"{}", "n/run.IPYNB": b"{}", "n/requirements.txt": b"a==1", "n/requirements/x.txt": b"", "n/my-requirements.txt": b"",
        "m/net.h5": b"1", "m/.git/net.h5": b"1", "m/site-packages/p/net.keras": b"1", "m/net.h5.bak": b"1",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    (tmp_path / "pkg" / "loop").symlink_to(tmp_path)
    (tmp_path / "hollow").mkdir()
    return tmp_path


def below(root, df):
    return sorted(r["path"].split(f"{root}/", 1)[1] for r in df.select("path").collect())


def test_sources_in_any_depth(spark, root):
    found = fs.read_files(spark, str(root), ("*.py", "*.ipynb"))
    assert below(root, found) == sorted(["main.py", "pkg/__init__.py", "pkg/_private/.hidden.py", "pkg/empty.py", "a b/c%20d.py", "pkg/bad.py", "n/run.ipynb"])
    texts = {r["path"].rsplit("/", 1)[1]: r["content"] for r in fs.read_sources(spark, f"file://{root}").collect()}
    assert texts["c%20d.py"] == "ü" and texts["empty.py"] == "" and "bad.py" not in texts


def test_install_inputs_and_models(spark, root):
    assert below(root, fs.read_install_inputs(spark, str(root))) == ["n/requirements.txt", "n/run.ipynb"]
    assert below(root, fs.find_model_files(spark, str(root))) == ["m/net.h5"]


def test_single_files_empty_and_missing_folders(spark, root):
    assert [tuple(r) for r in fs.list_files(spark, str(root / "main.py"), ("*.ipynb",)).collect()] == [(f"file:{root}/main.py", 1)]
    assert fs.list_files(spark, str(root / "hollow")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        fs.list_files(spark, str(root / "nowhere"))


def test_paths_are_written_as_spark_writes_them(spark, root):
    """Spark's reader gives no row for empty files; all others of this folder are the same."""
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root / "n")).select("path", "length").collect()
    assert sorted(fs.list_files(spark, str(root / "n")).filter("length > 0").collect()) == sorted(theirs)
