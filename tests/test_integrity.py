"""Streamed hashes of files: pieces, odd names, nested folders, empty files, verification."""

import hashlib
import random

from wardflow.operators import integrity as it


def test_streamed_hashes(spark, tmp_path):
    draw, want = random.Random(6), {}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, size in (("a.bin", 0), ("b c%é.bin", 5_000_003), ("deep/d.bin", 1000), ("deep/er/e.gz", 999), ("deep/f.txt", 1)):
        content = draw.randbytes(size)
        (tmp_path / name).write_bytes(content)
        want[name.rsplit("/", 1)[-1]] = (hashlib.sha256(content).hexdigest(), size)
    got = it.manifest_of(spark, str(tmp_path), chunk=1000).collect()
    assert sorted((r["sha256"], r["size"]) for r in got) == sorted(want.values())
    only = it.manifest_of(spark, str(tmp_path), "*.txt").collect()
    assert [(r["sha256"], r["size"]) for r in only] == [want["f.txt"]]


def test_equal_to_the_hash_of_whole_rows_and_verified(spark, tmp_path):
    for i in range(1, 13):  # Spark's own reader leaves empty files out
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (i * 700))
    whole = it.manifest(spark.read.format("binaryFile").load(str(tmp_path)))
    streamed = it.manifest_of(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, streamed.collect()))
    expected = whole.collect()
    (tmp_path / "3.bin").write_bytes(b"other")
    states = it.verify(spark.createDataFrame(expected, whole.schema), it.manifest_of(spark, str(tmp_path))).collect()
    assert sorted(r["state"] for r in states) == ["changed"] + ["ok"] * 11
