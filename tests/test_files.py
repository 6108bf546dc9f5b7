"""The file sink: all of a write or nothing of it, whatever tasks do; and which file a path names."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docblocks.functions import paths
from docblocks.sources import files


def rows(spark, folder, n, parts=4):
    return spark.range(n).repartition(parts).select(F.concat(F.lit(f"{folder}/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".html")).alias("target"), F.concat(F.lit("ação "), F.col("id").cast("string")).alias("content"))


def found(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_are_written(spark, tmp_path):
    files.write(rows(spark, tmp_path / "out", 2500), f"file://{tmp_path}/out")
    assert len(found(tmp_path / "out")) == 2500 and (tmp_path / "out/1/7.html").read_text() == "ação 7"
    assert sorted(os.listdir(tmp_path / "out")) == ["0", "1", "2"]  # nothing is left of the staging
    files.write(rows(spark, tmp_path / "out", 3).withColumn("content", F.lit("new\r\n")), str(tmp_path / "out"))
    assert (tmp_path / "out/1/1.html").read_bytes() == b"new\r\n" and len(found(tmp_path / "out")) == 2500


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    bad = F.when(F.col("target").endswith("/77.html"), F.raise_error(F.lit("broken"))).otherwise(F.col("content"))
    os.makedirs(tmp_path / "out")
    with pytest.raises(PySparkException):
        files.write(rows(spark, tmp_path / "out", 100).withColumn("content", bad), str(tmp_path / "out"))
    assert found(tmp_path / "out") == [] and os.listdir(tmp_path / "out") == []


def test_a_repeated_task_leaves_no_second_file(tmp_path):
    """Two attempts of one task, one of which dies half way: only the list that was accepted is moved."""
    writer = files.FilesWriter(str(tmp_path))
    given = [{"target": f"{tmp_path}/{i}.html", "content": str(i)} for i in range(5)]

    def dies():
        yield from given[:3]
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dies())
    lost = writer.write(iter([{"target": f"{tmp_path}/extra.html", "content": "never accepted"}]))
    told = writer.write(iter(given))
    assert told.files == 5 and lost.files == 1 and found(tmp_path) and not os.path.exists(tmp_path / "0.html")
    writer.commit([told, None])
    assert found(tmp_path) == [f"{i}.html" for i in range(5)] and sorted(os.listdir(tmp_path)) == found(tmp_path)


def test_abort_touches_no_target(tmp_path):
    (tmp_path / "a.html").write_text("old")
    writer = files.FilesWriter(str(tmp_path))
    told = writer.write(iter([{"target": f"{tmp_path}/a.html", "content": "new"}]))
    writer.abort([told, None])
    assert found(tmp_path) == ["a.html"] and (tmp_path / "a.html").read_text() == "old"


def test_no_rows(spark, tmp_path):
    files.write(rows(spark, tmp_path / "out", 0), str(tmp_path / "out"))
    assert found(tmp_path / "out") == []


@pytest.mark.parametrize(
    ("path", "out"),
    [
        ("/a/./b//../C.txt", "/a/C.txt"), ("file:///x/../../y", "/y"), ("..\\a\\..\\..\\b", "../../b"), ("", ""), ("/", "/"), ("a/b/", "a/b"), ("/..", "/"), ("./a", "a"), ("a/..", ""), (None, None),
    ],
)
def test_resolved(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(paths.resolved(F.col("p"))).first()[0] == out


def test_identity(spark):
    frame = spark.createDataFrame([("/a/B",), ("/A/./b",), ("\\a\\x\\..\\b",), ("/á/b",), ("/Á/B",), (None,)], "p string")
    assert sorted(r["count"] for r in frame.groupBy(paths.identity(F.col("p"))).count().collect()) == [1, 2, 3]
    other = frame.select(paths.identity(F.col("p")).alias("k")).distinct()
    assert frame.join(other, paths.identity(F.col("p")) == F.col("k")).count() == 5
    assert frame.select(paths.key(F.col("p"))).distinct().count() == 3
