"""Watching: two scans, changes, deletions, the converted mark, batch and stream alike."""

import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from docblocks import sinks
from docblocks.sources import snapshots as source
from docblocks.streaming import watch

CASES = [
    (["a", "a", "a"], [1]),
    (["a", "a", "b", "b"], [1, 3]),
    (["a", "b", "a"], []),
    (["a", None, "a", "a"], [3]),
    (["a", "a", None, "a", "a"], [1, 4]),
    (["a", "a", "b", "a", "b"], [1, 4]),  # seen at its converted mark, the pending one stays
]


@pytest.mark.parametrize(("marks", "ready"), CASES)
def test_scans(spark, marks, ready):
    assert spark.createDataFrame([(marks,)], "m array<string>").select(watch.ready_scans(F.col("m"))).first()[0] == ready


def streamed(spark, tmp_path, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def by_scan(spark, frame, folder, order="scan_no"):
    """A stream whose micro-batches are the values of ``order``, one after the other."""
    for n in sorted({r[order] for r in frame.select(order).collect()}):
        frame.where(F.col(order) == n).coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.02)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.mark.parametrize("batches", ["one", "one a scan"])
def test_batch_and_stream_agree(spark, tmp_path, batches):
    rows = [(s, f"p{i}", m) for i, (marks, _) in enumerate(CASES) for s, m in enumerate(marks) if m is not None]
    frame = spark.createDataFrame(rows, "scan_no long, path string, mark string")
    batch = {(r["path"], r["scan_no"]) for r in watch.ready_files(frame, "path", "scan_no", "mark").collect()}
    assert batch == {(f"p{i}", s) for i, (_, ready) in enumerate(CASES) for s in ready}
    if batches == "one":
        frame.coalesce(1).write.json(str(tmp_path / "in"))
        scans = spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    else:
        scans = by_scan(spark, frame, tmp_path / "in")
    assert {(r["path"], r["scan_no"]) for r in streamed(spark, tmp_path, watch.ready_stream(scans), "ready")} == batch


def state_rows(spark, checkpoint, operator=0):
    """Keys that a query's state still has."""
    return spark.read.format("statestore").option("path", str(checkpoint)).option("operatorId", operator).option("stateVarName", "marks").load().count()


def test_state_ends_with_its_path(spark, tmp_path):
    """A path that goes and comes back begins anew; when all are gone, no state is left."""
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", None), (4, "a", "x"), (5, "a", "x"), (1, "b", "1"), (5, "b", "1"), (6, "a", None), (6, "b", None), (7, "b", None)]
    scans = by_scan(spark, spark.createDataFrame(rows, "scan_no long, path string, mark string"), tmp_path / "in")
    got = streamed(spark, tmp_path, watch.watched(scans, every_scan=False), "events")
    assert [(r["scan_no"], r["path"], r["event"]) for r in sorted(got, key=lambda r: (r["scan_no"], r["path"]))] == [
        (2, "a", "ready"), (3, "a", "gone"), (5, "a", "ready"), (5, "b", "ready"), (6, "a", "gone"), (6, "b", "gone"),
    ]
    assert state_rows(spark, tmp_path / "cp-events") == 0


def test_unmentioned_paths_expire(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "scan_no long, path string, mark string")
    scans = by_scan(spark, frame, tmp_path / "in")
    stream = watch.watched(scans, absent_after=timedelta(milliseconds=300))
    query = stream.writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp-expired")).trigger(processingTime="200 milliseconds").start()
    deadline = time.time() + 60
    while time.time() < deadline and not any(r["event"] == "gone" for r in spark.table("expired").collect()):
        time.sleep(0.3)
    query.stop()
    assert ("a", 2, "gone") in [(r["path"], r["scan_no"], r["event"]) for r in spark.table("expired").collect()]
    assert state_rows(spark, tmp_path / "cp-expired") == 0


def test_targets_have_one_owner(spark, tmp_path):
    """Both names of one target: the first path owns it until it goes, even if letters differ."""
    rows = [(1, "/i/a.md", "m", "ready"), (1, "/i/A.txt", "m", "ready"), (2, "/i/a.md", "n", "ready"), (3, "/i/A.txt", None, "gone"), (3, "/i/a.md", "o", "ready"), (4, "/i/a.md", None, "gone"), (4, "/i/A.txt", "n", "ready"), (5, "/i/a.md", "m", "ready")]
    events = by_scan(spark, spark.createDataFrame(rows, "scan_no long, path string, mark string, event string"), tmp_path / "in")
    watch.keyed.use_state_store(spark)
    target = F.concat(F.lit("/o/./"), F.regexp_extract("path", r"([^/]+)\.", 1), F.lit("_SEI.html"))
    got = streamed(spark, tmp_path, watch.claims(events, target), "claims")
    assert {(r["scan_no"], r["path"], r["owner"]) for r in got} == {(1, "/i/A.txt", "/i/A.txt"), (1, "/i/a.md", "/i/A.txt"), (2, "/i/a.md", "/i/A.txt"), (3, "/i/a.md", "/i/a.md"), (4, "/i/A.txt", "/i/A.txt"), (5, "/i/a.md", "/i/A.txt")}


def test_late_results_are_dropped(spark, tmp_path):
    """Selection 2 supersedes 1, whose result comes after it; sessions don't mix; a result may come before its selection."""
    rows = [(1, "s", 1, None), (2, "s", 2, None), (3, "s", 1, "late"), (4, "s", 2, "first"), (5, "s", 2, "second"), (5, "t", 1, "t1"), (6, "t", 1, None), (6, "t", 2, None), (7, "t", 1, "late"), (8, "t", 2, "t2"), (9, "u", 5, "old"), (9, "u", 6, None)]
    frame = spark.createDataFrame(rows, "n int, session string, version long, value string")
    both = by_scan(spark, frame, tmp_path / "in", "n")
    got = streamed(spark, tmp_path, watch.latest_results(both.where("value is null"), both.where("value is not null")), "latest")
    assert {(r["session"], r["version"], r["value"]) for r in got} == {("s", 2, "first"), ("s", 2, "second"), ("t", 1, "t1"), ("t", 2, "t2")}


# the source
def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_folder_in_batch(spark, tmp_path):
    for name in ("a.md", "b.TXT", "sub/c.md", "sub/deep/d.odt", "z.bin"):
        write(tmp_path / "in" / name, name)
    source.register(spark)
    read = lambda deep: spark.read.format("snapshots").option("path", f"file://{tmp_path}/in").option("recursive", deep).load()
    assert {r["name"] for r in read("true").collect()} == {"a.md", "b.TXT", "c.md", "d.odt", "z.bin"}
    some = read("true").where(F.col("suffix").isin(".md", ".txt"))
    assert {r["name"] for r in some.collect()} == {"a.md", "b.TXT", "c.md"}
    assert "- Filter" not in some._jdf.queryExecution().executedPlan().toString()  # the walk itself leaves the others out
    assert {(r["name"], r["mark"].split(":")[1]) for r in read("false").where("suffix = '.md' and name <> 'q'").collect()} == {("a.md", "4")}
    assert spark.read.format("snapshots").option("path", str(tmp_path / "none")).load().count() == 0


def scanned(spark, tmp_path, between, scans, cp="cp"):
    """Rows of every scan of tmp_path/in; ``between[n]`` happens after scan n."""
    got = []

    def sink(batch, _):
        rows = batch.collect()
        got.extend((r["scan_no"], r["name"], r["mark"] is None) for r in rows)
        number = max((r["scan_no"] for r in rows), default=None)
        done = len(seen) + 1
        seen.append(number)
        if done in between:
            between[done]()

    seen = []
    stream = watch.snapshots(spark, str(tmp_path / "in"), str(tmp_path / cp / "scans"), recursive=True, scans=scans)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / cp)).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    return sorted(got)


def test_scans_tell_changes(spark, tmp_path):
    """A changed file and one that goes, with its folder; settled files are not told again, nor are outputs."""
    write(tmp_path / "in/a.md", "x")
    write(tmp_path / "in/sub/b.txt", "y")
    write(tmp_path / "in/a_SEI.html", "own")
    between = {4: lambda: write(tmp_path / "in/a.md", "xx"), 7: lambda: (os.unlink(tmp_path / "in/sub/b.txt"), os.rmdir(tmp_path / "in/sub"))}
    got = scanned(spark, tmp_path, between, 10)
    assert [g[1:] for g in got] == [("a.md", False), ("b.txt", False)] * 2 + [("a.md", False)] * 2 + [("b.txt", True)]
    assert got[0][0] + 1 == got[2][0] and got[4][0] + 1 == got[5][0] < got[6][0]
    assert len(os.listdir(tmp_path / "cp/scans")) <= 2
    # a query that starts again goes on with the next scan
    write(tmp_path / "in/new.md", "n")
    assert [g[1:] for g in scanned(spark, tmp_path, {}, 14)] == [("new.md", False)] * 2


def test_a_scan_is_looked_at_once(tmp_path):
    """A task that runs again gives the rows of its first run, whatever the folder is by then; so does the loser of two."""
    write(tmp_path / "in/a.md", "x")
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log")}
    scans = source.Scans(options)
    (part,) = scans.partitions({"scan": 0}, {"scan": 1})
    first = list(scans.read(part))
    write(tmp_path / "in/b.md", "later")
    assert list(source.Scans(options).read(part)) == first
    assert scans._look(part, {}) == {str(tmp_path / "in/a.md"): (first[0][4], 1)}
    assert [r[2] for p in scans.partitions({"scan": 1}, {"scan": 2}) for r in scans.read(p)] == ["a.md", "b.md"]
    with pytest.raises(ValueError, match="log"):
        source.Scans({"path": "x"})


def test_watched_folder_is_converted(spark, tmp_path):
    """New, changed, colliding and deleted inputs from the source to the written pages."""
    inside, out = tmp_path / "in", tmp_path / "out"
    write(inside / "a.md", "um")
    write(inside / "sub/d.txt", "quatro")
    results, changes = [], iter([lambda: (write(inside / "a.md", "dois"), write(inside / "A.txt", "outro")), lambda: os.unlink(inside / "a.md"), lambda: None, lambda: None])

    def then(done, _):
        results.append([(r["nome_origem"], r["sucesso"], r["erros"]) for r in done.results.orderBy("path").collect()])
        next(changes)()

    query = sinks.watch_folder(spark, str(inside), str(tmp_path / "cp"), str(out), recursive=True, scans=14, seconds=0, then=then)
    query.processAllAvailable()
    query.stop()
    assert [(n, ok) for n, ok, _ in results[0]] == [("a.md", True), ("d.txt", True)]
    assert [(n, ok) for n, ok, _ in results[1]] == [("A.txt", False), ("a.md", True)] and "coincide com a de a.md" in results[1][0][2][0]
    assert "dois" in (out / "a_SEI.html").read_text() and "quatro" in (out / "sub/d_SEI.html").read_text()
    assert sorted(os.listdir(out)) == ["a_SEI.html", "sub"]


def test_folders(spark):
    frame = spark.createDataFrame([("/in/x/y/a.md",), ("/in/a.md",)], "p string")
    assert [r[0] for r in frame.select(watch.target_folder(F.col("p"), "/in", "/out")).collect()] == ["/out/x/y/", "/out/"]
