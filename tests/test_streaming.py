import datetime as dt

from codeskein.operators.incremental import document_changes
from codeskein.sources.files import SnapshotStore
from codeskein.streaming.watch import FileState, batches, relevant

AT = dt.datetime(2025, 1, 1)
EVENTS = "path string, hash string, project string, at timestamp"


def ms(n):
    return AT + dt.timedelta(milliseconds=n)


def test_relevance(spark):
    paths = ["a/B.cs", "a\\bin\\B.cs", "a/obj/x.cs", "a/readme.md", "a/dir", ".git/config", "b/x.H", ""]
    df = spark.createDataFrame([(p, AT) for p in paths], "path string, at timestamp")
    assert {r["path"] for r in relevant(df).collect()} == {"a/B.cs", "a/dir", "b/x.H"}


def test_batches_of_a_table(spark):
    df = spark.createDataFrame([("w", "a", ms(0)), ("w", "b", ms(300)), ("w", "a", ms(550)), ("w", "c", ms(900)), ("w", "", ms(2000))], "root string, path string, at timestamp")
    got = [(r["paths"], r["events"], r["lost"]) for r in batches(df).orderBy("started").collect()]
    assert got == [(["a", "b"], 3, False), (["c"], 1, False), ([], 1, True)]


def test_batches_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("w", "a", ms(0)), ("w", "b", ms(100)), ("w", "late", ms(60_000))], "root string, path string, at timestamp").write.parquet(source)
    stream = spark.readStream.schema("root string, path string, at timestamp").parquet(source)
    q = batches(stream).writeStream.format("memory").queryName("batched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["paths"] for r in spark.table("batched").collect()] == [["a", "b"]]


def test_state_follows_a_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    store = SnapshotStore(str(tmp_path / "state"))
    state = FileState(store, lambda changes: seen.extend(sorted((r["path"], r["change"]) for r in changes.collect())))
    for rows in ([("a", "1", "p", ms(0)), ("b", "1", "p", ms(1))], [("a", "2", "p", ms(2)), ("b", None, "p", ms(3)), ("c", "1", "p", ms(4)), ("c", "0", "p", ms(1))]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        q = state.follow(stream, str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["path"], r["hash"]) for r in store.load(spark)[0]["files"].collect()} == {("a", "2"), ("c", "1")}
    assert seen == [("a", "new"), ("b", "new"), ("a", "changed"), ("b", "removed"), ("c", "new")]


def test_changes_are_null_safe(spark):
    a = spark.createDataFrame([("x", None, "p"), ("y", "1", None)], "path string, hash string, project string")
    b = spark.createDataFrame([("x", None, "p"), ("y", "1", "p")], "path string, hash string, project string")
    assert {tuple(r) for r in document_changes(a, b).collect()} == {("x", "unchanged"), ("y", "changed")}


def test_a_batch_applied_again_changes_nothing_and_lost_events_are_made_up(spark, tmp_path):
    seen, store = [], SnapshotStore(str(tmp_path / "state"))
    state = FileState(store, lambda changes: seen.append(sorted((r["path"], r["change"]) for r in changes.collect())))
    first = spark.createDataFrame([("a", "1", "p", ms(0)), (None, "1", "p", ms(0))], EVENTS)
    state.apply(first, 0, "s")
    state.apply(spark.createDataFrame([("a", "2", "p", ms(1))], EVENTS), 1, "s")
    version = store.manifest(spark)["version"]
    state.apply(first, 0, "s")
    assert store.manifest(spark)["version"] == version and len(seen) == 2
    state.reconcile(spark.createDataFrame([("a", "2", "p"), ("b", "1", "p"), ("c", None, "p")], "path string, hash string, project string"))
    assert seen[2:] == [[("b", "new")]] and store.manifest(spark)["applied"] == {"s": 1}
    for n in range(2, 6):
        state.apply(first, n, "s")
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == SnapshotStore.KEPT + 1


def test_a_query_sees_what_was_written_before_it(spark, tmp_path):
    source, state = str(tmp_path / "in"), FileState(SnapshotStore(str(tmp_path / "state")))
    for n in range(2):
        spark.createDataFrame([(f"f{n}", "1", "p", ms(n))], EVENTS).coalesce(1).write.mode("append").parquet(source)
        files = state.current(spark.readStream.schema(EVENTS).parquet(source), str(tmp_path / "c"))
        assert {r["path"] for r in files.collect()} == {f"f{k}" for k in range(n + 1)}
