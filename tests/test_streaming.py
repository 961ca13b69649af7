import datetime as dt

from arborist.operators.history import change_log
from arborist.streaming import changes as st

T0 = dt.datetime(2024, 1, 1)


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def write(spark, path, rows, schema=st.CHANGE_SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=st.CHANGE_SCHEMA):
    return spark.readStream.schema(schema).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


ROWS = [("p", None, f"src/{n}.ts", "modified", i, at(s)) for i, (n, s) in enumerate([("a", 0), ("b", 1), ("c", 10), ("d", 11), ("e", 12)])]
SENTINEL = [("p", None, "end", "modified", 99, at(1000))]


def test_bursts_equal_batch_twin(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, ROWS)
    write(spark, src, SENTINEL)
    drain(st.change_bursts(st.filter_ignored(stream(spark, src))), "bursts")
    got = sorted((r["changes"], r["last_path"]) for r in spark.table("bursts").collect())
    twin = st.change_bursts(spark.createDataFrame(ROWS, st.CHANGE_SCHEMA))
    assert got == sorted((r["changes"], r["last_path"]) for r in twin.collect()) == [(2, "src/b.ts"), (3, "src/e.ts")]


def test_stale_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, ROWS + ROWS)
    el = spark.createDataFrame(
        [("p", "x", ["src/a.ts"], ["src/[bc].ts"])], "project string, path string, source_files array<string>, source_globs array<string>"
    )
    drain(st.stale_stream(stream(spark, src), el), "stale")
    assert sorted((r["path"], r["reason"]) for r in spark.table("stale").collect()) == [
        ("src/a.ts", "source_file"), ("src/b.ts", "source_glob"), ("src/c.ts", "source_glob"),
    ]


def test_live_index(spark, tmp_path):
    schema = "project string, path string, field string, text string, ts timestamp, seq bigint"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    write(spark, src, [("p", "a", "note", "old words", at(0), 0)], schema)
    st.live_index(stream(spark, src, schema), out, ck).awaitTermination(120)
    write(spark, src, [("p", "a", "note", "new words words", at(5), 1)], schema)
    st.live_index(stream(spark, src, schema), out, ck).awaitTermination(120)
    assert [r["text"] for r in st.live_fields(spark, out).collect()] == ["new words words"]
    for _ in range(2):
        assert [r["text"] for r in st.live_fields(spark, out).collect()] == ["new words words"]
        assert sorted((r["term"], r["tf"]) for r in st.live_postings(spark, out).collect()) == [("new", 1), ("words", 2)]
        st.compact_index(spark, out)
    assert spark.read.parquet(f"{out}/fields").count() == 1 and spark.read.parquet(f"{out}/postings").count() == 2


def test_live_history(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = "project string, path string, text string, written_at timestamp, seq bigint"
    src = str(tmp_path / "in")
    rows = [("p", "a", f"v{i}", at(i), i) for i in range(5)]
    write(spark, src, rows, schema)
    drain(st.live_history(stream(spark, src, schema), keep=2), "hist", "update")
    got = sorted((r["age"], r["text"]) for r in spark.table("hist").collect())
    assert got == [(1, "v4"), (2, "v3")]
    twin = change_log(spark.createDataFrame([(*r, "diagram") for r in rows], schema + ", field string"), 2)
    assert twin.count() == 2
