"""Element trees: round trips, chosen folders, replaced projects, streams."""

from pyspark.sql import functions as F

from arborist.sources import corpus as co
from arborist.sources import tree
from arborist.session import scratch

ROWS = [
    ("p", "api", "description", "What it does\r\nand why é"), ("p", "api/auth", "diagram", "graph LR\n a --> b"), ("p", "api/auth", "note", ""),
    ("p", "ui main/x%y", "todo", "later"), ("q r", "data", "context", "rows"), ("p", "ui main", "concern", None), ("p", "api", "unknown", "x"),
]
KEPT = sorted(r for r in ROWS if r[3] is not None and r[2] != "unknown")


def rows(df):
    return sorted(tuple(r) for r in df.select("project", "path", "field", "text").collect())


def written(spark):
    tree.register(spark)
    root = scratch(spark, "test-tree")
    spark.createDataFrame(ROWS, tree.SCHEMA).repartition(3).write.format(tree.NAME).mode("append").save(root)
    return root


def test_round_trip_and_chosen_folders(spark):
    root = written(spark)
    back = spark.read.format(tree.NAME).load(root)
    assert rows(back) == KEPT
    assert back.rdd.getNumPartitions() == 3  # a task for each project and top element
    assert rows(back.where("project = 'p' AND field = 'note'")) == [r for r in KEPT if r[0] == "p" and r[2] == "note"] and rows(back) == KEPT
    some = spark.read.format(tree.NAME).option("projects", '["p", "none"]').option("fields", '["diagram", "note"]').load(root)
    assert rows(some) == [r for r in KEPT if r[0] == "p" and r[2] in ("diagram", "note")]
    assert some.rdd.getNumPartitions() == 2
    assert rows(spark.read.format(tree.NAME).option("projects", "[]").load(root)) == []


def test_writing_replaces_projects_and_streams_follow(spark):
    root = written(spark)
    seen = scratch(spark, "test-seen")

    def drain():
        query = (
            spark.readStream.format(tree.NAME).load(root).writeStream.format("parquet").option("path", seen)
            .option("checkpointLocation", seen + "-progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return rows(spark.read.schema(tree.SCHEMA).parquet(seen))

    assert drain() == KEPT
    new = ("q r", "other", "note", "new")
    spark.createDataFrame([new], tree.SCHEMA).write.format(tree.NAME).mode("append").save(root)
    assert rows(spark.read.format(tree.NAME).load(root)) == sorted([r for r in KEPT if r[0] == "p"] + [new])
    assert drain() == sorted([*KEPT, new])


def test_scanned_as_files(spark):
    root = written(spark)
    files = co.scan_corpus(spark, root, None)
    found = co.load_elements(files.where("project = 'p'"))
    assert sorted((r["path"], r["field"], r["text"]) for r in found.collect() if "%" not in r["path"]) == [r[1:] for r in KEPT if r[0] == "p" and r[3] and "%" not in r[1]]


def test_a_tree_of_many_files_is_listed_by_its_tasks(spark, tmp_path):
    """Two thousand files in 20 folders: tasks are folders, not a few files each, and the driver lists only the upper ones."""
    for k in range(20):
        for j in range(50):
            (tmp_path / f"p{k % 4}" / f"top{k}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"p{k % 4}" / f"top{k}" / f"e{j}" / "description.md").write_text(f"text {k} {j}")
            (tmp_path / f"p{k % 4}" / f"top{k}" / f"e{j}" / "note.md").write_bytes(b"caf\xe9 100%")
    (tmp_path / "p0" / "100% sure.md").write_text("own file")
    (tmp_path / "p0" / "_hidden.md").write_text("no")
    (tmp_path / "p0" / ".dot").mkdir()
    (tmp_path / "p0" / ".dot" / "a.md").write_text("no")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        files = co.scan_corpus(spark, root, None)
        assert files.count() == 2001 and files.select("project", "path").distinct().count() == 2001
        assert files.rdd.getNumPartitions() <= tree.DIVIDE + 5 + 50
        assert [tuple(r)[:4] for r in files.where("path LIKE '100%'").collect()] == [("p0", "100% sure.md", "own file", 8)]
    assert files.where("content = 'caf\ufffd 100%'").count() == 1000
    listed = co.scan_corpus(spark, str(tmp_path), [".txt", "sure.md"], content=False)
    assert [(r["content"], r["size"]) for r in listed.collect()] == [(None, 8)]
