import pytest

from castwise.sources import filesets

SCHEMA = "id long, status string, title string"
ROWS = [(1, "draft", "a"), (2, "draft", "b"), (3, "published", "c"), (4, None, "d"), (5, "in review 50%", "e"), (None, "held", "f")]


def made(spark, tmp_path, rows=ROWS, partitions=("status",)):
    root = str(tmp_path / "content=1")  # a folder name that looks like a partition
    filesets.create(spark.createDataFrame(rows, SCHEMA), root, list(partitions))
    return root


def held(spark, root, version=None):
    return sorted((tuple(r) for r in filesets.read(spark, root, version).collect()), key=str)


def listed(spark, root):
    return set(filesets._listed(spark, root, filesets.versions(spark, root)[-1])[1])


def changed(spark, *rows):
    return spark.createDataFrame(rows, "id long, status string, title string")


def test_rows_move_and_other_files_stay(spark, tmp_path):
    root = made(spark, tmp_path)
    before = listed(spark, root)
    changes = changed(spark, (1, "published", None), (4, "draft", "D"), (99, "lost", "x"))
    assert filesets.update(spark, root, changes, "id", ["status", "title"]) == 2
    want = [(1, "published", None), (2, "draft", "b"), (3, "published", "c"), (4, "draft", "D"), *ROWS[4:]]
    assert held(spark, root) == sorted(want, key=str)
    assert held(spark, root, 1) == sorted(ROWS, key=str)  # whoever reads the old list still sees the old table
    stayed = before & listed(spark, root)
    assert {f.split("/")[1] for f in stayed} == {"status=published", "status=in review 50%25", "status=held"}
    assert filesets.update(spark, root, changes, "id", ["status", "title"]) == 3  # repeated: the same rows
    assert held(spark, root) == sorted(want, key=str)


def test_filters_prune_files(spark, tmp_path):
    root = made(spark, tmp_path)
    read = filesets.read(spark, root).filter("status = 'draft'")
    assert sorted(r["id"] for r in read.collect()) == [1, 2]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_a_job_that_dies_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    root = made(spark, tmp_path)
    changes = changed(spark, (1, "published", "new"))
    with monkeypatch.context() as m:
        def die(*_):
            raise RuntimeError("lost")

        m.setattr(filesets, "_publish", die)
        with pytest.raises(RuntimeError):
            filesets.update(spark, root, changes, "id", ["status", "title"])
    assert filesets.versions(spark, root) == [1] and held(spark, root) == sorted(ROWS, key=str)
    filesets.update(spark, root, changes, "id", ["status", "title"])
    assert (1, "published", "new") in held(spark, root) and len(held(spark, root)) == len(ROWS)


def test_of_two_writers_one_wins(spark, tmp_path):
    root = made(spark, tmp_path)
    head, files = filesets._listed(spark, root, 1)
    filesets.update(spark, root, changed(spark, (2, "held", "B")), "id", ["status"])
    with pytest.raises(filesets.Conflict):
        filesets._publish(spark, root, 2, head, files)
    assert (2, "held", "b") in held(spark, root)  # only the named column changed


def test_nothing_to_change_and_empty_tables(spark, tmp_path):
    root = made(spark, tmp_path)
    assert filesets.update(spark, root, changed(spark, (99, "x", "y"), (None, "x", "y")), "id", ["status"]) == 1
    empty = str(tmp_path / "empty")
    filesets.create(spark.createDataFrame([], SCHEMA), empty, ["status"])
    assert held(spark, empty) == [] and filesets.read(spark, empty).columns == ["id", "status", "title"]
    assert filesets.update(spark, empty, changed(spark, (1, "x", "y")), "id", ["status"]) == 1
    with pytest.raises(ValueError):
        filesets.create(spark.createDataFrame([(1,)], "__write int"), str(tmp_path / "clash"))


def test_without_partitions_and_first_change_by_order(spark, tmp_path):
    from pyspark.sql import functions as F

    root = made(spark, tmp_path, partitions=())
    changes = changed(spark, (1, "b", "1"), (1, "a", "2"))
    filesets.update(spark, root, changes, "id", ["status"], [F.col("status")])
    assert (1, "a", "a") in held(spark, root) and len(held(spark, root)) == len(ROWS)


def test_old_versions_go(spark, tmp_path):
    root = made(spark, tmp_path)
    for n in range(3):
        filesets.update(spark, root, changed(spark, (1, f"s{n}", "t")), "id", ["status", "title"])
    now = held(spark, root)
    assert filesets.forget(spark, root, keep=1) > 0
    assert filesets.versions(spark, root) == [4] and held(spark, root) == now
    assert filesets.forget(spark, root, keep=1) == 0
    with pytest.raises(ValueError):
        filesets.forget(spark, root, keep=0)
