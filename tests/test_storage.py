from spokewise import storage


def test_stash_and_discard(spark):
    df = storage.stash(spark.range(5), "numbers")
    path = df.inputFiles()[0]
    assert df.count() == 5 and storage.shared_dir(spark) in path
    assert storage.discard(spark) >= 1 and storage.discard(spark) == 0
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()


def test_drop_and_marks(spark):
    storage.discard(spark)
    first = storage.stash(spark.range(3), "first")
    since = storage.mark(spark)
    kept, gone = storage.stash(spark.range(4), "kept"), storage.stash(spark.range(5), "gone")
    assert storage.discard(spark, since, kept) == 1 and storage.mark(spark) == 2
    assert first.count() == 3 and kept.count() == 4
    storage.drop(first, None)
    assert storage.mark(spark) == 1 and storage.discard(spark) == 1


def test_discard_by_names(spark):
    storage.discard(spark)
    first = storage.stash(spark.range(3), "first")
    since = storage.names(spark)
    later = storage.stash_bucketed(spark.range(9), "later", "id", 2)
    storage.drop(first)  # moves every position
    assert later.count() == 9 and storage.name_of(later) in {t.name for t in spark.catalog.listTables()}
    assert storage.discard(spark, since) == 1 and storage.mark(spark) == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("later_")]
